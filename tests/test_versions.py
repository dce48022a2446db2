"""Tables that grow by versions."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from tagweave.session import scratch_path
from tagweave.sources.store import listing
from tagweave.streaming import streams as st
from tagweave.streaming.versions import KEPT


@pytest.fixture
def table(spark):
    return st.prevalence_table(spark, scratch_path(spark, f"versions-{uuid.uuid4().hex}"))


def _counts(spark, pairs):
    return spark.createDataFrame(pairs, st.PREVALENCE_SCHEMA).coalesce(1)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_newest_values_win(spark, table):
    assert table.read().count() == 0 and table.read().schema == st.PREVALENCE_SCHEMA
    state = {}
    for version in range(9):
        changed = {f"k{i}": version * 10 + i for i in range(version % 4 + 1)} | {None: version}
        state.update(changed)
        table.publish(_counts(spark, list(changed.items())), version)
        assert _rows(table.read()) == sorted(state.items(), key=str)
    assert table.versions() == [6, 7, 8]


def test_a_version_again_changes_nothing_and_an_older_one_is_refused(spark, table):
    for version in (0, 4):
        table.publish(_counts(spark, [("a", version + 1)]), version)
    table.publish(_counts(spark, [("a", 99)]), 4)
    assert _rows(table.read()) == [("a", 5)]
    with pytest.raises(ValueError):
        table.publish(_counts(spark, [("a", 9)]), 3)


def test_a_reader_of_a_kept_version_goes_on(spark, table):
    table.publish(_counts(spark, [("a", 1), ("b", 1)]), 0)
    held = table.read()
    for version in range(1, KEPT):
        table.publish(_counts(spark, [("a", version + 1)]), version)
        assert _rows(held) == [("a", 1), ("b", 1)]
    assert _rows(table.read(0)) == [("a", 1), ("b", 1)] and _rows(table.read()) == [("a", KEPT), ("b", 1)]


def test_bytes_written_follow_the_changes(spark, table):
    many = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("label"), F.col("id").alias("prevalence"))
    table.publish(many, 0)
    base = table.parts(0)
    size = sum(n for _, n, _ in listing(spark, f"{table.path}/{base[0]}"))
    for version in range(1, 12):
        table.publish(_counts(spark, [("x", version)]), version)
        parts = table.parts(version)
        assert parts[0] == base[0] and len(parts) <= 4
        assert sum(n for _, n, _ in listing(spark, *(f"{table.path}/{p}" for p in parts[1:]))) < size / 100
    folders = {path.rsplit("/", 2)[1] for path, _, _ in listing(spark, table.path) if path.endswith(".parquet")}
    assert len(folders) <= 2 + 3 * KEPT
    assert table.read().count() == 200_001 and table.read().where("label = 'x'").first().prevalence == 11


def test_a_stream_publishes_between_triggers(spark, tmp_dir):
    seen = []
    for part in range(3):
        rows = spark.createDataFrame([("b", part * 10 + i, f"T{i % (part + 1)}", i % 2) for i in range(6)], st.TAG_EVENT_SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
        st.prevalence_stream(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", None).awaitTermination()
        seen.append(_rows(st.latest_result(spark, f"{tmp_dir}/out")))
    assert seen == [[("t0", 6)], [("t0", 9), ("t1", 3)], [("t0", 11), ("t1", 5), ("t2", 2)]]
