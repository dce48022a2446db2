"""Findings of round 4: captions in one pass and by numbers, tags unique by order, raw rows exchanged
once, stream state on disk, lattices as bytes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tagweave.config import PAD_TOKEN, UNK_TOKEN, CaptionConfig
from tagweave.functions.random import MOST_BITS, floyd_bits, floyd_sample, hash_key, item_hash, key_text
from tagweave.operators import captions as cp
from tagweave.operators import quality
from tagweave.operators import subword as sw
from tagweave.operators import tokenize as tk
from tagweave.operators import vocab as vb
from tagweave.sources import tsv
from tagweave.sources.store import listing
from tagweave.streaming import streams as st

PARTS = [f"p{i}" for i in range(40)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_joins(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def _vocab(spark):
    general = spark.createDataFrame([(i, p) for i, p in enumerate(PARTS)], "rank long, token string")
    return tk.materialize_vocab(vb.registry_a(spark, spark.createDataFrame([], "rank long, token string"), general), PAD_TOKEN, UNK_TOKEN)


def _tags(spark, sizes):
    rnd, rows = random.Random(4), []
    for fid, n in enumerate(sizes):
        seen = set()
        while len(seen) < n:
            seen.add("_".join(rnd.choice(PARTS) for _ in range(rnd.choice([1, 1, 2, 3, 5]))))
        rows += [("b", fid, tag, rnd.choice([0, 0, 1, 3, 4, None])) for tag in sorted(seen)]
    return spark.createDataFrame(rows, "booru string, fid long, tag string, tag_cat int")


def test_files_with_few_tags_need_no_order_by_hash(spark):
    """Their labels and totals come from one pass; rows without a key make no caption."""
    tags, vocab = _tags(spark, [3, 12, 50]), _vocab(spark)
    tags = tags.unionByName(spark.createDataFrame([(None, 1, "p1", 0), ("b", None, "p1", 0)], tags.schema))
    found = cp.caption_candidates(tags, vocab)
    rows = found.collect()
    assert "Window" not in _plan(found).split("Initial Plan")[0]
    assert sorted((r.fid, len(r.labels)) for r in rows) == [(0, 3), (1, 12), (2, 50)]
    assert all(r.n_total == sum(len(x.ids) for x in r.labels) for r in rows)


def test_labels_chosen_by_numbers_are_those_chosen_by_the_fold(spark, monkeypatch):
    """With few labels, with more than fit a number, and on either side of that bound."""
    sizes = [4, 20, 31, cp.FEW - 1, cp.FEW, cp.FEW + 1, 90]
    labelled = cp.file_labels(_tags(spark, sizes), vocab := _vocab(spark))
    pick = lambda df: sorted((r.fid, r.n_tokens, r.shortened, r.unmasked, r.masked) for r in df.collect())
    for cfg in (CaptionConfig(), CaptionConfig(seed=7, max_tokens=80, label_strategy_chance=1.0), CaptionConfig(seed=8, max_tokens=90, max_crucial_tokens=9, label_strategy_chance=0.0)):
        made = cp.examples(cp.suitable_captions(labelled, vocab, cfg), cfg)
        numbers = pick(made)
        with monkeypatch.context() as m:
            m.setattr(cp, "FEW", -1)
            m.setattr(cp, "MOST_BITS", -1)
            fold = pick(cp.examples(cp.suitable_captions(labelled, vocab, cfg), cfg))
        assert numbers == fold and len(fold) >= 6


def test_draws_and_hashes_of_items(spark):
    df = spark.range(1, 63).select(F.col("id").cast("int").alias("n"), F.concat(F.lit("k"), "id").alias("key"))
    k = F.least(F.lit(8), F.col("n"))
    rows = df.select("n", floyd_sample(F.col("n"), k, 5, "mask", F.col("key")).alias("s"), floyd_bits(F.col("n"), k, 5, "mask", F.col("key")).alias("b")).collect()
    assert MOST_BITS == 62 and all([v for v in range(63) if r.b >> v & 1] == r.s and len(r.s) == min(8, r.n) for r in rows)
    items = spark.createDataFrame([("a",), ("",), ("|",), (None,)], "x string")
    assert items.where(item_hash(key_text(1, "p", F.lit("k")), F.col("x")) != hash_key(1, "p", F.lit("k"), F.col("x"))).count() == 0


def test_tags_are_made_unique_in_the_order_they_are_stored_in(spark):
    from tagweave.sources.tables import tags_from_lineitems

    lines = spark.range(60).selectExpr("id % 9 AS l_orderkey", "id % 7 AS l_partkey", "id % 3 AS l_suppkey")
    orders = spark.range(9).selectExpr("id AS o_orderkey", "IF(id = 4, NULL, concat('b', id % 2)) AS o_orderpriority")
    part = spark.range(7).selectExpr("id AS p_partkey", "IF(id = 2, NULL, concat('p ', id)) AS p_name", "'T X' AS p_type", "'B' AS p_brand", "CAST(id AS INT) AS p_size")
    supplier = spark.range(3).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "0L AS s_nationkey")
    nation = spark.range(1).selectExpr("id AS n_nationkey", "'N' AS n_name")
    dealt = tags_from_lineitems(lines, orders, part, supplier, nation, buckets=5)
    plain = tags_from_lineitems(lines, orders, part, supplier, nation)
    assert "SortAggregate" in _plan(dealt) and "HashAggregate" not in _plan(dealt)
    assert dealt.schema == plain.schema and sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))


def test_orphans_are_exchanged_by_file_alone(spark, no_small_joins):
    raw = spark.createDataFrame([("b", 1, "x", None, 4, ""), ("b", 1, "x", None, 3, ""), ("b", 2, "y", None, 0, ""), ("b", 1, "z", 7, 0, ""), ("b", None, "n", None, 0, "")], tsv.TAGS_SCHEMA)
    files = spark.createDataFrame([("b", 2)], "booru string, fid long")
    found = tsv.unique_tags(quality.orphan_tags(raw, files))
    moved = re.findall(r"Exchange hashpartitioning\((.*?)\)", _plan(found))
    assert len(moved) == 2 and not any("tag#" in keys for keys in moved)
    want = quality.orphan_tags(tsv.unique_tags(raw), files)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 3


def test_raw_orphans_query_makes_keys_unique_after_the_join(spark, no_small_joins):
    from tagweave.plans.q_ingest import q_raw_orphan_tags

    plan = q_raw_orphan_tags(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join LeftAnti")


def test_integer_text(spark):
    texts = ["5", " 5", "+5", "05", "-0", "1.5", "", "x", "5x", "99999999999999999999", "5 ", "\t7", "1e3", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    assert [r.v for r in df.select(tsv._int("c").alias("v")).collect()] == [5, 5, 5, 5, 0, None, None, None, None, None, 5, 7, None, None]


def test_keys_of_records_are_kept_on_disk(spark, tmp_dir):
    """Not in the heap of the executors; the session's settings stay as they were."""
    before = dict(spark.conf.getAll)
    rows = [("b", i, f"b_{i}", [("p1_p2_p3", 0), ("p4_p5", 1)]) for i in range(6)]
    records = spark.createDataFrame(rows, st.CAPTION_RECORD_SCHEMA).withColumn("arrived", F.timestamp_seconds(F.lit(1_640_995_200)))
    for _ in range(2):
        records.write.mode("append").parquet(f"{tmp_dir}/in4")
        st.caption_example_stream(spark, f"{tmp_dir}/in4", f"{tmp_dir}/out4", _vocab(spark), repeats_within="1 day").awaitTermination()
    assert spark.read.parquet(f"{tmp_dir}/out4").count() == 6
    kept = [path for path, _, _ in listing(spark, f"{tmp_dir}/out4-checkpoint/state")]
    assert any(path.endswith((".zip", ".changelog")) for path in kept) and not any(path.endswith(".delta") for path in kept)
    assert dict(spark.conf.getAll) == before


def test_lattices_are_bytes(spark):
    import pandas as pd

    words = spark.createDataFrame([("ab", 2), ("b", 1)], "word string, freq long")
    rows = {r.word: r for r in sw.lattice_edges(words, pd.DataFrame({"piece": ["a", "b", "ab"]}), 2).collect()}
    assert list(memoryview(bytes(rows["ab"].edges)).cast("i")) == [0, 2, 1, -1] and list(memoryview(bytes(rows["b"].edges)).cast("i")) == [1, -1]
