"""Steps that grew faster than their input: groups brought into one task, work done twice,
tables and columns that nobody asked for."""

import pytest
from pyspark.sql import functions as F

from tagweave.config import CaptionConfig
from tagweave.operators import captions as cp
from tagweave.operators.ranking import range_index
from tagweave.operators.spans import cut_chunks
from tagweave.operators.tokenize import materialize_vocab
from tagweave.plans import q_spans
from tagweave.sources import tables
from tagweave.sources.store import ResultCache
from tagweave.streaming import streams as st


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _vocab(spark):
    rows = [(0, "<pad>", 0), (1, "<unk>", 0), *[(i + 2, f"t{i}", 1) for i in range(30)]]
    return materialize_vocab(spark.createDataFrame(rows, "id int, token string, origin int"), "<pad>", "<unk>")


def _corpus(spark):
    files = spark.createDataFrame([("a", i, f"{i * 7919 % 101:03d}") for i in range(80)], "booru string, fid long, torr_md5 string")
    tags = spark.createDataFrame([("a", f, f"t{(f + j) % 30}", j % 5) for f in range(80) for j in range(1 + f % 12)], "booru string, fid long, tag string, tag_cat int")
    return files, tags


@pytest.fixture
def no_small_joins(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_positions_that_restart_do_not_bring_a_group_into_one_task(spark, no_small_joins):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    got = range_index(df, [F.col("g"), F.col("id")], "pos", restart_on=["g"])
    assert "SortMergeJoin" not in _plan(got)
    assert all(r["pos"] == r["id"] // 2 for r in got.collect())


def test_feed_without_captions_has_the_same_ids(spark):
    files, tags = _corpus(spark)
    cfg, vocab = CaptionConfig(test_quantity=5), _vocab(spark)
    whole = cp.caption_feed(files, tags, vocab, cfg)
    lean = cp.caption_feed(files, tags, vocab, cfg, with_caption=False)
    assert {"caption", "torr_md5", "idx"}.isdisjoint(lean.columns)
    key = lambda r: (r["booru"], r["fid"])
    assert sorted(lean.collect(), key=key) == sorted(whole.select(*lean.columns).collect(), key=key)
    assert lean.count() > 0


def test_tags_of_records_are_not_exchanged(spark):
    files, tags = _corpus(spark)
    vocab, records = _vocab(spark), st.caption_records(files, tags)
    records.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/records-findings3")
    plan = _plan(st.examples_of_records(spark.read.parquet(path), vocab))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(booru" in line]
    assert moved and all("REPARTITION_BY_COL" in line for line in moved)


def test_only_the_table_that_is_read_is_written(spark, monkeypatch):
    written = []
    real = tables.write_bucketed
    monkeypatch.setattr(tables, "RESULTS", ResultCache())
    monkeypatch.setattr(tables, "write_bucketed", lambda df, path, *a, **k: written.append(path.rsplit("/", 1)[1]) or real(df, path, *a, **k))
    corpus = tables.tag_corpus(spark, "/root/testdata/sf0.001")
    assert written == []
    corpus.tags.count()
    corpus.tags.count()
    assert written == ["tags"]


def test_rows_are_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def made(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    rows = spark.range(500, numPartitions=4).select("id", F.array_repeat(F.col("id").cast("int"), 3).alias("ids"))
    chunks = cut_chunks(rows.mapInArrow(made, "id bigint, ids array<int>"), "id", "ids", 10, 100)
    assert chunks.count() == 150
    assert calls.value == 500


def test_documents_are_tokenised_once_for_group_lengths(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def tokenised(*_, **__):
        def made(batches):
            for batch in batches:
                calls.add(batch.num_rows)
                yield batch
        rows = spark.range(2500, numPartitions=4).select(F.col("id").alias("doc_id"), F.array_repeat(F.lit(1), 2).alias("ids"))
        return rows.mapInArrow(made, "doc_id bigint, ids array<int>")

    monkeypatch.setattr(q_spans, "text_vocabulary", lambda *_: None)
    monkeypatch.setattr(q_spans, "documents", lambda *_: None)
    monkeypatch.setattr(q_spans, "tokenize_text", tokenised)
    got = {r["group"]: r["total_tokens"] for r in q_spans.q_mlm_group_lengths(spark, "").collect()}
    assert got == {0: 2000, 1: 2000, 2: 1000}
    assert calls.value == 2500
