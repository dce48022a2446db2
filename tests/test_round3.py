"""Range indices, in-document look-up, chunks cut where they are read, file order."""

import duckdb
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tagweave.operators import captions as cp
from tagweave.operators import spans as sp
from tagweave.operators.ranking import PLACE, RANGE_BITS, range_index, range_offsets, stored_ranges
from tagweave.operators.splits import md5_index
from tagweave.operators.tokenize import materialize_vocab, tokenize_text
from tagweave.plans import q_vocab
from tagweave.plans.catalog import all_oracles, all_queries
from tagweave.sources.datasets import in_file_order, load_by_extension, read_token_list, train_and_validation
from tagweave.sources.store import ResultCache, listing
from tagweave.sources.tables import derive_tag_corpus, tag_corpus

SMALL = "/root/testdata/sf0.001"


def test_range_index_equals_row_number(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("g"), F.when(F.col("id") % 2 == 0, F.md5(F.col("id").cast("string"))).alias("h"))
    order = [F.col("h").desc_nulls_last(), F.col("id").asc()]
    for parts in (1, 5, 37):
        got = range_index(df.repartition(parts), order).withColumn("want", F.row_number().over(Window.orderBy(*order)) - 1)
        assert got.where("idx <> want").count() == 0 and got.count() == 3000
    got = range_index(df, [F.col("g"), F.col("id").desc()], "pos", restart_on=["g"])
    want = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("id"))) - 1
    assert got.withColumn("want", want).where("pos <> want").count() == 0 and got.columns == ["id", "g", "h", "pos"]
    assert range_index(df.limit(0), order).count() == 0


def test_half_of_the_hashes_null_spread_over_ranges(spark):
    """No bucket of missing hashes: they are dealt out by key, and offsets are one per range."""
    files = spark.range(20000).select(F.lit("b").alias("booru"), F.col("id").alias("fid"), F.when(F.col("id") % 2 == 0, F.md5(F.col("id").cast("string"))).alias("torr_md5"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = stored_ranges(files, [F.col("torr_md5").asc_nulls_first(), F.col("fid")])
        sizes = [r["count"] for r in stored.groupBy(F.shiftright(PLACE, RANGE_BITS).alias("r")).count().collect()]
        nulls = stored.where("torr_md5 is null").select(F.shiftright(PLACE, RANGE_BITS)).distinct().count()
        offsets = range_offsets(stored, "fid").count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert offsets == len(sizes) <= parts and nulls >= parts // 2 - 1 and max(sizes) < 2 * 20000 / parts
    got = md5_index(files).withColumn("want", F.row_number().over(Window.orderBy(F.col("torr_md5").asc_nulls_first(), "booru", "fid")) - 1)
    assert got.where("idx <> want").count() == 0


WORDS = ["Ab", "tail", "long_word", "foo-bar", "foo", "bar", "<unk>", "ÉTÉ", "", "a-b", "x_y_z", "long", "_", "--____"]


def test_texts_look_up_in_place_as_by_join(spark):
    rows = [(i, " ".join(WORDS[(i * j) % len(WORDS)] for j in range(i % 9))) for i in range(60)] + [(100, None), (101, ""), (102, "  "), (103, "foo " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    registry = spark.createDataFrame([(i, t, 0) for i, t in enumerate(["<pad>", "<unk>", "ab", "foo", "bar", "été", "long", "x", "long_word"])], "id int, token string, origin int")
    vocab = materialize_vocab(registry, "<pad>", "<unk>")
    ids = {t: i for i, t in enumerate(["<pad>", "<unk>", "ab", "foo", "bar", "été", "long", "x", "long_word"])}

    def brute(text):
        out = []
        for w in text.split(" "):
            w = w.lower()
            parts = [w] if w in ids or len(w) <= 4 else w.replace("_", "-").split("-")
            out += [p if p in ids else "<unk>" for p in parts]
        return [ids[t] for t in out], out

    want = sorted((i, *brute(t)) for i, t in rows if t is not None)
    for held in (1 << 20, 0):
        got = tokenize_text(docs, vocab, held_bytes=held)
        assert sorted((r.doc_id, list(r.ids), list(r.tokens)) for r in got.collect()) == want
        assert got.columns == ["doc_id", "ids", "tokens"]
    plan = tokenize_text(docs, vocab)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == docs._jdf.queryExecution().executedPlan().toString().count("Exchange")  # none but that of the input


def brute_chunks(rows, length, per_group, keep_short):
    groups, out = {}, {}
    for i, (_, ids) in enumerate(sorted(rows)):
        groups.setdefault(i // per_group, []).extend(ids)
    for g, flat in groups.items():
        if 0 < len(flat) < length and keep_short:
            out[g, 0] = flat
        for c in range(len(flat) // length):
            out[g, c] = flat[c * length : (c + 1) * length]
    return out


def test_chunks_cut_where_they_are_read(spark):
    """Against brute force, with groups inside a task, across tasks and batches, empty
    documents, a short last group, and many small files."""
    rows = [(7 * i, [(i * 31 + j) % 1000 for j in range((i * 37) % 23)]) for i in range(503)]
    df = spark.createDataFrame(rows, "key long, ids array<int>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for per_group, length, keep in ((10, 40, True), (10, 40, False), (100, 7, True), (1000, 50, True), (1, 5, True), (3, 2000, True)):
            got = sp.cut_chunks(df.repartition(4), "key", "ids", length, per_group, keep).collect()
            assert {(r.group, r.chunk): list(r.input_ids) for r in got} == brute_chunks(rows, length, per_group, keep)
            assert len(got) == len({(r.group, r.chunk) for r in got})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sp.cut_chunks(df.limit(0), "key", "ids", 10).count() == 0


def test_short_last_group_is_in_query_and_twin(spark, tmp_path):
    """1,001 documents: the last one is a group of its own, shorter than a chunk."""
    docs = spark.range(1001).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, F.concat(F.lit("red fox ran_over the "), F.col("id") % 13, F.lit(" hills and "), F.col("id") % 7)).otherwise("the red hills").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for table in ("orders", "lineitem", "part", "supplier", "nation"):
        (tmp_path / f"{table}.parquet").symlink_to(f"/root/testdata/sf0.001/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
    for name in ("mlm_chunks", "mlm_group_lengths", "mlm_batches", "chunk_epoch_batches"):
        got, want = all_queries()[name](spark, str(tmp_path)).toPandas(), con.sql(all_oracles()[name]).df()
        columns = sorted(want.columns)
        a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
        pd.testing.assert_frame_equal(a, b)
        if name == "mlm_chunks":
            assert len(got[got.group == 1]) == 1 and len(got.input_ids[got.group == 1].iloc[0].split()) < 10


def test_percent_slices_follow_file_names_and_lines(spark, tmp_path):
    (tmp_path / "data.txt").mkdir()
    for name, n in (("a.txt", 20), ("b.txt", 3000)):
        (tmp_path / "data.txt" / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    train, validation = train_and_validation(spark, str(tmp_path / "data.txt"), validation_pct=10)
    want = [f"a.txt {i}" for i in range(20)] + [f"b.txt {i}" for i in range(3000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = in_file_order(load_by_extension(spark, str(tmp_path / "data.txt")), "n").orderBy("n").collect()
        tokens = read_token_list(spark, str(tmp_path / "data.txt")).orderBy("rank").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
    assert [r.text for r in lines] == want == [r.token for r in tokens] and [r.n for r in lines] == list(range(3020))
    assert sorted(r.text for r in validation.collect()) == sorted(want[:302])
    assert sorted(r.text for r in train.collect()) == sorted(want[302:])


def key_exchanges(df):
    """Exchanges by file key in the physical plan, without those of small label tables."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Exchange hashpartitioning(booru" in x]


def test_bucketed_corpus_needs_no_exchange_by_file(spark):
    corpus, vocab = tag_corpus(spark, SMALL), q_vocab.tag_vocabulary(spark, SMALL)
    assert key_exchanges(cp.caption_candidates(corpus.tags, vocab)) == []
    joined = corpus.tags.hint("merge").join(corpus.files, ["booru", "fid"])
    assert key_exchanges(joined) == [] and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    per_file = corpus.tags.groupBy("booru", "fid").count()
    assert "Exchange" not in per_file._jdf.queryExecution().executedPlan().toString()
    plain = derive_tag_corpus(spark, SMALL)
    assert sorted(map(tuple, corpus.files.collect()), key=repr) == sorted(map(tuple, plain.files.collect()), key=repr)
    assert corpus.tags.exceptAll(plain.tags).count() == 0 == plain.tags.exceptAll(corpus.tags).count()


def test_stored_results_follow_their_inputs(spark, tmp_path):
    """Built again for changed input, other parameters or the flag; else read."""
    cache, built = ResultCache(), []
    source = f"{tmp_path}/in.parquet"

    def get(n=1, **more):
        def build(folder, files):
            built.append(folder)
            spark.read.parquet(source).selectExpr(f"id * {n} AS id").write.parquet(folder)
            return folder
        return sorted(r.id for r in spark.read.parquet(cache.get(spark, "x", [source], build, params=[n], **more)).collect())

    spark.range(3).write.parquet(source)
    assert get() == [0, 1, 2] == get() and len(built) == 1
    assert get(2) == [0, 2, 4] and len(built) == 2
    assert get(overwrite=True) == [0, 1, 2] and len(built) == 3
    there = lambda path: listing(spark, path)[0][1] >= 0
    assert not there(built[0]) and there(built[1]) and there(built[2])  # the one built again is gone
    spark.range(5).write.mode("overwrite").parquet(source)
    assert get() == [0, 1, 2, 3, 4] and len(built) == 4
    cache.clear(spark)
    assert not any(map(there, built)) and listing(spark, f"{tmp_path}/nothing") == [(f"{tmp_path}/nothing", -1, 0)]


def test_tags_are_made_unique_where_line_items_were_dealt_out(spark):
    """One exchange by file, before a line item becomes tags, and none of the tags."""
    from tagweave.sources.tables import tags_from_lineitems

    lines = spark.range(40).selectExpr("id % 9 AS l_orderkey", "id % 7 AS l_partkey", "id % 3 AS l_suppkey")
    orders = spark.range(9).selectExpr("id AS o_orderkey", "concat('b', id % 2) AS o_orderpriority")
    part = spark.range(7).selectExpr("id AS p_partkey", "concat('p ', id) AS p_name", "'T X' AS p_type", "'B' AS p_brand", "CAST(id AS INT) AS p_size")
    supplier = spark.range(3).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "0L AS s_nationkey")
    nation = spark.range(1).selectExpr("id AS n_nationkey", "'N' AS n_name")
    plain = tags_from_lineitems(lines, orders, part, supplier, nation)
    dealt = tags_from_lineitems(lines, orders, part, supplier, nation, buckets=5)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    steps = dealt._jdf.queryExecution().executedPlan().toString()
    assert steps.index("Generate") < steps.index("REPARTITION_BY_NUM")  # printed from the last step on
    assert "Exchange" not in steps[:steps.index("Generate")]


def test_insert_keeps_files_open_in_place_of_a_sort(spark, tmp_dir, monkeypatch):
    """Rows of a partitioned insert are not sorted by partition, also with more partitions
    than a task keeps open; the session's setting stays as it was."""
    from pyspark.sql import DataFrameWriter

    from tagweave.sources import store

    name, seen, real = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.insertInto
    monkeypatch.setattr(DataFrameWriter, "insertInto", lambda self, *a, **k: seen.append(spark.conf.get(name)) or real(self, *a, **k))
    before = spark.conf.get(name, None)
    table = store.create_table(spark, f"{tmp_dir}/t", "fid BIGINT, booru STRING", "booru")
    rows = spark.range(300).selectExpr("id AS fid", "concat('b', id % 20) AS booru")
    store.insert_into(rows, table)
    assert spark.table(table).count() == 300
    store.insert_into(rows.where("fid = 3"), table, overwrite=True)
    assert spark.table(table).where("booru = 'b3'").count() == 1 and spark.table(table).count() == 286
    assert [int(v) > 0 for v in seen] == [True, True] and spark.conf.get(name, None) == before


def test_raw_tag_shards_are_packed(spark):
    """The written shards take a fraction of their lines' bytes, and are read back whole."""
    from tagweave.plans import q_ingest
    from tagweave.sources.store import listing

    paths = q_ingest.raw_shards(spark, "/root/testdata/sf0.001")["tags"]
    parts = [p for path in paths.values() for p, _, _ in listing(spark, path) if "part-" in p and not p.endswith(".crc")]
    assert parts and all(p.endswith(".gz") for p in parts)
