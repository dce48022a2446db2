"""Named ingest queries: raw TSV shards -> files / tags tables.

The raw shards are written once per application from the driver tables (a
stand-in for the original dumps: the same 13 / 6 column layouts with a header
line); the queries then run the whole ingest on them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..sources import tsv
from ..sources.store import RESULTS
from ..sources.tables import SOURCES, read_table, table_paths, tag_corpus
from .catalog import query
from .oracle_sql import with_corpus

SHARDS = ("2021", "2022")


def _write_tsv(df, path):
    line = F.concat_ws("\t", *df.columns).alias("\t".join(df.columns))
    (df.select(line).write.mode("overwrite").option("sep", "\u0001").option("header", "true")
     .option("quote", "\u0000").option("escapeQuotes", "false").option("compression", "gzip").csv(path))


def raw_shards(spark, sf_dir) -> dict:
    """Paths of the raw TSV shards, written once per application and input."""
    return RESULTS.get(spark, "raw", table_paths(sf_dir, *SOURCES), lambda base, files: _write_shards(spark, sf_dir, base))


def _write_shards(spark, sf_dir, base: str) -> dict:
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority",
                        "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    files = orders.select(
        F.col("o_orderpriority").alias("booru"), k.cast("string").alias("fid"),
        F.concat(k.cast("string"), F.lit(".png")).alias("file_name"),
        F.when(k % 97 == 0, F.lit("")).otherwise(F.md5(k.cast("string"))).alias("torr_md5"),
        F.lower("o_orderstatus").alias("orig_ext"), F.lit("").alias("orig_md5"),
        F.floor("o_totalprice").cast("string").alias("file_size"),
        F.when(k % 13 == 0, F.lit("")).otherwise(F.concat(
            (F.col("o_custkey") % 2048).cast("string"), F.lit("x"),
            (k % 1536).cast("string"))).alias("size"),
        *[F.lit("").alias(c) for c in ("jq", "torr_path", "tags_copyr", "tags_char", "tags_artist")],
        F.when(k % 10 < 5, F.lit(SHARDS[0])).otherwise(F.lit(SHARDS[1])).alias("_shard"))
    tags = tag_corpus(spark, sf_dir).tags
    tag_rows = tags.select(
        "booru", F.col("fid").cast("string").alias("fid"), "tag", F.lit("").alias("tag_id"),
        F.col("tag_cat").cast("string").alias("tag_cat"), F.lit("").alias("danb_fr"),
        F.when(F.col("fid") % 10 < 5, F.lit(SHARDS[0])).otherwise(F.lit(SHARDS[1])).alias("_shard"))
    # One shard of the dumps repeats rows; its character rows appear twice here. Artists have
    # lines that the quote rule drops, one with the quote beyond the columns; franchises have
    # lines that repeat a key with a larger category, which lose against the first.
    line = lambda tag="tag", cat="tag_cat", danb=F.lit(""): F.struct(
        F.col(tag).alias("tag") if isinstance(tag, str) else tag.alias("tag"),
        (F.col(cat) if isinstance(cat, str) else cat).alias("tag_cat"), danb.alias("danb_fr"))
    lines = F.when((F.col("_shard") == SHARDS[1]) & (F.col("tag_cat") == "4"), F.array(line(), line())) \
        .when(F.col("tag_cat") == "1", F.array(line(), line(F.concat(F.lit('"'), "tag")), line(F.concat("tag", F.lit("_seven")), danb=F.lit('\tx"y')))) \
        .when(F.col("tag_cat") == "3", F.array(line(), line(cat=F.lit("9"), danb=F.lit("\tbeyond")))) \
        .otherwise(F.array(line()))
    columns = [c for c in tag_rows.columns if c != "_shard"]
    tag_rows = tag_rows.select("booru", "fid", "tag_id", "_shard", F.explode(lines).alias("_l")).select(
        "booru", "fid", "_l.tag", "tag_id", "_l.tag_cat", "_l.danb_fr", "_shard").select(*columns, "_shard")
    paths = {"files": {}, "tags": {}}
    for shard in SHARDS:
        fp, tp = f"{base}/{shard}_files.tsv", f"{base}/{shard}_tags.tsv"
        _write_tsv(files.where(F.col("_shard") == shard).drop("_shard"), fp)
        _write_tsv(tag_rows.where(F.col("_shard") == shard).drop("_shard"), tp)
        paths["files"][shard], paths["tags"][shard] = fp, tp
    return paths


@query("ingested_files", """
SELECT o_orderpriority AS booru, o_orderkey AS fid,
       CASE WHEN o_orderkey % 10 < 5 THEN '2021' ELSE '2022' END AS shard,
       CAST(o_orderkey AS VARCHAR) || '.png' AS file_name,
       CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE md5(CAST(o_orderkey AS VARCHAR)) END AS torr_md5,
       lower(o_orderstatus) AS orig_ext, '' AS orig_md5,
       CAST(floor(o_totalprice) AS BIGINT) AS file_size,
       CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_custkey % 2048 END AS INTEGER) AS img_width_torr,
       CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_orderkey % 1536 END AS INTEGER) AS img_height_torr,
       '' AS jq, '' AS torr_path, '' AS tags_copyr, '' AS tags_char, '' AS tags_artist
FROM orders
""")
def q_ingested_files(spark, sf_dir):
    """Two raw files shards -> files table: header skip, quote rule, shard
    literal, lenient WxH split, integer coercion, bag union."""
    paths = raw_shards(spark, sf_dir)["files"]
    return tsv.ingest_files(spark, [(s, paths[s]) for s in SHARDS])


@query("rebuilt_files", """
SELECT o_orderpriority AS booru, o_orderkey AS fid,
       CASE WHEN o_orderkey % 10 < 5 THEN '2021' ELSE '2022' END AS shard,
       CAST(o_orderkey AS VARCHAR) || '.png' AS file_name,
       CAST(floor(o_totalprice) AS BIGINT) AS file_size,
       CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_custkey % 2048 END AS INTEGER) AS img_width_torr
FROM orders WHERE o_orderkey % 10 < 5 OR o_orderkey % 13 <> 0
""")
def q_rebuilt_files(spark, sf_dir):
    """The files table built from both shards, then the second shard built again without
    the files whose size is not known: it replaces itself, the first stays as it was (S19)."""
    raw = raw_shards(spark, sf_dir)["files"]

    def build(base, _files):
        path = f"{base}/files"
        tsv.write_table(tsv.ingest_files(spark, [(s, raw[s]) for s in SHARDS]), path, ["shard"], ["booru", "fid"])
        again = tsv.ingest_files(spark, [(SHARDS[1], raw[SHARDS[1]])]).where("fid % 13 <> 0")
        tsv.write_table(again, path, ["shard"], ["booru", "fid"], keep_others=True)
        return path

    path = RESULTS.get(spark, "rebuilt", table_paths(sf_dir, "orders"), build)
    return (spark.read.schema(tsv.FILES_SCHEMA).parquet(path)
            .select("booru", "fid", "shard", "file_name", "file_size", "img_width_torr"))


@query("ingested_tags", with_corpus(body="""
SELECT booru, fid, tag, CAST(NULL AS BIGINT) AS tag_id, tag_cat, '' AS danb_fr FROM tags
"""))
def q_ingested_tags(spark, sf_dir):
    """Two raw tags shards (one with repeated rows) -> tags table with the key
    made unique."""
    paths = raw_shards(spark, sf_dir)["tags"]
    return tsv.ingest_tags(spark, [paths[s] for s in SHARDS])


@query("raw_tag_key_duplicates", with_corpus(body="""
SELECT booru, fid, tag,
       CAST(1 + max(CASE WHEN tag_cat = 3 THEN 1 ELSE 0 END)
            + max(CASE WHEN tag_cat = 4 AND fid % 10 >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS copies
FROM tags WHERE tag_cat = 3 OR (tag_cat = 4 AND fid % 10 >= 5) GROUP BY booru, fid, tag
"""))
def q_raw_tag_key_duplicates(spark, sf_dir):
    """Keys that the raw tags shards hold more than once."""
    paths = raw_shards(spark, sf_dir)["tags"]
    raw = tsv.ingest_tags(spark, [paths[s] for s in SHARDS], dedup=False)
    return quality.duplicate_keys(raw, quality.TAG_KEY)


@query("raw_orphan_tags", with_corpus(body="""
SELECT booru, fid, tag, tag_cat FROM tags WHERE fid % 10 >= 5
"""))
def q_raw_orphan_tags(spark, sf_dir):
    """Tags of both shards whose file the first files shard does not hold."""
    paths = raw_shards(spark, sf_dir)
    raw = tsv.ingest_tags(spark, [paths["tags"][s] for s in SHARDS], dedup=False)
    files = tsv.ingest_files(spark, [(SHARDS[0], paths["files"][SHARDS[0]])])
    # A key's rows are of one file: they are orphans all or none, and the rows that stay lie by
    # file where their keys are made unique.
    return tsv.unique_tags(quality.orphan_tags(raw, files)).select("booru", "fid", "tag", "tag_cat")
