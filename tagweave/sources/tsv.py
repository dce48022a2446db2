"""Raw tab-separated shard ingest.

Each shard is a pair of TSV files (files, tags) with a header line. Rules:

* the header of every file is skipped (``header=True`` is per file);
* a line holding a double quote anywhere is dropped (the raw dumps contain
  unbalanced quotes; no quoting is applied while parsing);
* files rows get the shard name as a literal column after the key, and the
  ``WxH`` field is split into two integers with awk's lenient ``%d``
  coercion (leading integer, else 0);
* tags rows are de-duplicated on their key (the dumps contain repeated rows).

Shards are read one reader per shard and concatenated with ``unionByName``;
nothing is collected. Empty text fields stay ``''`` as in the original import.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lenient_int

RAW_FILES_COLUMNS = ("booru", "fid", "file_name", "torr_md5", "orig_ext", "orig_md5",
                     "file_size", "size", "jq", "torr_path", "tags_copyr", "tags_char",
                     "tags_artist")
RAW_TAGS_COLUMNS = ("booru", "fid", "tag", "tag_id", "tag_cat", "danb_fr")

FILES_SCHEMA = T.StructType([
    T.StructField("booru", T.StringType(), False),
    T.StructField("fid", T.LongType(), False),
    T.StructField("shard", T.StringType(), False),
    T.StructField("file_name", T.StringType(), False),
    T.StructField("torr_md5", T.StringType()),
    T.StructField("orig_ext", T.StringType()),
    T.StructField("orig_md5", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("img_width_torr", T.IntegerType()),
    T.StructField("img_height_torr", T.IntegerType()),
    T.StructField("jq", T.StringType()),
    T.StructField("torr_path", T.StringType()),
    T.StructField("tags_copyr", T.StringType()),
    T.StructField("tags_char", T.StringType()),
    T.StructField("tags_artist", T.StringType()),
])

TAGS_SCHEMA = T.StructType([
    T.StructField("booru", T.StringType()),
    T.StructField("fid", T.LongType()),
    T.StructField("tag", T.StringType()),
    T.StructField("tag_id", T.LongType()),
    T.StructField("tag_cat", T.IntegerType()),
    T.StructField("danb_fr", T.StringType()),
])


def read_raw_tsv(spark: SparkSession, path: str, columns) -> DataFrame:
    """All fields as text; header skipped per file; no quote handling; lines
    with a double quote anywhere dropped, fields beyond the columns included;
    empty and missing fields kept as ''."""
    lines = (spark.read.option("sep", "\u0001").option("header", "true").option("quote", "\u0000")
             .option("escape", "\u0000").option("enforceSchema", "true").schema("line string").csv(path))
    fields = F.split("line", "\t", -1)
    return (lines.where(~F.col("line").contains('"'))
            .select(*[F.coalesce(F.get(fields, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)]))


INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"


def _int(c: str, kind: str = "long"):
    """Integer affinity: integer text becomes a number, anything else NULL.

    Text that a number is written as is that number; only other text is held against
    the pattern, which costs more than the cast. Empty fields, which are many, are kept
    away from both. ``try_cast`` turns an out-of-range number into NULL.
    """
    col = F.col(c)
    number = col.try_cast(kind)
    return F.when(col == "", None).when(number.cast("string") == col, number).when(col.rlike(INTEGER_TEXT), number)


def files_from_raw(raw: DataFrame, shard: str) -> DataFrame:
    """Shape one shard of raw files rows into the ``files`` table."""
    parts = F.split(F.col("size"), "x", -1)
    width = lenient_int(F.coalesce(F.get(parts, 0), F.lit("")))
    height = lenient_int(F.coalesce(F.get(parts, 1), F.lit("")))
    return raw.select(
        "booru", _int("fid").alias("fid"), F.lit(shard).alias("shard"), "file_name",
        "torr_md5", "orig_ext", "orig_md5", _int("file_size").alias("file_size"),
        width.alias("img_width_torr"), height.alias("img_height_torr"),
        "jq", "torr_path", "tags_copyr", "tags_char", "tags_artist")


def tags_from_raw(raw: DataFrame) -> DataFrame:
    """Shape raw tags rows into the ``tags`` table."""
    return raw.select("booru", _int("fid").alias("fid"), "tag", _int("tag_id").alias("tag_id"),
                      _int("tag_cat", "int").alias("tag_cat"), "danb_fr")


def ingest_files(spark: SparkSession, shards: Iterable[tuple[str, str]]) -> DataFrame:
    """``shards`` = (shard name, files TSV path) pairs -> one files table."""
    out = None
    for name, path in shards:
        part = files_from_raw(read_raw_tsv(spark, path, RAW_FILES_COLUMNS), name)
        out = part if out is None else out.unionByName(part)
    return out


def ingest_tags(spark: SparkSession, paths: Iterable[str], dedup: bool = True) -> DataFrame:
    """Tags TSV paths -> one tags table; duplicate keys removed.

    The original removed *adjacent* duplicate lines of one shard; removing
    duplicates of the key everywhere is the superset that also satisfies the
    primary key. Of rows that differ in other columns the smallest in
    (tag_id, tag_cat, danb_fr) stays, nulls first, whatever order they come in.
    It is a partial + final aggregate keyed by (booru, fid, tag), so even a file
    with a huge number of repeated rows meets in one key only.
    """
    out = None
    for path in paths:
        part = tags_from_raw(read_raw_tsv(spark, path, RAW_TAGS_COLUMNS))
        out = part if out is None else out.unionByName(part)
    return unique_tags(out) if dedup else out


def unique_tags(rows: DataFrame) -> DataFrame:
    """One row per key of tags rows, as :func:`ingest_tags` says. The key holds the file, so that
    rows chosen by file can be chosen before, while they need no more than one exchange by file."""
    first = rows.groupBy("booru", "fid", "tag").agg(F.min(F.struct("tag_id", "tag_cat", "danb_fr")).alias("r"))
    return first.select("booru", "fid", "tag", "r.*")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                sort_by: list[str] | None = None, keep_others: bool = False) -> None:
    """Overwrite a Parquet table (the build starts from scratch, S19); with ``keep_others``
    only the values of ``partition_by`` that ``df`` holds, so that a shard that is built
    again replaces itself alone. No rows then replace nothing."""
    if keep_others and not partition_by:
        raise ValueError("keep_others needs partition_by")
    if sort_by:
        df = df.sortWithinPartitions(*partition_by or [], *sort_by)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if keep_others else "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
