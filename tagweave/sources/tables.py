"""Reading the driver's parquet tables and deriving the tag corpus from them.

The tag corpus (``files``, ``tags``, ``frame_counts``) is the data model of
the pipeline. The driver ships TPC-H-like tables instead, so the corpus is
derived from them with the same expressions the SQL oracle uses
(``tagweave.plans.oracle_sql.CORPUS_CTES``). The derivation only produces rows in
the corpus schema; every operator downstream works on any data of that schema.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CAT_ARTIST, CAT_CHARACTER, CAT_FRANCHISE, CAT_GENERAL
from .store import RESULTS, buckets_for, write_bucketed


KEY = ("booru", "fid")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan with an explicit projection (column pruning at the scan)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


@dataclass
class TagCorpus:
    files: DataFrame
    tags: DataFrame
    frame_counts: DataFrame

    @property
    def file_keys(self) -> DataFrame:
        return self.files.select(*KEY)


def files_from_orders(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.select(
        F.col("o_orderpriority").alias("booru"),
        key.alias("fid"),
        F.when(key % 10 < 5, F.lit("2021")).otherwise(F.lit("2022")).alias("shard"),
        F.concat(key.cast("string"), F.lit(".png")).alias("file_name"),
        F.when(key % 97 == 0, F.lit(None).cast("string"))
        .otherwise(F.md5(key.cast("string"))).alias("torr_md5"),
    )


def tags_from_lineitems(lineitem: DataFrame, orders: DataFrame, part: DataFrame,
                        supplier: DataFrame, nation: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per (file, tag): eight tag expressions over the line items.

    ``supplier`` and ``nation`` are dimension tables (AQE broadcasts them by
    measured size); ``orders`` and ``part`` join by shuffle on their keys. With ``buckets``
    the line items are dealt out by file into so many parts first, so that the tags, some
    six times as many, are made unique and stored where they arise: in the order of their
    storing, so that no hash table holds a part's tags and the writer finds them sorted.
    """
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
    od = orders.select("o_orderkey", "o_orderpriority")
    pt = part.select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    sp = supplier.select("s_suppkey", "s_name", "s_nationkey")
    nt = nation.select("n_nationkey", "n_name")
    joined = (li.join(od, li.l_orderkey == od.o_orderkey)
              .join(pt, li.l_partkey == pt.p_partkey)
              .join(sp, li.l_suppkey == sp.s_suppkey)
              .join(nt, sp.s_nationkey == nt.n_nationkey))
    name_ = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    nation_ = F.lower("n_name")
    size = F.col("p_size")

    def tag(expr, cat, cond=None):
        value = expr if cond is None else F.when(cond, expr)
        return F.struct(value.alias("tag"), F.lit(cat).alias("tag_cat"))

    candidates = F.array(
        tag(name_, CAT_GENERAL),
        tag(F.col("p_type"), CAT_GENERAL),
        tag(F.concat(name_, F.lit("_("), F.lower("p_type"), F.lit(")")), CAT_GENERAL, size % 5 == 0),
        tag(F.concat(nation_, F.lit("_(cosplay)")), CAT_GENERAL, size % 7 == 0),
        tag(F.lit("=_="), CAT_GENERAL, size % 11 == 0),
        tag(F.lower("p_brand"), CAT_ARTIST),
        tag(nation_, CAT_FRANCHISE),
        tag(F.lower("s_name"), CAT_CHARACTER),
    )
    named = joined.select(F.col("o_orderpriority").alias("booru"), F.col("l_orderkey").alias("fid"),
                          "p_name", "p_type", "p_brand", "p_size", "s_name", "n_name")
    if buckets is not None:
        named = named.repartition(buckets, *KEY).sortWithinPartitions(*KEY)
    rows = named.select(*KEY, F.inline(candidates)).where(F.col("tag").isNotNull())
    danb_fr = F.lit(None).cast("string")
    if buckets is None:
        unique = rows.distinct().withColumn("danb_fr", danb_fr)
    else:
        # The first text of a group is kept by an aggregate over sorted rows, which leaves them sorted.
        unique = rows.groupBy(*KEY, "tag", "tag_cat").agg(F.first(danb_fr).alias("danb_fr"))
    return unique.select("booru", "fid", "tag", F.lit(None).cast("bigint").alias("tag_id"), "tag_cat", "danb_fr")


def frame_counts_from_lineitems(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    per_order = lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("frames"))
    od = orders.select("o_orderkey", "o_orderpriority")
    return (per_order.join(od, per_order.l_orderkey == od.o_orderkey)
            .select(F.col("o_orderpriority").alias("booru"), F.col("l_orderkey").alias("fid"),
                    F.col("frames").cast("int").alias("frames")))


def derive_tag_corpus(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> TagCorpus:
    """The corpus as a lazy plan over the driver tables; with ``buckets`` tags lie by file."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    lineitem = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
                          "l_quantity")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    supplier = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return TagCorpus(
        files=files_from_orders(orders),
        tags=tags_from_lineitems(lineitem, orders, part, supplier, nation, buckets),
        frame_counts=frame_counts_from_lineitems(lineitem, orders),
    )


SOURCES = ("orders", "lineitem", "part", "supplier", "nation")


def table_paths(sf_dir: str, *names: str) -> list[str]:
    return [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in names]


class StoredCorpus:
    """The corpus tables, each written when it is first asked for and read back after that."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, field: str, order: tuple[str, ...] = (), dealt: bool = False, overwrite: bool = False) -> DataFrame:
        def build(folder: str, files: list) -> str:
            n = buckets_for(self.spark, files)
            derived = derive_tag_corpus(self.spark, self.sf_dir, n)
            return write_bucketed(getattr(derived, field), f"{folder}/{field}", KEY, n, order, dealt)

        return self.spark.table(RESULTS.get(self.spark, f"corpus-{field}", table_paths(self.sf_dir, *SOURCES), build, overwrite=overwrite))

    @property
    def files(self) -> DataFrame:
        return self.table("files")

    @property
    def file_keys(self) -> DataFrame:
        """``booru, fid`` of the files alone, for what reads no more: names and hashes take most
        of a file's row and hardly compress."""
        return self.table("file_keys")

    @property
    def tags(self) -> DataFrame:
        return self.table("tags", ("tag",), dealt=True)

    @property
    def frame_counts(self) -> DataFrame:
        return self.table("frame_counts")


def tag_corpus(spark: SparkSession, sf_dir: str, overwrite: bool = False) -> StoredCorpus:
    """The corpus tables, built once per application and input and read back.

    The (derived) corpus is written as tables bucketed and sorted by file key, in the
    shared folder: a lost executor re-reads files instead of recomputing joins, joins and
    groupings by file need no exchange, and scans prune columns and take filters. A query
    that reads one of the tables waits for that one alone; ``overwrite`` builds all again.
    """
    corpus = StoredCorpus(spark, sf_dir)
    if overwrite:
        corpus.table("files", overwrite=True)
        corpus.table("file_keys", overwrite=True)
        corpus.table("tags", ("tag",), dealt=True, overwrite=True)
        corpus.table("frame_counts", overwrite=True)
    return corpus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text")
