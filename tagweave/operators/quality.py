"""Integrity checks implied by the table definitions.

Each check is a report DataFrame (empty when clean), computed with one
aggregation or one anti join -- never by collecting keys to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE_KEY = ["booru", "fid"]
TAG_KEY = ["booru", "fid", "tag"]


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their multiplicity."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def dedup_on_key(df: DataFrame, key: list[str], order_by: list | None = None) -> DataFrame:
    """Keep one row per key (S3 / X1 "first row wins").

    Without an order any row may win (``dropDuplicates``: a partial + final
    aggregate). With ``order_by`` the first row in that order wins; the window
    is partitioned by the key, so only rows of one key meet in a task.
    """
    if not order_by:
        return df.dropDuplicates(key)
    w = Window.partitionBy(*key).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def orphan_tags(tags: DataFrame, files: DataFrame) -> DataFrame:
    """Tag rows whose file does not exist (X2: declared foreign key)."""
    return tags.join(files.select(*FILE_KEY), FILE_KEY, "left_anti")


def cascade_tags(tags: DataFrame, files: DataFrame) -> DataFrame:
    """Tags restricted to existing files (what an enforced cascade keeps)."""
    return tags.join(files.select(*FILE_KEY), FILE_KEY, "left_semi")


def null_counts(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """NULL count per not-null column (X3), one aggregate pass, long format."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls"))
                      for c in columns])
    return agg.select(F.lit(table).alias("table_name"), F.inline(pairs))
