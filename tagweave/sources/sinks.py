"""Writers for the list files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_prevalence_tsv(prevalence: DataFrame, path: str) -> None:
    """``prevalence<TAB>label`` lines, prevalence descending, label ascending.

    A global ``orderBy`` is a range-partitioned sort: each output part file is
    sorted and the parts are in order, so the part files concatenate into the
    ordered list.
    """
    (prevalence.orderBy(F.desc("prevalence"), F.asc("label"))
     .select(F.concat_ws("\t", F.col("prevalence").cast("string"), "label").alias("value"))
     .write.mode("overwrite").text(path))


def write_token_list(tokens: DataFrame, path: str, compression: str = "none") -> None:
    """One token per line in rank order (S12); Parquet with ``rank`` is the
    order-safe alternative (:func:`write_ranked`)."""
    tokens.orderBy("rank").select("token").write.mode("overwrite").text(path, compression=compression)


def write_ranked(tokens: DataFrame, path: str) -> None:
    tokens.write.mode("overwrite").parquet(path)


def write_metrics_json(summary: DataFrame, path: str) -> None:
    """Metrics as one JSON object with sorted keys."""
    cols = sorted(summary.columns)
    summary.select(F.to_json(F.struct(*cols)).alias("value")).coalesce(1) \
        .write.mode("overwrite").text(path)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write a stage to the shared folder and read it back (S18: a processed
    result cache that also cuts lineage)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
