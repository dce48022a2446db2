"""Feature encoding and evaluation aggregates.

Multi-hot encodings are produced in sparse coordinate form
``(row, label_id, value)`` by one keyed aggregation -- the scalable form;
:func:`densify` turns them into fixed-width arrays when the label space is
small enough for that to make sense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running_sum
from .tokenize import Vocabulary, _side


def label_ordinals(rows: DataFrame, row_col: str, label_col: str, vocab: Vocabulary) -> DataFrame:
    """Label -> ordinal by vocabulary lookup, unknown -> ``<unk>``."""
    side = _side(vocab, [F.col("token").alias(label_col), F.col("id").alias("label_id")])
    return (rows.select(row_col, label_col).join(side, label_col, "left")
            .select(row_col, label_col,
                    F.coalesce("label_id", F.lit(vocab.unk_id)).alias("label_id")))


def multi_hot_counts(coords: DataFrame, row_col: str) -> DataFrame:
    """Sum of ones per (row, label); repeated labels add up."""
    return coords.groupBy(row_col, "label_id").agg(F.count(F.lit(1)).cast("long").alias("value"))


def multi_hot_flags(coords: DataFrame, row_col: str) -> DataFrame:
    """Boolean multi-hot; repeats are or-ed."""
    return coords.groupBy(row_col, "label_id").agg(F.lit(True).alias("value"))


def densify(sparse: DataFrame, row_col: str, width: int, zero=0) -> DataFrame:
    """Fixed-width vector per row from its coordinates (E3, dense form)."""
    per_row = sparse.groupBy(row_col).agg(
        F.map_from_entries(F.collect_list(F.struct("label_id", "value"))).alias("_m"))
    return per_row.select(row_col, F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.coalesce(F.element_at("_m", i), F.lit(zero))).alias("vector"))


def example_metrics(scored: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Per row: cross-entropy (log-sum-exp minus the label's logit) and accuracy
    (arg-max equals label) from a logit array (A22)."""
    lg = F.transform(logits, lambda x: x.cast("double"))
    # The maximum is referenced inside a lambda: bind it as a column first.
    df = scored.withColumn("_lg", lg).withColumn("_top", F.array_max("_lg"))
    lse = F.col("_top") + F.log(F.aggregate("_lg", F.lit(0.0).cast("double"),
                                           lambda acc, x: acc + F.exp(x - F.col("_top"))))
    picked = F.get("_lg", F.col(label))
    argmax = F.array_position("_lg", F.col("_top")) - 1
    return (df.withColumn("loss", lse - picked)
            .withColumn("accuracy", (argmax == F.col(label)).cast("double"))
            .drop("_lg", "_top"))


def batch_metrics(metrics: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Mean loss / accuracy per batch, then their mean over batches."""
    per_batch = metrics.groupBy(batch_col).agg(F.avg("loss").alias("loss"),
                                               F.avg("accuracy").alias("accuracy"))
    return per_batch.agg(F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"),
                         F.count(F.lit(1)).alias("batches"))


def metrics_json(summary: DataFrame) -> DataFrame:
    """One JSON line with keys in sorted order."""
    cols = sorted(summary.columns)
    return summary.select(F.to_json(F.struct(*cols)).alias("value"))


def captions_seen(per_batch: DataFrame, batch_col: str = "batch_id",
                  n_col: str = "n") -> DataFrame:
    """Running count of captions seen after each batch."""
    return running_sum(per_batch, batch_col, n_col, out="seen")


def embedding_width(vocab_size: int, base_width: int = 512, base_vocab: int = 32100) -> int:
    """Embedding width scaled to the vocabulary: ``ceil(base_width / base_vocab * V)`` (F16)."""
    import math
    return math.ceil(base_width / base_vocab * vocab_size)
