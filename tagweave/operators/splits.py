"""Deterministic order, dataset splits, batches and epochs.

The file order is MD5 of the torrent hash (NULLs first) then key. The
position in that order comes from the range index of
:mod:`tagweave.operators.ranking`: ranges are even also where many files have no hash.
Split membership and in-split positions are then pure arithmetic on that index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CaptionConfig
from ..functions.random import hash_key
from .ranking import range_index

KEY = ["booru", "fid"]


def md5_index(files: DataFrame, out: str = "idx") -> DataFrame:
    """Position of each file in (torr_md5 NULLS FIRST, booru, fid) order (O1, W1). Files
    without a hash are ranges of their own keys like all others."""
    return range_index(files, [F.col("torr_md5").asc_nulls_first(), F.col("booru").asc(), F.col("fid").asc()], out)


def files_from_nth(indexed: DataFrame, start: int) -> DataFrame:
    """Ordered offset to the end (O2): rows at or after position ``start``."""
    return indexed.where(F.col("idx") >= start)


def assign_splits(indexed: DataFrame, cfg: CaptionConfig = CaptionConfig()) -> DataFrame:
    """Add ``split`` and ``split_idx``.

    * test: the first ``test_quantity`` files;
    * the rest is re-numbered from 0 (``j``) and goes to validation when
      ``j % 100 < validation_pct`` (``reference_split`` swaps the two names);
    * ``validation_pct`` None puts the whole rest into train (W3).

    ``split_idx`` (position inside the split, in file order) is closed-form:
    validation items before ``j`` are ``floor(j/100)*pct + min(j % 100, pct)``.
    """
    n, pct = cfg.test_quantity, cfg.validation_pct
    idx = F.col("idx")
    j = idx - F.lit(n)
    if pct is None:
        split = F.when(idx < n, "test").otherwise("train")
        split_idx = F.when(idx < n, idx).otherwise(j)
    else:
        keep = (j % 100) < pct
        first, second = ("train", "validation") if cfg.reference_split else ("validation", "train")
        split = F.when(idx < n, "test").when(keep, first).otherwise(second)
        kept_before = F.floor(j / 100) * pct + F.least(j % 100, F.lit(pct))
        split_idx = (F.when(idx < n, idx).when(keep, kept_before)
                     .otherwise(j - kept_before))
    return indexed.withColumn("split", split).withColumn("split_idx", split_idx.cast("long"))


def slice_percent(indexed: DataFrame, n: int, lo_pct: float | None,
                  hi_pct: float | None) -> DataFrame:
    """Contiguous slice ``[lo%:hi%]`` of an indexed set of ``n`` rows.

    Bounds are rounded like dataset slicing: ``round(n * p / 100)``, half to
    even (Python's ``round``).
    """
    lo = 0 if lo_pct is None else round(n * lo_pct / 100)
    hi = n if hi_pct is None else round(n * hi_pct / 100)
    return indexed.where((F.col("idx") >= lo) & (F.col("idx") < hi))


def renumber(df: DataFrame, group: str = "split", order: str = "split_idx",
             out: str = "pos") -> DataFrame:
    """Dense 0-based position per ``group`` in ``order`` after rows were dropped.
    ``group`` and ``order`` must not be NULL (true for splits and in-split positions)."""
    return range_index(df, [F.col(group), F.col(order)], out, restart_on=[group])


def batches(df: DataFrame, batch_size: int, pos: str = "pos") -> DataFrame:
    """Sequential batches, last partial batch kept."""
    return df.withColumn("batch_id", F.floor(F.col(pos) / batch_size).cast("long")) \
             .withColumn("pos_in_batch", (F.col(pos) % batch_size).cast("int"))


def host_shard(df: DataFrame, batch_size: int, hosts: int) -> DataFrame:
    """Host slice of each batch: equal parts, host i takes part i."""
    per_host = batch_size // hosts
    return df.withColumn("host", F.floor(F.col("pos_in_batch") / per_host).cast("int"))


def epochs(df: DataFrame, n_epochs: int, count: int, pos: str = "pos") -> DataFrame:
    """Repeat a numbered set ``n_epochs`` times (W8): ``epoch`` and the running
    position ``epoch * count + pos``. A generator column, not a join."""
    return (df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))))
            .withColumn("run_pos", F.col("epoch") * count + F.col(pos)))


def epoch_batches(df: DataFrame, batch_size: int) -> DataFrame:
    """Batches over the running position; a batch straddling two epochs takes
    the epoch of its first element (W8)."""
    from pyspark.sql import Window
    b = df.withColumn("batch_id", F.floor(F.col("run_pos") / batch_size).cast("long"))
    w = Window.partitionBy("batch_id")
    return b.withColumn("batch_epoch", F.min("epoch").over(w))


def permutation_index(df: DataFrame, seed: int, epoch_col: str = "epoch", id_col: str = "pos",
                      out: str = "perm") -> DataFrame:
    """Per-epoch random permutation (O11): position in ``md5(seed|epoch|id)`` order."""
    keyed = df.withColumn("_h", hash_key(seed, F.col(epoch_col), F.col(id_col)))
    return range_index(keyed, [F.col(epoch_col), F.col("_h"), F.col(id_col)], out, restart_on=[epoch_col]).drop("_h")


def wraparound(df: DataFrame, count: int, limit: int, pos: str = "pos") -> DataFrame:
    """Endless repetition of a numbered set cut at ``limit`` rows (W9): the
    running position without an epoch column."""
    n_epochs = max(1, -(-limit // max(count, 1)))
    return epochs(df, n_epochs, count, pos).where(F.col("run_pos") < limit).drop("epoch")
