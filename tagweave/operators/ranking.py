"""Dense global positions without a one-partition sort (recipe R1).

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row to
one task. :func:`range_index` deals rows out by ranges of the sort key instead, stores
them sorted, and adds the row counts of the earlier ranges: one shuffle, and a table of
offsets no longer than the number of ranges, whatever the values.

:func:`global_index` serves where a natural bucket is at hand:

1. give each row an order-preserving *bucket* (a coarse prefix of the sort
   key: sorting by bucket never contradicts sorting by the full key);
2. count rows per bucket -- a partial + final aggregate, result bounded by the
   number of buckets;
3. exclusive running sum of the bucket counts over the small bucket table;
4. ``row_number() OVER (PARTITION BY bucket ORDER BY key)`` plus the bucket
   offset.

The result is exactly the global ``row_number() - 1`` and is deterministic on
recomputation (no ``spark_partition_id`` / ``monotonically_increasing_id``).
Buckets should be many and even (hash-like prefixes are ideal); a skewed
bucket is still correct, only slower in its one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_stage


def global_index(df: DataFrame, bucket: Column | Sequence[Column], order: Sequence[Column],
                 bucket_order: Sequence[Column] | None = None, out: str = "idx",
                 bucket_bound: int | None = None, restart_on: int = 0,
                 non_null_buckets: bool = False) -> DataFrame:
    """Add ``out`` = 0-based position of each row in ``order``.

    ``bucket`` is one or more columns that are a prefix of the order;
    ``bucket_order`` orders the buckets consistently with ``order`` (default:
    ascending, NULLs first). ``bucket_bound``, when the number of buckets is
    bounded by construction (e.g. 16^k hex prefixes), allows an explicit
    broadcast of the offset table; otherwise AQE picks the join by measured size.
    ``restart_on=k`` makes positions restart at 0 for each value of the first
    ``k`` bucket columns (per-group positions, e.g. per split or per epoch).
    ``non_null_buckets`` is the caller's guarantee that no bucket is NULL even
    where the schema allows it (e.g. after a checkpoint): the offsets then
    join on the plain bucket columns, i.e. on the window's partitioning.
    """
    buckets = list(bucket) if isinstance(bucket, (list, tuple)) else [bucket]
    names = [f"_b{i}" for i in range(len(buckets))]
    with_b = df.select("*", *[b.alias(n) for b, n in zip(buckets, names)])
    b_order = list(bucket_order) if bucket_order else [F.col(n).asc_nulls_first() for n in names]

    counts = with_b.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    # The bucket table is small (bounded by the number of buckets): the
    # un-partitioned window over it is the only single-task step.
    running = (Window.partitionBy(*names[:restart_on]).orderBy(*b_order[restart_on:] or b_order)
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*names, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_off"))

    # Number rows inside their bucket first (the one shuffle of the big side,
    # by bucket), then add the bucket offset: with non-null buckets the join
    # key equals the window's partitioning, so only the small table moves.
    w = Window.partitionBy(*names).orderBy(*order)
    numbered = with_b.withColumn("_rn", F.row_number().over(w))
    nullable = not non_null_buckets and any(with_b.schema[n].nullable for n in names)
    if nullable:
        side = offsets.select(*[F.col(n).alias(n + "_o") for n in names], "_off")
        if bucket_bound is not None:
            side = F.broadcast(side)
        joined = numbered.join(side, _null_safe_on(names)).drop(*[n + "_o" for n in names])
    else:
        side = F.broadcast(offsets) if bucket_bound is not None else offsets
        joined = numbered.join(side, names)
    return (joined.withColumn(out, F.col("_off") + F.col("_rn") - 1)
            .drop(*names, "_off", "_rn"))


def _null_safe_on(names):
    cond = None
    for n in names:
        c = F.col(n).eqNullSafe(F.col(n + "_o"))
        cond = c if cond is None else cond & c
    return cond


#: Place of a stored row: 33 low bits count rows inside a range, the bits above name it.
PLACE, RANGE_BITS = "_place", 33


def stored_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` dealt out by ranges of ``order``, sorted, and written with each row's ``_place``
    (range number, then position inside the range). Spark samples the range bounds, so
    ranges are even whatever the values; equal keys alone share a range. Once written, a
    place does not change."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written_stage(ranges.withColumn(PLACE, F.monotonically_increasing_id()), "ranges")


def range_offsets(stored: DataFrame, *sums: str) -> DataFrame:
    """One row per range: ``_range``, ``_before`` (rows of all earlier ranges) and, per column
    of ``sums``, ``<column>_before`` (its sum there). The running sum is over the ranges,
    which are no more than the shuffle's partitions."""
    per_range = stored.groupBy(F.shiftright(PLACE, RANGE_BITS).alias("_range")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    return per_range.select("_range", total("_rows").alias("_before"), *[total(f"_s_{c}").alias(f"{c}_before") for c in sums])


def with_position(stored: DataFrame, out: str = "idx") -> DataFrame:
    """Rows of :func:`stored_ranges` with ``out``, the 0-based position over all ranges."""
    offsets = F.broadcast(range_offsets(stored))  # one row per range
    placed = stored.withColumn("_range", F.shiftright(PLACE, RANGE_BITS)).join(offsets, "_range")
    inside = F.col(PLACE).bitwiseAND(F.lit((1 << RANGE_BITS) - 1))
    return placed.withColumn(out, F.col("_before") + inside).drop("_range", "_before", PLACE)


def range_index(df: DataFrame, order: Sequence[Column], out: str = "idx", restart_on: Sequence[str] = ()) -> DataFrame:
    """Add ``out`` = 0-based position of each row in ``order`` by one range shuffle, with an
    offset per range. ``restart_on`` names leading columns of ``order``, never null, whose
    values each begin at 0 again (per-group positions, such as splits or epochs: few): the first
    position of a group is found by a partial and a final minimum, and the groups are sent to
    the rows, so that rows of one group are not brought into one task."""
    placed = with_position(stored_ranges(df, order), out)
    if not restart_on:
        return placed
    firsts = placed.groupBy(*restart_on).agg(F.min(out).alias("_first"))
    return placed.join(F.broadcast(firsts), list(restart_on)).withColumn(out, F.col(out) - F.col("_first")).drop("_first").select(*df.columns, out)


def ordered_index(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """0-based position of every row in ``col`` order (``col`` should be a key)."""
    return range_index(df, [F.col(col)], out)


def running_sum(df: DataFrame, order_col: str, value_col: str, out: str = "running",
                block: int = 4096) -> DataFrame:
    """Inclusive running sum of ``value_col`` in ``order_col`` order.

    Two-level like :func:`global_index`: block sums, an exclusive running sum
    over the (small) block table, then a window inside each block.
    """
    blk = F.floor(F.col(order_col) / block)
    with_b = df.withColumn("_blk", blk)
    sums = with_b.groupBy("_blk").agg(F.sum(value_col).alias("_s"))
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_blk").alias("_blk_o"),
                          F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return (with_b.join(offsets, F.col("_blk") == F.col("_blk_o"))
            .withColumn(out, F.col("_base") + F.sum(value_col).over(w))
            .drop("_blk", "_blk_o", "_base"))
