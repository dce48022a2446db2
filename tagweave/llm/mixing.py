"""Mixing sources to target shares, fitted to the word.

A target is met by whole passes over a source plus a subset whose sizes fill what is
left. Only the histogram (source, size, documents) matters for that: every size gives
its share of documents, rounded down; a bounded knapsack by dynamic programming over
the sizes fills the small remaining budget as exactly as the sizes allow. Which
documents of a size are taken follows a seeded hash, cut at the exact count.

The histogram has at most as many rows per source as it has different sizes. Taking
the first documents of a size uses buckets of the hash: whole buckets below the cut,
ranks only inside the bucket that holds it, so no source or size is sorted in one
task.

Defined results: null text has size 0; null sources are one source that comes last;
documents of size 0 are never taken; rows that repeat are separate documents; an
empty table gives no rows; other columns are only carried by :func:`mixed_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_index
from .common import Stages, as_row, from_row

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
SEED = 20240601
#: Budgets up to this many words, and up to the largest size, are filled by dynamic programming.
BUDGET = 1 << 16
#: Documents per hash bucket, about.
BUCKET = 1024


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take: at most ``counts``, adding up to the
    largest total that is not over ``budget``. Sizes are positive and ascending."""
    taken = np.zeros(len(sizes), np.int64)
    # used[b]: documents of the current size that the first sum found at b needs; -1: not reached yet
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        size, count = int(sizes[i]), int(counts[i])
        if count <= 0 or size > budget:
            continue
        before = reached.copy()
        left = min(count, budget // size)
        step, from_here = 1, before
        while left > 0:  # binary parts of the count reach every number of documents up to it
            n = min(step, left)
            shifted = np.zeros_like(from_here)
            shifted[n * size :] = from_here[: budget + 1 - n * size]
            from_here = from_here | shifted
            left, step = left - n, step * 2
        new = from_here & ~before
        by[new] = i
        reached = from_here
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:  # a sum first reached with size i uses it until a sum reached earlier
        i = int(by[at])
        taken[i] += 1
        at -= int(sizes[i])
    return taken


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, limit: int = BUDGET) -> np.ndarray:
    """Documents of each size for a budget of at most the total: the share of each
    size, then large sizes while the rest is over ``limit``, then the knapsack."""
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), np.int64)
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= limit:
            break
        n = min(int(counts[i] - taken[i]), (rest - limit) // int(sizes[i]))
        taken[i] += n
        rest -= n * int(sizes[i])
    rest = min(rest, int((sizes * (counts - taken)).sum()))
    if rest > 0:
        taken += knapsack(sizes, counts - taken, rest)
    return taken


def source_targets(spark: SparkSession, sources: DataFrame, stages: Stages, weights: Sequence[float] = WEIGHTS,
                   share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources(source, source_size)`` -> with ``target``: ``share`` of all sizes, split by
    the weights that repeat over the sources in code point order (null last); a target
    stops at ``most`` times its source's size and the excess is shared again."""
    keyed = sources.withColumn("last", F.col("source").isNull().cast("int"))
    ranked = global_index(keyed, bucket=[F.col("last"), F.coalesce(F.substring("source", 1, 2), F.lit(""))],
                          order=[F.col("source")], out="rank", non_null_buckets=True)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
    ranked = stages.write(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "ranked")
    budget = share * float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, wanted = -1.0, F.least("cap", F.col("weight") * F.lit(0.0))
    while True:  # the level rises until no further source is above its cap
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        capped, open_weight = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not open_weight or (rises := (budget - capped) / open_weight) <= level:
            break
        level = rises
    wanted = F.least(F.col("cap"), F.col("weight") * F.lit(max(level, 0.0)))
    return ranked.select("source", "source_size", wanted.alias("target"))


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    rows["more"] = fit_counts(rows["size"].to_numpy(np.int64), rows["docs"].to_numpy(np.int64), int(rows["budget"].iloc[0]))
    return rows[["source", "size", "docs", "more"]]


def mix(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: ``doc_id, size, source,
    source_size, target, taken`` and the keys ``h`` and ``t1`` that name the row."""
    stages = Stages(spark, "mix")
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.coalesce(size, F.lit(0)).cast("bigint").alias("size"), F.xxhash64("text").alias("t1"))
    sized = stages.write(sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "t1")), "sized")
    histogram = stages.write(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "histogram")
    sources = stages.write(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), "sources")
    targets = stages.write(source_targets(spark, sources, stages, weights, share, most), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = targets.withColumn("passes", passes).withColumn("budget", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("bigint"))
    wanted = histogram.join(plan, histogram["source"].eqNullSafe(plan["source"])).where("size > 0").select(plan["source"], "size", "docs", "budget")
    more = wanted.groupBy("source").applyInPandas(_fit, "source string, size bigint, docs bigint, more bigint")
    # The first `more` documents of each (source, size) in hash order, through buckets of the hash.
    cells = (stages.write(more, "more").withColumn("n_buckets", F.ceil(F.col("docs") / BUCKET).cast("bigint"))
             .select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("z"), "size", "more", "docs", "n_buckets"))
    # A cell with nothing or everything to take needs no ranks.
    rows = sized.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("z", F.col("source").isNull())
    named = ["s", "z", "size"]
    dealt = stages.write(rows.join(cells, named, "left").withColumn("bucket", F.pmod("h", F.coalesce("n_buckets", F.lit(1)))), "dealt")
    partial = dealt.where("more > 0 and more < docs")
    counts = partial.groupBy(*named, "bucket", "more").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*named).orderBy("bucket"))  # one row per bucket of a cell
    cut = counts.withColumn("upto", upto).where((F.col("upto") - F.col("n") < F.col("more")) & (F.col("upto") >= F.col("more")))
    cut = stages.write(cut.select(*named, F.col("bucket").alias("cut"), (F.col("more") - F.col("upto") + F.col("n")).alias("left")), "cut")
    edge = partial.join(cut, named).where("bucket = cut").withColumn("nth", F.row_number().over(Window.partitionBy(*named).orderBy("h", "doc_id", "t1")))
    out_columns = ["doc_id", "source", "size", "t1", "h", "s", "z"]
    chosen = edge.select(*out_columns, (F.col("nth") <= F.col("left")).cast("bigint").alias("extra"))
    plain = dealt.where("more is null or more = 0 or more = docs").select(*out_columns, F.when(F.col("more") > 0, 1).otherwise(0).cast("bigint").alias("extra"))
    beside = partial.join(cut, named).where("bucket <> cut").select(*out_columns, (F.col("bucket") < F.col("cut")).cast("bigint").alias("extra"))
    picked = plain.union(chosen).union(beside)
    info = plan.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("z"), "source_size", "target", "passes")
    return (picked.join(info, ["s", "z"])
            .select("doc_id", "size", "source", "source_size", "target", ((F.col("passes") + F.col("extra")) * F.col("size")).alias("taken"), "h", "t1"))


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns."""
    picked = mix(spark, docs, **options).where("taken > 0")
    # Equal rows are taken in equal or different numbers; together they give their sum.
    times = picked.groupBy("doc_id", "t1", "source").agg(F.sum(F.floor(F.col("taken") / F.col("size"))).alias("times"), F.count(F.lit(1)).alias("n"))
    times = times.select(F.col("doc_id").alias("d"), F.col("t1").alias("t"), F.col("source").alias("s"), "times", "n")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t1"), F.col("source").cast("string").alias("source"), as_row(docs))
    joined = keyed.join(times, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("t")) & F.col("source").eqNullSafe(F.col("s")))
    # Rows that share the key share out what they take, in the order of a hash of all their columns.
    nth = F.row_number().over(Window.partitionBy("d", "t", "s").orderBy(F.xxhash64("row")))
    single = joined.where("n = 1").select("row", F.col("times").alias("copies"))
    shared = joined.where("n > 1").withColumn("nth", nth).select("row", (F.floor(F.col("times") / F.col("n")) + (F.col("nth") <= F.pmod("times", "n")).cast("bigint")).alias("copies"))
    copies = single.union(shared).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return from_row(copies, docs.columns)
