"""Links between near-equal vectors by iterative quantisation.

A rotation of the principal directions is learned, on a bounded sample, so that the
signs of the rotated coordinates are balanced codes of up to 64 bits that keep
angles. Codes are cut into four parts; a vector is filed, per part, under the part
itself and under its neighbours at a few flipped bits, so two vectors meet in a
multi-index table when any part differs in ``probe`` bits or less. Pairs within the
Hamming radius are reranked by the cosine of the original vectors in double
precision. Radius and probe are calibrated on the sample: vectors turned by exactly the
cosine's angle stay within the radius in 99.5 of 100 cases and meet in 99. They are
turned in random directions, towards other vectors of the sample and towards the
nearest ones, as codes see more of turns that lie where the data lie; the widest of
the three counts. Where even ``MOST_PROBE`` bits are too few, all vectors of a label meet.

Only vectors with the same label (and length) are compared. Equal vectors are
reduced to one class first and counted, so copies are never paired; only links
between different vectors are.

Defined results: vectors that are null, zero or hold null or non-finite numbers, and
vectors without a label or id, link with nothing; repeated ids are separate vectors
for counting links; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages
from .graph import connected_components

COSINE = 0.93
#: Vectors the rotation is fitted on, at most.
SAMPLE = 8192
BITS, PARTS, ROUNDS, SEED = 64, 4, 30, 20240601
#: Turned vectors per kind of direction, shares of them that the radius and the tables hold.
TURNS, WITHIN, MEET = 4096, 0.995, 0.99
#: Bits of a part, in SQL.
WIDTH = f"cast(ceil(least({BITS}, dims) / {PARTS}) as int)"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. They are first divided by their largest number, so that squares
    of very small or large numbers neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Quantiser:
    """Mean, rotation, Hamming radius and probe for vectors of one length."""

    def __init__(self, mean: np.ndarray, rotation: np.ndarray, radius: int, probe: int = 2):
        self.mean, self.rotation, self.radius, self.probe = mean, rotation, radius, probe

    @classmethod
    def fit(cls, vectors: np.ndarray, cosine: float, bits: int = BITS) -> "Quantiser":
        rng = np.random.default_rng(SEED)
        x = unit(vectors)
        dims = x.shape[1]
        bits = min(bits, dims)
        mean = x.mean(axis=0)
        _, _, axes = np.linalg.svd(x - mean, full_matrices=False) if len(x) > 1 else (0, 0, np.eye(dims))
        if len(axes) < bits:  # fewer vectors than dimensions: any complement will do
            axes = np.linalg.qr(np.vstack([axes, rng.standard_normal((dims, dims))]).T)[0].T
        axes = axes[:bits].T
        rotation = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
        seen = (x - mean) @ axes
        for _ in range(ROUNDS):  # codes for the rotation, then the rotation for the codes
            u, _, vt = np.linalg.svd(np.where(seen @ rotation >= 0, 1.0, -1.0).T @ seen)
            rotation = (u @ vt).T
        out = cls(mean, axes @ rotation, bits)
        out.radius, out.probe = 0, 0
        width = -(-bits // PARTS)
        for probe, away in _directions(x, rng) if dims > 1 else ():
            away = away - (away * probe).sum(axis=1, keepdims=True) * probe
            norm = np.linalg.norm(away, axis=1, keepdims=True)
            some = norm[:, 0] > 1e-6  # not towards a copy
            if not some.any():
                continue
            turned = cosine * probe[some] + np.sqrt(1 - cosine**2) * away[some] / norm[some]
            flips = out.signs(probe[some]) != out.signs(turned)
            least = np.min([flips[:, i * width : (i + 1) * width].sum(axis=1) for i in range(PARTS)], axis=0)
            out.radius = max(out.radius, int(np.quantile(flips.sum(axis=1), WITHIN, method="higher")))
            out.probe = max(out.probe, int(np.quantile(least, MEET, method="higher")))
        return out

    def signs(self, unit_vectors: np.ndarray) -> np.ndarray:
        return (unit_vectors - self.mean) @ self.rotation >= 0

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as signed 64-bit numbers, the first bit lowest."""
        signs = self.signs(unit(vectors))
        padded = np.zeros((len(signs), 64), np.uint8)
        padded[:, : signs.shape[1]] = signs
        return np.packbits(padded, axis=1, bitorder="little").view("<i8").reshape(-1)


def _directions(x: np.ndarray, rng) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors of the sample ``x`` and directions to turn them in: any, towards
    another vector, towards the nearest one that is no copy."""
    probe = x[rng.integers(0, len(x), TURNS)]
    yield probe, rng.standard_normal(probe.shape)
    yield probe, x[rng.integers(0, len(x), TURNS)] - probe
    probe = x[rng.permutation(len(x))[: TURNS // 4]]
    near = probe @ x.T
    near[near > 1 - 1e-9] = -2.0
    yield probe, x[near.argmax(axis=1)] - probe


def _masks(width: int, flips: int) -> list[int]:
    """The numbers of ``width`` bits with ``flips`` bits set or fewer."""
    return [sum(1 << b for b in bits) for n in range(min(flips, width) + 1) for bits in combinations(range(width), n)]


def _encode(batches: Iterator[pd.DataFrame], models) -> Iterator[pd.DataFrame]:
    for rows in batches:
        codes = np.zeros(len(rows), np.int64)
        for dims, at in rows.groupby("dims").indices.items():
            codes[at] = models.value[dims].codes(np.vstack(rows["vector"].iloc[at].to_numpy()).astype(np.float64))
        yield pd.DataFrame({"rep": rows["rep"], "label": rows["label"], "dims": rows["dims"], "code": codes})


def _rerank(batches: Iterator[pd.DataFrame], cosine: float) -> Iterator[pd.DataFrame]:
    for rows in batches:
        keep = np.zeros(len(rows), bool)
        for _, at in rows.groupby(rows["va"].map(len)).indices.items():
            a, b = (np.vstack(rows[c].iloc[at].to_numpy()).astype(np.float64) for c in ("va", "vb"))
            a, b = (v / np.abs(v).max(axis=1, keepdims=True) for v in (a, b))
            keep[at] = (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)) >= cosine
        yield rows.loc[keep, ["a", "b"]]


def fit_quantisers(classes: DataFrame, cosine: float, sample: int = SAMPLE) -> dict[int, Quantiser]:
    """One quantiser per length of vector, from the first ``sample`` vectors of each
    length in a seeded order; collects that many vectors at most per length."""
    out = {}
    for (dims,) in classes.select("dims").distinct().collect():
        rows = classes.where(F.col("dims") == dims).orderBy(F.xxhash64("rep", F.lit(SEED)), "rep").limit(sample).select("vector").toArrow()
        out[dims] = Quantiser.fit(np.vstack(rows["vector"].to_numpy()).astype(np.float64), cosine)
    return out


def _filed(codes: DataFrame, flips: dict[int, int]) -> DataFrame:
    """A row of ``codes`` per part and value within ``flips[dims]`` bits of it."""
    files = None
    for part in range(PARTS):
        value = F.expr(f"shiftrightunsigned(code, {part} * {WIDTH}) & (shiftleft(1L, {WIDTH}) - 1)")
        near = F.array().cast("array<bigint>")
        for dims, n in flips.items():
            masks = _masks(-(-min(BITS, dims) // PARTS), n)
            there = F.transform(F.lit(np.array(masks, np.int64)), lambda mask: value.bitwiseXOR(mask))
            near = F.when(F.col("dims") == dims, there).otherwise(near)
        one = codes.select("label", "dims", F.lit(part).alias("part"), F.explode(near).alias("value"), "rep", "code", "radius")
        files = one if files is None else files.union(one)
    return files


def vector_links(spark: SparkSession, vectors: DataFrame, stages: Stages, cosine: float = COSINE, sample: int = SAMPLE):
    """``(classes, links)``: ``classes(rep, label, dims, h1, h2, vector, n)`` of equal
    vectors and ``links(a, b)`` between their representatives, a < b."""
    classes = (_valid(vectors).groupBy("label", "dims", "h1", "h2")
               .agg(F.min("vec_id").alias("rep"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n")))
    # A repeated vec_id can represent two classes; what the index stores is a number of its own.
    classes = stages.write(classes.withColumn("rep_id", F.col("rep")).withColumn("rep", F.xxhash64("rep", "h1", "h2", "label", "dims")), "classes")
    models = spark.sparkContext.broadcast(fit_quantisers(classes, cosine, sample))
    radius = F.lit(0)
    for dims, model in models.value.items():
        radius = F.when(F.col("dims") == dims, F.lit(model.radius)).otherwise(radius)
    codes = classes.select("rep", "label", "dims", "vector").mapInPandas(lambda b: _encode(b, models), "rep bigint, label string, dims int, code bigint")
    codes = stages.write(codes.withColumn("radius", radius), "codes")
    # A probe of n bits is shared out: one side is filed under half of them, the other under the rest.
    files, other = (_filed(codes, {dims: (m.probe + up) // 2 for dims, m in models.value.items()}) for up in (1, 0))
    x, y = files.alias("x"), other.select("label", "dims", "part", "value", F.col("rep").alias("rep_y"), F.col("code").alias("code_y"))
    pairs = (x.join(y, ["label", "dims", "part", "value"])
             .where((F.col("rep") < F.col("rep_y")) & (F.bit_count(F.col("code").bitwiseXOR(F.col("code_y"))) <= F.col("radius")))
             .select(F.col("rep").alias("a"), F.col("rep_y").alias("b")).distinct())
    vector = classes.select("rep", "vector")
    links = (pairs.join(vector.select(F.col("rep").alias("a"), F.col("vector").alias("va")), "a")
             .join(vector.select(F.col("rep").alias("b"), F.col("vector").alias("vb")), "b")
             .mapInPandas(lambda b: _rerank(b, cosine), "a bigint, b bigint"))
    return classes, stages.write(links, "links")


def _valid(vectors: DataFrame) -> DataFrame:
    """Vectors that can link, with two hashes of their numbers."""
    v = F.col("embedding")
    finite = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0))
            .where(finite & F.exists(v, lambda e: e != 0))
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.size(v).alias("dims"),
                    F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("second"), v).alias("h2"), v.alias("vector")))


def link_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """``vectors(vec_id, label, embedding)`` -> ``(vec_id, n_links, component_id, kept)``
    per row: other vectors linked directly, the smallest id that links reach, and
    whether that is the vector's own."""
    stages = Stages(spark, "itq")
    classes, links = vector_links(spark, vectors, stages, cosine, sample)
    sizes = classes.select("rep", "n")
    ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = ends.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("beside"))
    parts = connected_components(stages, links).withColumnRenamed("vertex", "rep")
    joined = classes.select("rep", "rep_id", "label", "dims", "h1", "h2", "n").join(beside, "rep", "left").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    joined = stages.write(joined, "joined")
    smallest = joined.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    by_class = stages.write(joined.join(smallest, "component").select("label", "dims", "h1", "h2", (F.coalesce("beside", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "by_class")
    valid = _valid(vectors).select("vec_id", "label", "dims", "h1", "h2").join(by_class, ["label", "dims", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    v = F.col("embedding")
    links_nothing = (F.col("vec_id").isNull() | F.col("label").isNull() | v.isNull() | (F.size(v) == 0)
                     | F.coalesce(F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(True)) | F.coalesce(~F.exists(v, lambda e: e != 0), F.lit(True)))
    alone = vectors.where(links_nothing).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"))
    return valid.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
