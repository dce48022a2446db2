"""Near-duplicate documents by DartMinHash and banding.

A document is a weighted set: its shingles of five words (all its words if it has
fewer) with their counts. Similarity is the weighted Jaccard index, the sum of the
smaller counts over the sum of the larger ones; documents at 0.8 or more are linked.

Darts fall on the plane (weight of an element) x (rank) at a rate of one per unit
square; each square's darts follow from a hash of element and square alone. A
document sees the squares below its elements' weights, up to the rank at which some
``k ln k + 2k`` darts are expected; each dart names one of ``k`` coordinates, and
the earliest dart of a coordinate is its signature value. Coordinates still empty
make the document look at higher ranks. Two documents agree on a coordinate with
the probability of their similarity.

Copies of the same words are reduced to one document first, which goes by a hash of
its words (a 64-bit half of their digest), so that an id with several texts has several
documents. Bands of signature
values are buckets; the documents of a bucket are compared with a few pivots of it
(stars, not all pairs) and components follow. Then documents that share a bucket but no
component yet are compared inside the join of the bucket: by their whole signatures,
which agree as links do but for 2 in 1,000, once per pair, in the first band it
shares, and then exactly. The join makes a row for a link only, not for a pair.

Defined results: texts without words (null, empty) link with nothing; rows without
``doc_id`` are left out of the classes and come back alone, with a null class; rows
that repeat a ``doc_id`` are each classed by their own text, and two classes that share
their smallest ``doc_id`` have one name but stay two classes (``component`` tells them); an empty table gives no
rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Stages, WordHash, as_row, chunks, from_row, held, mix, shingles, signed, text_key
from .graph import connected_components

SHINGLE, SIMILAR = 5, 0.8
#: 24 bands of 5: at similarity 0.8 a pair shares a band but for 7 in 100,000 cases.
BANDS, ROWS = 24, 5
#: Documents of a bucket that all others are compared with.
PIVOTS = 4
#: Spreads below what a pair at the similarity bound agrees in, in the last pass.
SPREADS = 2.9
#: Darts in a unit square, by a Poisson law of mean 1: cumulative probabilities.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, n + 1)) for n in range(16)])
#: Squares looked at in one numpy step.
STEP = 400_000
_NONE = np.uint64(2**64 - 1)


def _throw(units: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, n_docs: int, k: int, out: np.ndarray) -> None:
    """Throw the darts of ranks ``low[doc]`` to ``high[doc]`` for unit weights ``units``
    of documents ``doc`` and keep the earliest per document and coordinate in ``out``.
    A value is 12 bits of whole rank, 20 of its fraction and 32 of the dart's hash."""
    flat = out.reshape(-1)
    width = (high - low)[doc]
    for a, b in chunks(width, STEP):
        n = width[a:b]
        owner = np.repeat(np.arange(a, b), n)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[doc[owner]]
        square = mix(units[owner] + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        darts = np.searchsorted(_POISSON, (square >> np.uint64(11)).astype(np.float64) / 2.0**53)
        hit = np.repeat(np.arange(len(owner)), darts)
        nth = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(square[hit] ^ mix(nth.astype(np.uint64) + np.uint64(1)))
        value = (np.minimum(rank[hit], 4095).astype(np.uint64) << np.uint64(52)) | (dart >> np.uint64(44) << np.uint64(32)) | (mix(dart) & np.uint64(0xFFFFFFFF))
        spot = doc[owner[hit]] * k + (mix(dart + np.uint64(7)) % np.uint64(k)).astype(np.int64)
        np.minimum.at(flat, spot, value)


def signatures(shingle_hashes: list[np.ndarray], k: int = BANDS * ROWS) -> np.ndarray:
    """``k`` values per document for lists of shingle hashes with repeats; all of them
    at their maximum for a document without shingles."""
    sizes = np.array([len(s) for s in shingle_hashes])
    out = np.full((len(sizes), k), _NONE)
    live = np.flatnonzero(sizes)
    if not len(live):
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.concatenate(shingle_hashes)
    order = np.lexsort((flat, doc))
    flat = flat[order]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(flat)), 0))
    units = mix(flat ^ mix((np.arange(len(flat)) - first).astype(np.uint64)))  # the n-th unit of an element's weight
    low = np.zeros(len(sizes), np.int64)
    high = np.ceil((k * np.log(k) + 2 * k) / np.maximum(sizes, 1)).astype(np.int64)
    while len(live):
        part = np.isin(doc, live) if len(live) < len(sizes) else np.ones(len(doc), bool)
        _throw(units[part], doc[part], low, high, len(sizes), k, out)
        live = live[(out[live] == _NONE).any(axis=1)]
        low, high = high, 2 * high
    return out


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit bucket key per document and band."""
    parts = values.reshape(len(values), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        key = mix(key * np.uint64(31) + parts[:, :, j])
    return key


#: Signature values are kept as 4 bits each, 15 to a whole number.
NIBBLES = 15
_ONES = int("1" * NIBBLES, 16)


def pack_nibbles(values: np.ndarray) -> np.ndarray:
    """4 bits of each signature value, ``NIBBLES`` to a number."""
    short = mix(values) & np.uint64(15)
    short = np.pad(short, ((0, 0), (0, -short.shape[1] % NIBBLES))).reshape(len(short), -1, NIBBLES)
    return (short << (np.arange(NIBBLES, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def agreement(x: str, y: str, n_values: int) -> Column:
    """How many of ``n_values`` kept values agree between two columns of packed ones."""
    n = -(-n_values // NIBBLES)
    out = F.lit(n * NIBBLES)
    for i in range(n):
        differ = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        differ = differ.bitwiseOR(F.shiftright(differ, 1))
        differ = differ.bitwiseOR(F.shiftright(differ, 2))
        out = out - F.bit_count(differ.bitwiseAND(F.lit(_ONES)))
    return out - (n * NIBBLES - n_values)


def _sign(batches: Iterator[pd.DataFrame], k: int, bands: int, rows_per_band: int) -> Iterator[pd.DataFrame]:
    cache = held("words", WordHash)
    for rows in batches:
        texts = rows["text"].tolist()
        for a, b in chunks([len(t or "") for t in texts], 1 << 20):
            hashes = [cache.of(WORD.findall(t or "")) for t in texts[a:b]]
            digests = [xxhash.xxh3_128_digest(h.tobytes()) for h in hashes]
            values = signatures([shingles(h, k) for h in hashes], bands * rows_per_band)
            keys, nibbles = signed(band_keys(values, bands)), pack_nibbles(values)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            part = rows.iloc[a:b]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "t1": part["t1"].to_numpy(), "t2": part["t2"].to_numpy(), "d1": halves[:, 0], "d2": halves[:, 1],
                                "n": [len(h) for h in hashes], "keys": [x.tolist() if len(h) else [] for x, h in zip(keys, hashes)],
                                "nibbles": nibbles.tolist()})


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Of two documents as (sorted distinct hashes, counts)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum()) if len(both) else 0
    return low / (int(a[1].sum()) + int(b[1].sum()) - low)


def _compare(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    cache, seen = held("words", WordHash), {}
    for rows in batches:
        def weighted(key, text):
            if key not in seen:
                if len(seen) >= 64:  # bounds memory; pairs come sorted, so a document's pairs are together
                    seen.clear()
                seen[key] = np.unique(shingles(cache.of(WORD.findall(text)), k), return_counts=True)
            return seen[key]

        yield pd.DataFrame({"a": rows["a"], "b": rows["b"],
                            "sim": [weighted_jaccard(weighted(a, ta), weighted(b, tb)) for a, ta, b, tb in zip(rows["a"], rows["ta"], rows["b"], rows["tb"])]},
                           columns=["a", "b", "sim"])


def _units(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The units of weight of each text: a hash per shingle and number of its occurrence,
    so that sizes of plain sets give the weighted index."""
    cache = held("words", WordHash)
    for rows in batches:
        out = []
        for text in rows["text"]:
            own = np.sort(shingles(cache.of(WORD.findall(text)), k))
            first = np.searchsorted(own, own)
            out.append(signed(mix(own ^ mix((np.arange(len(own)) - first).astype(np.uint64)))).tolist())
        yield pd.DataFrame({"rep": rows["rep"], "units": out})


def compare_pairs(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``pairs(a, b)`` and ``texts(id, text)`` -> ``(a, b, sim)`` by exact comparison."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
            .mapInPandas(lambda batches: _compare(batches, k), "a bigint, b bigint, sim double"))


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = SHINGLE, similar: float = SIMILAR,
                    bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, t1, t2, class_id, component)`` for each row; the
    class holds what links and exact copies connect, ``component`` is its own number (null
    without words) and ``class_id`` its smallest document; ``t1, t2`` name the row's text."""
    stages = Stages(spark, "neardup")
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *text_key(F.col("text")), "text")
    signs = stages.write(named.where("doc_id is not null").mapInPandas(
        lambda batches: _sign(batches, k, bands, rows_per_band), "doc_id bigint, t1 bigint, t2 bigint, d1 bigint, d2 bigint, n bigint, keys array<bigint>, nibbles array<bigint>"), "signs")
    copies = (signs.where("n > 0").groupBy("d1", "d2")
              .agg(F.min(F.struct("doc_id", "t1", "t2")).alias("first"), F.min(F.struct("keys", "nibbles")).alias("s"))
              .select("d1", "d2", F.col("d1").alias("rep"), "first.*", "s.*"))
    copies = stages.write(copies, "copies")
    rows = copies.select("rep", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last").select("key")
    members = stages.write(rows.join(shared, "key", "left_semi"), "members")
    # The window is limited in every task before rows meet.
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("rep"), "rep"))
    pivots = members.select("key", "rep").withColumn("nth", nth).where(F.col("nth") <= PIVOTS).select("key", F.col("rep").alias("pivot"))
    stars = (members.join(pivots, "key").where("rep <> pivot")
             .select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct())
    wanted = copies.join(members.select("rep").distinct(), "rep", "left_semi").select("doc_id", "t1", "t2", F.col("rep").alias("id"))
    texts = stages.write(named.join(wanted, ["doc_id", "t1", "t2"]).groupBy("doc_id", "t1", "t2", "id")
                         .agg(F.first(F.coalesce("text", F.lit(""))).alias("text")).select("id", "text"), "texts")

    def linked(pairs, name):
        return stages.write(compare_pairs(pairs, texts, k).where(F.col("sim") >= similar).select("a", "b").distinct(), name)

    links = linked(stars, "links-0")
    n_values = bands * rows_per_band
    agree = similar + (1 - similar) / 16  # of a pair at the bound: equal values, or unequal ones with equal bits
    spread = np.sqrt(n_values * agree * (1 - agree))
    parts = connected_components(stages, links, "cc-stars").withColumnRenamed("vertex", "rep")
    placed = stages.write(members.join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    some = stages.write(placed.join(mixed, "key", "left_semi"), "mixed")
    reps = some.select("rep").distinct()
    units = (texts.withColumnRenamed("id", "rep").join(reps, "rep", "left_semi")
             .mapInPandas(lambda batches: _units(batches, k), "rep bigint, units array<bigint>"))
    seen = copies.join(reps, "rep", "left_semi").groupBy("rep").agg(F.min(F.struct("keys", "nibbles")).alias("s")).select("rep", "s.*")
    some = stages.write(some.join(seen, "rep").join(units, "rep").withColumn("n", F.size("units")), "open")
    x, y = some.alias("x"), some.alias("y")
    least = int(np.ceil(n_values * agree - SPREADS * spread))
    first_shared = F.array_position(F.zip_with("x.keys", "y.keys", lambda p, q: p == q), True) == F.col("x.band") + 1
    # Each costly expression occurs once: Spark takes repeated ones out of a condition and
    # would work out the intersection for every pair, before the cheap tests.
    share = Fraction(similar).limit_denominator(1000)
    p, q = share.numerator, share.denominator
    near_size = q * F.least("x.n", "y.n") >= p * F.greatest("x.n", "y.n")
    exact = F.size(F.array_intersect("x.units", "y.units")) * (p + q) >= p * (F.col("x.n") + F.col("y.n"))
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component"))
                  & near_size & (agreement("x.nibbles", "y.nibbles", n_values) >= least) & first_shared & exact)
    links = links.union(stages.write(more.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), "links-1"))
    stages.drop("placed", "mixed", "open")
    classes = stages.write(connected_components(stages, links, "cc"), "classes")
    stages.drop("texts", "members")
    # Every row -> the representative of its words -> the class of that representative.
    owners = copies.select("d1", "d2", "rep", "doc_id").join(classes.withColumnRenamed("vertex", "rep"), "rep", "left").select("d1", "d2", "doc_id", F.coalesce("component", "rep").alias("component"))
    owners = stages.write(owners, "owners")
    # Written, so that both sides of the join are dealt apart and a large class can be split.
    names = stages.write(owners.groupBy("component").agg(F.min("doc_id").alias("class_id")), "names")
    owners = stages.write(owners.join(names, "component").select("d1", "d2", "component", "class_id"), "named")
    out = signs.select("doc_id", "t1", "t2", "d1", "d2", "n").join(owners, ["d1", "d2"], "left")
    has_words = F.col("n") > 0
    out = out.select("doc_id", "t1", "t2", F.when(has_words, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(has_words, F.col("component")).alias("component"))
    nothing = F.lit(None).cast("bigint")
    return out.union(named.where("doc_id is null").select("doc_id", "t1", "t2", nothing.alias("class_id"), nothing.alias("component")))


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of ``docs`` per class of :func:`near_duplicates`: of its smallest document
    the text that hashes lowest, of equal rows the first by a hash of all columns.
    Rows without ``doc_id`` stay; of those without words, one per ``doc_id`` and text."""
    rows = classes.where("doc_id is not null").groupBy("component", "doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "t1", "t2", "n")).alias("k"))
    first = first.select(*[F.col(f"k.{c}").alias(c) for c in ("doc_id", "t1", "t2", "n")]).union(rows.where("component is null").select("doc_id", "t1", "t2", "n"))
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), *text_key(F.col("text")), as_row(docs))
    kept = keyed.join(first, ["doc_id", "t1", "t2"])
    nth = F.row_number().over(Window.partitionBy("doc_id", "t1", "t2").orderBy(F.xxhash64("row")))
    repeated = kept.where("n > 1").withColumn("nth", nth).where("nth = 1")
    return from_row(kept.where("n = 1").select("row").union(repeated.select("row")), docs.columns).union(docs.where("doc_id is null"))
