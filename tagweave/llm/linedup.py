"""Line de-duplication with a sharded minimal perfect hash.

Lines that occur in two or more documents are counted by 128-bit key hashes. Their
distinct hashes are dealt to shards of a few thousand; each shard gets a minimal
perfect hash (levels of bit arrays: a hash that alone lands on a bit of a level
stays there, the rest goes to the next level) whose index, the rank of the bit,
addresses three flat arrays: fingerprint, count of lines and smallest document.
Documents send the hashes of their lines, never the lines, to the shards, which
stream past the arrays; a line whose fingerprint differs is in no other document.

Shards that hold very common lines are split: probes are dealt over copies of the
shard's arrays in proportion to its lines.

Defined results: null or empty text is one empty line; a null ``doc_id`` counts as
one document after all others; rows that repeat a ``doc_id`` are the same document
for counting and are each answered; an empty table gives no rows; columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, Stages, mix, text_key, unsigned

#: Distinct line hashes per shard, about; one shard's arrays take some 100 KB.
SHARD_KEYS = 4096
#: Bits per remaining hash on each level.
GAMMA = 2.0
MIN_KEY = 10
#: Levels that distinct hashes never need.
MOST_LEVELS = 200
STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def build_mph(h1: np.ndarray, h2: np.ndarray, gamma: float = GAMMA) -> list[np.ndarray]:
    """Levels of bit arrays for distinct pairs of 64-bit hashes. Both halves choose the bit,
    anew on each level, so that two pairs collide on a level by chance only, also where
    they share a half, and every pair finds a bit of its own sooner or later."""
    levels, rest = [], np.arange(len(h1))
    while len(rest):
        if len(levels) == MOST_LEVELS:
            raise ValueError("hashes are not distinct")
        size = max(64, int(gamma * len(rest)))
        spot = _spot(h1[rest], h2[rest], len(levels), size)
        alone = np.bincount(spot, minlength=size)
        levels.append(alone == 1)
        rest = rest[alone[spot] != 1]
    return levels


def _spot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
    return (mix(h1 + mix(h2 + step)) % np.uint64(size)).astype(np.int64)


def find_mph(levels: list[np.ndarray], ranks: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Index of each pair; -1, or any index, for pairs that were not built in."""
    out = np.full(len(h1), -1, np.int64)
    rest = np.arange(len(h1))
    for level, (bits, rank) in enumerate(zip(levels, ranks)):
        spot = _spot(h1[rest], h2[rest], level, len(bits))
        hit = bits[spot]
        out[rest[hit]] = rank[spot[hit]]
        rest = rest[~hit]
    return out


class ShardArrays:
    """One shard: the perfect hash and the arrays it indexes, as one binary value.
    Layout, little-endian: uint32 number of levels and of keys, uint32 bits per
    level, the packed levels, then fingerprints uint64, counts uint32 and smallest
    documents int64 in index order."""

    def __init__(self, levels, prints, counts, firsts):
        self.levels, self.prints, self.counts, self.firsts = levels, prints, counts, firsts
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits) - 1)
            base += int(bits.sum())

    @classmethod
    def build(cls, h1, h2, counts, firsts) -> "ShardArrays":
        out = cls(build_mph(h1, h2), None, None, None)
        at = np.argsort(find_mph(out.levels, out.ranks, h1, h2))
        out.prints, out.counts, out.firsts = h2[at], counts[at].astype(np.uint32), firsts[at]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), len(self.prints), *map(len, self.levels)], "<u4")
        return b"".join([head.tobytes(), *(np.packbits(b).tobytes() for b in self.levels), self.prints.astype("<u8").tobytes(),
                         self.counts.astype("<u4").tobytes(), self.firsts.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> "ShardArrays":
        n_levels, n = np.frombuffer(raw, "<u4", 2)
        sizes = np.frombuffer(raw, "<u4", n_levels, 8)
        at, levels = 8 + 4 * int(n_levels), []
        for size in map(int, sizes):
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        prints = np.frombuffer(raw, "<u8", n, at)
        counts = np.frombuffer(raw, "<u4", n, at + 8 * n)
        return cls(levels, prints, counts, np.frombuffer(raw, "<i8", n, at + 12 * n))

    def probe(self, h1, h2) -> np.ndarray:
        """Index of each line in the arrays, -1 where it is not among them."""
        at = find_mph(self.levels, self.ranks, h1, h2)
        known = at >= 0
        known[known] = self.prints[at[known]] == h2[known]
        return np.where(known, at, -1)


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def _lines(docs: DataFrame, min_key: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = (docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("d"), *text_key(F.col("text")), text.alias("text"))
            .select("d", "t1", "t2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
            .select("d", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_key))
    return rows.select("d", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    arrays = ShardArrays.build(unsigned(rows["h1"]), unsigned(rows["h2"]), rows["n"].to_numpy(), rows["first"].to_numpy(np.int64))
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "arrays": [arrays.to_bytes()]})


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard copy, its arrays before its probes."""
    at, arrays = None, None
    for rows in batches:
        cut = np.flatnonzero((rows["shard"].diff() != 0) | (rows["salt"].diff() != 0) | (rows["kind"] == 0))
        for a, b in zip(cut, [*cut[1:], len(rows)]):
            part = rows.iloc[a:b]
            key = (part["shard"].iloc[0], part["salt"].iloc[0])
            if part["kind"].iloc[0] == 0:
                at, arrays = key, ShardArrays.from_bytes(part["arrays"].iloc[0])
                part = part.iloc[1:]
            if at != key or not len(part):
                continue
            found = arrays.probe(unsigned(part["h1"]), unsigned(part["h2"]))
            drop = found >= 0
            drop[drop] = arrays.firsts[found[drop]] != part["d"].to_numpy()[drop]
            yield part.loc[drop, ["d", "t1", "t2", "pos"]]


def repeated_lines(spark: SparkSession, docs: DataFrame, stages: Stages, min_key: int = MIN_KEY) -> DataFrame:
    """``(d, t1, t2, pos)`` of each line to drop: its key is in an earlier document."""
    lines = _lines(docs, min_key)
    repeated = stages.write(lines.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n"))
                            .where("first <> last").drop("last"), "repeated")
    n_keys, n_lines = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_shards = max(1, -(-n_keys // SHARD_KEYS))
    tasks = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard = F.pmod("h1", F.lit(n_shards)).cast("int")
    arrays = (repeated.withColumn("shard", shard).groupBy("shard").applyInPandas(_build_shard, "shard int, arrays binary"))
    # Copies of a shard: an even share, and more in proportion to its repeated lines. At most
    # 2 * tasks shards can have more than the even share, which bounds the broadcast list.
    even = -(-tasks // n_shards)
    per_line = tasks / max(1, n_lines)
    hot = F.broadcast(repeated.groupBy(shard.alias("shard")).agg(F.sum("n").alias("n"))
                      .select("shard", F.floor(F.col("n") * per_line).cast("int").alias("extra")).where("extra > 0"))
    copies = F.lit(even) + F.coalesce("extra", F.lit(0))
    probes = (lines.withColumn("shard", shard).join(hot, "shard", "left")
              .select("shard", F.pmod(F.xxhash64("d", "t1", "pos"), copies).cast("int").alias("salt"), F.lit(1).alias("kind"),
                      F.lit(None).cast("binary").alias("arrays"), "d", "t1", "t2", "pos", "h1", "h2"))
    none = F.lit(0).cast("bigint")  # not null: nulls would turn whole numbers into floats in pandas
    built = (arrays.join(hot, "shard", "left")
             .select("shard", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), F.lit(0).alias("kind"), "arrays",
                     none.alias("d"), none.alias("t1"), none.alias("t2"), F.lit(0).alias("pos"), none.alias("h1"), none.alias("h2")))
    return (built.union(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
            .mapInPandas(_probe, "d bigint, t1 bigint, t2 bigint, pos int"))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_lines, n_dropped, text)`` with every line
    gone whose key of at least ``min_key`` code points is in an earlier document."""
    stages = Stages(spark, "linedup")
    drops = stages.write(repeated_lines(spark, docs, stages, min_key).groupBy("d", "t1", "t2").agg(F.collect_set("pos").alias("drop")), "drops")
    stages.drop("repeated")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("d"), *text_key(F.col("text")),
                       F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.join(drops, ["d", "t1", "t2"], "left").select("doc_id", "text", "drop", F.split("text", "\n", -1).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    return lines.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"),
                        F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
                        F.when(F.col("drop").isNull(), F.col("text"))
                        .otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")).alias("text"))
