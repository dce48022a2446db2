"""Helpers shared by the operators of this package: written stages in the
shared folder, word splitting, word hashing and bounded Bloom filters."""

from __future__ import annotations

import contextlib
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Stands for a null document id: such rows count as one document that comes last.
NO_ID = 2**63 - 1

#: Words of the contracts: runs of ASCII letters and digits and of anything beyond
#: ASCII. A-Z are matched here and lower-cased word by word.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def lower_word(word: str) -> str:
    """Lower-case A-Z and leave every other character alone."""
    return word.lower() if word.isascii() else word.translate(_ASCII_LOWER)


class WordHash(dict):
    """64-bit hash of the lower-cased word, remembered for up to ``LIMIT`` words."""

    LIMIT = 1 << 17

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(lower_word(word).encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; one run of all words if there are fewer
    than ``k``, none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    acc = mix(hashes[: n - k + 1] + np.uint64(k))
    for j in range(1, k):
        acc = mix(acc + hashes[j : n - k + 1 + j])
    return acc


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def unsigned(x) -> np.ndarray:
    return np.asarray(x, dtype=np.int64).view(np.uint64)


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a whole text (null reads as empty)."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit("second"), t).alias("t2")]


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def as_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, out of the way of names that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def from_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns packed by :func:`as_row`."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def hash_share(hashed: Column, share: Column) -> Column:
    """True for about ``share`` (0 to 1) of the values of a 64-bit hash."""
    return F.pmod(hashed, F.lit(1 << 30)) < share * float(1 << 30)


def seeded_sample(df: DataFrame, hashed: Column, n: int) -> DataFrame:
    """The ``n`` rows that hash lowest among a share of the rows that holds some 2n, so
    that ordering them is work for 2n rows at any size of ``df``."""
    share = min(1.0, 2.0 * n / max(1, df.count()))
    return df.where(hash_share(hashed, F.lit(share))).orderBy(F.pmod(hashed, F.lit(1 << 30)), *df.columns).limit(n)


class Stages:
    """Tables written to the shared folder to cut lineage: a lost executor makes
    Spark read a file again instead of redoing the job. ``drop`` removes tables
    that no later step reads."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = scratch_path(spark, f"llm-{job}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        df.write.parquet(self.path(name), compression=compression)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


#: Spark removes the shuffle files of a query, made while this is set, when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries made here leave no shuffle files behind; none of them may run twice. Without it
    the files stay until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


class Bloom:
    """A Bloom filter over 64-bit hashes with three probes. ``build`` makes it in
    Spark; its size follows the number of hashes up to ``MAX_BITS`` (16 MiB), which
    bounds what is collected and broadcast. Hits are verified by a join, so a
    fuller filter costs time, never results."""

    MAX_BITS = 1 << 27

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(len(bits) * 64 - 1)

    @classmethod
    def build(cls, hashes: DataFrame, column: str) -> "Bloom":
        count = hashes.select(F.approx_count_distinct(column)).first()[0]
        size = 1 << 12
        while size < min(cls.MAX_BITS, 16 * count):
            size *= 2
        spots = F.array(*[F.shiftrightunsigned(F.col(column), 18 * i).bitwiseAND(F.lit(size - 1)) for i in range(3)])
        words = (hashes.select(F.explode(spots).alias("spot"))
                 .select(F.shiftright("spot", 6).alias("word"),
                         F.expr("shiftleft(1L, cast(spot & 63 as int))").alias("bit"))
                 .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
        bits = np.zeros(size // 64, np.uint64)
        bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        return cls(bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for i in range(3):
            spot = (hashes >> np.uint64(18 * i)) & self.mask
            out &= (self.bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        return out


def chunks(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive index ranges whose lengths add up to ``most`` or, for a range of
    one, to more."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    return [*out, (start, len(lengths))] if len(lengths) else []


def byte_table(**targets: str) -> bytes:
    """A translation of bytes: A-Z to lower case where ``lower`` is given, and the ASCII
    characters of ``space`` to a space, of ``line`` to a line feed. UTF-8 lengths stay."""
    table = bytearray(range(256))
    for c in range(65, 91) if "lower" in targets else ():
        table[c] = c + 32
    for name, to in (("space", 32), ("line", 10)):
        for c in targets.get(name, ""):
            table[ord(c)] = to
    return bytes(table)


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """The texts (no nulls) with every byte looked up in ``table``, one pass over their buffer."""
    texts = texts.cast(pa.string())
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = data.to_pybytes()[at[0] : at[-1]] if data is not None else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(raw.translate(table)))


def space_parts(texts: pa.Array, keep_empty: bool = False) -> tuple[np.ndarray, pa.Array]:
    """``(starts, parts)``: the texts (no nulls) split at single spaces, in a row; text i
    has the parts ``starts[i]`` to ``starts[i + 1]``. Empty parts go unless kept."""
    lists = pc.split_pattern(texts, " ")
    parts = lists.flatten()
    starts = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))]
    if not keep_empty and len(parts):
        kept = pc.not_equal(parts, "")
        starts = np.r_[0, np.cumsum(kept.to_numpy(zero_copy_only=False))][starts]
        parts = parts.filter(kept)
    return starts, parts


def byte_pieces(batches, column: str, most: int):
    """Record batches cut so that the texts of ``column`` take ``most`` bytes or, for a
    batch of one row, more."""
    for batch in batches:
        lengths = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in chunks(lengths, most):
            yield batch.slice(a, b - a)


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the parts of each text."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def spans_of(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``firsts[i]`` to ``firsts[i] + lengths[i]`` of every i in a row."""
    ends = np.cumsum(lengths)
    return np.repeat(firsts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


#: Bytes that are in no word of :data:`WORD` become spaces, A-Z lower case.
_WORD_TABLE = byte_table(lower="", space="".join(chr(c) for c in range(128) if not chr(c).isalnum()))


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """``(starts, index, words, hashes)`` of texts without nulls: text i has the lower-cased
    words ``words[index[starts[i]:starts[i + 1]]]``; hashes are those of :class:`WordHash`,
    one per distinct word."""
    starts, parts = space_parts(translated(texts, _WORD_TABLE))
    coded = parts.dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w.as_buffer()) for w in coded.dictionary.cast(pa.binary())], np.uint64)
    return starts, coded.indices.to_numpy().astype(np.int64), coded.dictionary, hashes


_HELD: dict = {}


def held(key, make):
    """What ``make`` returns, kept in this Python worker until something else is asked for:
    a worker runs tasks of many stages and holds one such thing at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver to every executor; :func:`shipped` finds it there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shipped(name: str) -> str:
    return SparkFiles.get(name)


#: Keys of a table of counts that are held by broadcast: those with at least a
#: HEAVY-th of all counts, of which there can be no more than HEAVY. The rest is joined,
#: and none of its keys is in many rows.
HEAVY = 1 << 18


def heavy_and_tail(counts: DataFrame, n: str = "n", heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """A table of counts split into at most ``heavy`` keys that hold a heavy-th of the
    total or more, and the others."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    share = F.col(n).cast("double") * float(heavy) >= float(total)
    return counts.where(share), counts.where(~share)
