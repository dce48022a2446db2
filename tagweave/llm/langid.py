"""Language identification by cross-parsing entropy.

Per language, a bounded sample of labelled text becomes a suffix automaton, which
knows every substring of the sample. A text is parsed against it from left to right
into the longest phrases that occur in the sample. Long matches mean few phrases:
phrases x log2(sample length) / text length estimates the bits per character of the
text under the language, and the language with the fewest wins. A character that the
sample does not have is a phrase of as many bits as name any character, the same for all
languages; each language knows every character of its own sample, and every label that
is not null is a language.

Text is lower-cased and every run of characters that are not letters becomes one
space. The whole text is parsed.

Defined results: null text and text without a letter are ``und`` with score 0; ties
go to the language that comes first; without any labelled text all is ``und``; rows
with a null ``doc_id`` are predicted but not learned from; labels of null are not
learned; an empty table gives no rows; columns beyond those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import crc_of_id, hash_share, held

#: Characters learned per language, at most.
SAMPLE_CHARS = 20_000
#: Characters of a piece, and documents per language that pieces come from, about.
PIECE, DOCUMENTS = 250, 512
#: Bits that name any character.
LITERAL = np.log2(0x110000)
#: Entries of the flat transition tables of a model together; automata beyond it are sparse.
FLAT = 1 << 24
#: Bits per character at which a language is e times less likely than the best.
SHARPNESS = 0.15
#: Bits per character behind the best at which a language's parse stops.
HOPELESS = 4 * SHARPNESS
SEED = 20240601
_GAPS = re.compile(r"[\W\d_]+")


def normalise(text: str | None) -> str:
    """Letters in lower case, single spaces between and around them; '' without a letter."""
    words = _GAPS.sub(" ", (text or "").lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""


class _Sparse(dict):
    """A table that holds 0 where nothing is set."""

    def __missing__(self, at: int) -> int:
        return 0


class Automaton:
    """Suffix automaton of a text over an alphabet, as one transition table:
    ``table[state + code]`` is the next state, 0 for none. States are multiples of the
    alphabet's size; 0 is the start, which nothing leads to. The table is flat up to
    ``flat`` entries and sparse beyond, with the same answers."""

    def __init__(self, text: str, alphabet: str, flat: int = FLAT):
        code = {c: i + 1 for i, c in enumerate(alphabet)}
        self.width = len(alphabet) + 1
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            a = code.get(c, 0)
            if not a:  # outside the alphabet: matches end here
                last = 0
                continue
            if a in nexts[last]:
                # Only after a break: the path exists already, so extend along it.
                q = nexts[last][a]
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._split(nexts, link, length, last, a, q)
                continue
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and a not in nexts[p]:
                nexts[p][a] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][a]
                link[cur] = q if length[q] == length[p] + 1 else self._split(nexts, link, length, p, a, q)
            last = cur
        size = len(nexts) * self.width
        self.flat_size = size if size <= flat else 0
        table = [0] * size if self.flat_size else _Sparse()
        for s, out in enumerate(nexts):
            for a, t in out.items():
                table[s * self.width + a] = t * self.width
        self.table, self.text_length = table, max(2, len(text))

    @staticmethod
    def _split(nexts, link, length, p, a, q) -> int:
        clone = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nexts[p].get(a) == q:
            nexts[p][a] = clone
            p = link[p]
        return clone

    def phrases(self, codes: bytes | list[int], enough: float = float("inf")) -> int:
        """Longest-match phrases that the coded text falls into; stops counting once
        there are more than ``enough``."""
        table, state, n = self.table, 0, 0
        for c in codes:
            if onward := table[state + c]:
                state = onward
            else:
                if state:
                    n += 1
                state = table[c]
                if not state:
                    n += 1
                if n > enough:
                    break
        return n + (state > 0)


class LanguageModel:
    """Automata of all languages, each over the characters of its sample."""

    def __init__(self, samples: dict[str, str], flat: int = FLAT):
        self.languages = sorted(samples)
        every = sorted({c for text in samples.values() for c in text})
        self.codes = np.zeros(0x110000, np.int32)  # of a character among all samples' ones
        self.codes[[ord(c) for c in every]] = np.arange(1, len(every) + 1)
        self.automata, self.own = [], []
        for lang in self.languages:
            alphabet = "".join(sorted(set(samples[lang])))
            self.automata.append(Automaton(samples[lang], alphabet, flat))
            flat -= self.automata[-1].flat_size
            own = np.zeros(len(every) + 1, np.uint8 if len(alphabet) < 256 else np.int32)  # of a character among the language's
            own[self.codes[[ord(c) for c in alphabet]]] = np.arange(1, len(alphabet) + 1)
            self.own.append(own)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of a softmax over negative bits per character; a
        language whose parse stopped is below e^-4 of the best and has no weight."""
        clean = normalise(text)
        if not clean or not self.automata:
            return "und", 0.0
        every = self.codes[np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), "<u4")]
        coded, literal = [], []
        unit = [np.log2(a.text_length) / len(every) for a in self.automata]
        for own, u in zip(self.own, unit):
            codes = own[every]
            # What unseen characters cost beyond the phrase that each of them is.
            literal.append((len(codes) - np.count_nonzero(codes)) * (LITERAL / len(every) - u))
            coded.append(codes.tobytes() if codes.dtype == np.uint8 else codes.tolist())
        # The language likely to win, by a first look, is parsed first; another one is out as soon
        # as its count, which only grows, puts it HOPELESS behind the best. The winner is that of full counts.
        glance = [a.phrases(c[:200]) * u * len(every) / min(200, len(every)) + x for a, c, u, x in zip(self.automata, coded, unit, literal)]
        bits, best = np.full(len(unit), np.inf), float("inf")
        for i in np.argsort(glance, kind="stable"):
            found = self.automata[i].phrases(coded[i], (best + HOPELESS - literal[i]) / unit[i]) * unit[i] + literal[i]
            best = min(best, found)
            bits[i] = found if found <= best + HOPELESS else np.inf
        bits[bits > best + HOPELESS] = np.inf  # what an earlier best let pass
        winner = int(bits.argmin())
        return self.languages[winner], float(1 / np.exp((best - bits) / SHARPNESS).sum())


def _predict(batches: Iterator[pa.RecordBatch], samples, columns: list[str]) -> Iterator[pa.RecordBatch]:
    model = held(("languages", samples.value["key"]), lambda: LanguageModel(samples.value["texts"]))
    for batch in batches:
        found = [model.predict(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                         [*columns, "lang_pred", "score"])


def learn_samples(labelled: DataFrame, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Sample text per language from ``labelled(doc_id, text, lang)``: ``chars`` normalised
    characters in pieces of ``PIECE``, in a seeded order. Documents are chosen by hash, some
    ``DOCUMENTS`` of a language or all it has; each whole text is cut into even stretches
    and gives a piece from a place in each, as many as make some 4 * ``chars`` characters of
    the language. So no text is a whole sample, none gives its beginning only, and a
    language with a document that holds a letter has a sample."""
    named = labelled.where("text is not null and lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = named.select("lang", F.xxhash64(F.lit(SEED), "doc_id").alias("h"), F.char_length("text").alias("size"), "text")
    n = F.count(F.lit(1))
    shares = rows.groupBy("lang").agg(n.alias("n")).select(
        "lang", F.least(F.lit(1.0), DOCUMENTS / F.col("n")).alias("share"), F.ceil(4.0 * chars / PIECE / F.least(F.col("n"), F.lit(DOCUMENTS))).cast("int").alias("most"))
    some = rows.join(F.broadcast(shares), "lang").where(hash_share(F.col("h"), F.col("share")))  # one row per language
    count = F.least("most", F.ceil(F.col("size") / PIECE).cast("int"))
    cut = some.select("lang", "h", "size", "text", count.alias("count"), F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    stretch = F.floor(F.col("size") / F.col("count")).cast("int")
    start = F.col("i") * stretch + F.pmod(F.xxhash64("h", "i"), F.greatest(F.lit(1), stretch - PIECE + 1)).cast("int") + 1
    pieces = cut.select("lang", F.xxhash64("i", "h").alias("place"), F.substr("text", start, F.lit(PIECE)).alias("piece"))
    out: dict[str, str] = {}
    for lang, _, piece in sorted(pieces.collect()):
        if len(out.get(lang, "")) < chars:
            out[lang] = (out.get(lang, "") + normalise(piece))[:chars]
    return {lang: text for lang, text in out.items() if text}


def _predicted(spark: SparkSession, docs: DataFrame, labelled: DataFrame, keep: list[str], sample: dict) -> DataFrame:
    """Kept columns as ``k0, k1, ...``, so that they cannot clash with what is added."""
    texts = learn_samples(labelled, **sample)
    samples = spark.sparkContext.broadcast({"key": hash(tuple(sorted(texts.items()))), "texts": texts})
    columns = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, columns)], F.col("text").alias("text"))
    schema = StructType([*(StructField(k, rows.schema[k].dataType) for k in columns), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(lambda b: _predict(b, samples, columns), schema)


def identify(spark: SparkSession, docs: DataFrame, labelled: DataFrame, **sample) -> DataFrame:
    """Learn from ``labelled(doc_id, text, lang)`` and predict ``docs``: ``(doc_id,
    lang_pred, score)`` per row, the score from 0 to 1."""
    return _predicted(spark, docs, labelled, ["doc_id"], sample).withColumnRenamed("k0", "doc_id")


def keep_known(spark: SparkSession, docs: DataFrame, labelled: DataFrame, **sample) -> DataFrame:
    """Rows of ``docs``, all columns, that are in a learned language."""
    found = _predicted(spark, docs, labelled, docs.columns, sample).where("lang_pred <> 'und'")
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def training_fold(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id as text is not 1 modulo 3."""
    return docs.where(crc_of_id(F.col("doc_id")) % 3 != 1)
