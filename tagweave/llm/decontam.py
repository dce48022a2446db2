"""Benchmark decontamination as a prefix-filtered set join.

Each benchmark item is cut into windows of ``window`` words (a shorter item is one
window). A window is contained in a document where all its shingles occur in order,
so any one of its shingles is a necessary prefix token; the one that is rarest in
the passages found is joined. Positions then bound the window (its start and end must
lie in the passage) and the words themselves are compared.

The corpus is read once, against a Bloom filter of bounded size over the items'
shingles. A window needs as many shingles in a row as it has, which bounds the length
of a passage: shorter runs are dropped, the others are written with their words in
pieces of bounded size. Rarity is counted and prefix tokens are looked up there. A
token in very many documents is split by Spark's skew join.

Defined results: null text or text without words has no hits; items with a null id
or without words are passed over; rows repeating a ``doc_id`` are each answered by
their own text; empty tables give no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Bloom, Stages, WordHash, as_row, byte_pieces, coded_words, from_row, held, lower_word, shingles, signed, text_key

WINDOW, SHINGLE = 10, 3
#: Shingles of a run that are kept together, so that a long passage is many small rows.
PIECE = 64
#: Bytes of text that a task looks at at a time.
PIECE_BYTES = 4 << 20
_PIECES = pa.list_(pa.struct({"tokens": pa.list_(pa.int64()), "pos": pa.int32(), "left": pa.int32(), "words": pa.list_(pa.string())}))


def _windows(batches: Iterator[pd.DataFrame], window: int, k: int) -> Iterator[pd.DataFrame]:
    cache = WordHash()
    for rows in batches:
        out = []
        for item, text in zip(rows["item"], rows["text"]):
            words = [lower_word(w) for w in WORD.findall(text or "")]
            size = min(window, len(words))
            tokens = signed(shingles(cache.of(words), min(k, size))) if size else []
            for at in range(len(words) - size + 1 if size else 0):
                out.append((item, words[at : at + size], tokens[at : at + size - min(k, size) + 1].tolist()))
        yield pd.DataFrame(out, columns=["item", "words", "tokens"])


def item_windows(items: DataFrame, window: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """``items(item_id, text)`` -> ``(item, words, tokens)``, the windows with their
    shingle hashes in order."""
    named = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    return named.mapInPandas(lambda batches: _windows(batches, window, k), "item string, words array<string>, tokens array<bigint>")


def _runs(hashes: np.ndarray, starts: np.ndarray, k: int, least: int, bloom: Bloom):
    """Stretches ``(text, first, after, tokens)`` of ``least`` or more shingles of ``k``
    words in a row that pass the filter within one text, by the positions of their first words."""
    if len(hashes) < k:
        return
    tokens = shingles(hashes, k)
    at = np.flatnonzero(bloom.has(tokens))
    text = np.searchsorted(starts, at, "right") - 1
    inside = at + k <= starts[text + 1]
    at, text = at[inside], text[inside]
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(text) != 0)) + 1
    begins, ends = np.r_[0, breaks], np.r_[breaks, len(at)]
    for i in np.flatnonzero(ends - begins >= least).tolist():
        first, after = int(at[begins[i]]), int(at[ends[i] - 1]) + 1
        yield int(text[begins[i]]), first, after, tokens[first:after]


def _locate(batches, least: dict[int, int], bloom, window: int):
    """Per text its word count and its pieces: up to ``PIECE`` shingles in a row with the
    words of their run that windows at them can cover."""
    held("decontam", lambda: None)
    for batch in byte_pieces(batches, "text", PIECE_BYTES):
        starts, index, dictionary, hashes = coded_words(batch["text"].fill_null(""))
        out: list[list[dict]] = [[] for _ in range(len(batch))]
        for k, n in least.items():
            for i, first, after, tokens in _runs(hashes[index], starts, k, n, bloom.value):
                for a in range(first, after, PIECE):
                    b = min(a + PIECE, after)
                    low, high = max(first, a - window + 1), min(after - 1 + k, b - 1 + window)
                    out[i].append({"tokens": signed(tokens[a - first : b - first]).tolist(), "pos": a - int(starts[i]), "left": a - low,
                                   "words": dictionary.take(pa.array(index[low:high])).to_pylist()})
        yield pa.RecordBatch.from_arrays([batch["t1"], batch["t2"], pa.array(np.diff(starts)), pa.array(out, _PIECES)], ["t1", "t2", "n_words", "pieces"])


def _prefix_hits(batches, bloom, window: int):
    """The shingles of pieces that may be prefix tokens, each with the words around it."""
    for rows in batches:
        out = []
        for t1, t2, n_words, tokens, pos, left, words in rows.itertuples(index=False):
            tokens = np.asarray(tokens, np.int64)
            for i in np.flatnonzero(bloom.value.has(tokens.view(np.uint64))).tolist():
                a = max(0, left + i - window + 1)
                out.append((t1, t2, n_words, int(tokens[i]), pos + i, left + i - a, list(words[a : left + i + window])))
        yield pd.DataFrame(out, columns=["t1", "t2", "n_words", "token", "pos", "left", "around"])


def find_windows(spark: SparkSession, docs: DataFrame, items: DataFrame, stages: Stages, window: int = WINDOW, k: int = SHINGLE):
    """``(words, spans)``: ``words(t1, t2, n_words)`` per distinct text and
    ``spans(t1, t2, item, start, size)``, every occurrence of an item's window."""
    windows = stages.write(item_windows(items, window, k), "windows")
    least = dict(windows.groupBy(F.least(F.size("words"), F.lit(k)).alias("k")).agg(F.min(F.size("tokens"))).collect())  # k rows at most
    texts = docs.select(*text_key(F.col("text")), "text")
    token_rows = windows.select(F.explode("tokens").alias("token")).distinct()
    bloom = spark.sparkContext.broadcast(Bloom.build(token_rows, "token"))
    located = stages.write(texts.mapInArrow(lambda b: _locate(b, least, bloom, window), "t1 bigint, t2 bigint, n_words bigint, pieces array<struct<tokens:array<bigint>,pos:int,left:int,words:array<string>>>"), "located")
    counts = located.select(F.explode(F.flatten("pieces.tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(token_rows, "token")
    counts = stages.write(counts, "counts")
    # The prefix token of each distinct window: the rarest shingle, and where it stands.
    distinct = windows.groupBy("words").agg(F.collect_set("item").alias("items"), F.first("tokens").alias("tokens"))
    rated = (distinct.select("words", "items", F.posexplode("tokens").alias("offset", "token")).join(counts, "token", "left")
             .groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("prefix"), F.first("items").alias("items")))
    prefixes = stages.write(rated.select("words", "items", "prefix.token", "prefix.offset").where("prefix.n > 0"), "prefixes")
    prefix_bloom = spark.sparkContext.broadcast(Bloom.build(prefixes.select("token").distinct(), "token"))
    words = located.select("t1", "t2", "n_words")
    hits = (located.where(F.size("pieces") > 0).select("t1", "t2", "n_words", F.inline("pieces"))
            .mapInPandas(lambda b: _prefix_hits(b, prefix_bloom, window), "t1 bigint, t2 bigint, n_words bigint, token bigint, pos int, left int, around array<string>"))
    size, start = F.size("words"), F.col("pos") - F.col("offset")
    spans = (hits.join(prefixes, "token")
             .where((F.col("left") >= F.col("offset")) & (start + size <= F.col("n_words"))
                    & (F.slice("around", F.greatest(F.col("left") - F.col("offset") + 1, F.lit(1)), size) == F.col("words")))
             .select("t1", "t2", F.explode("items").alias("item"), start.alias("start"), size.alias("size")))
    return words, spans


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, t1, t2, n_words, n_hit`` (words
    inside an occurring window), ``items`` (sorted ids of the items found) and
    ``contaminated``. ``t1, t2`` name the text."""
    stages = Stages(spark, "decontam")
    words, spans = find_windows(spark, docs, items, stages, window, k)
    covered = F.flatten(F.collect_set(F.expr("sequence(start, start + size - 1)")))
    found = spans.groupBy("t1", "t2").agg(F.size(F.array_distinct(covered)).cast("bigint").alias("n_hit"),
                                          F.array_sort(F.collect_set("item")).alias("items"))
    n_words = words.groupBy("t1", "t2").agg(F.first("n_words").alias("n_words"))
    # Written, so that the join below has an exchange on either side that Spark can split
    # where very many rows have the same text.
    by_text = stages.write(n_words.join(found, ["t1", "t2"], "left"), "by_text")
    stages.drop("windows", "counts", "prefixes", "located")
    out = docs.select("doc_id", *text_key(F.col("text"))).join(by_text, ["t1", "t2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select("doc_id", "t1", "t2", F.coalesce("n_words", F.lit(0)).cast("bigint").alias("n_words"), n_hit.alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no window of an item."""
    stages = Stages(spark, "decontam")
    _, spans = find_windows(spark, docs, items, stages, window, k)
    found = stages.write(spans.select("t1", "t2").distinct(), "found")
    clean = docs.select(*text_key(F.col("text")), as_row(docs)).join(found, ["t1", "t2"], "left_anti")
    return from_row(clean, docs.columns)
