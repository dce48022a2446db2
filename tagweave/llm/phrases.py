"""Phrase collocations from sorted count streams.

Words and phrases are counted per language, one length after the other: a phrase is
only counted where the two phrases that are one word shorter may reach the least count,
which a Bloom filter of bounded size tells (one that is too full counts more than
needed). Sums are partial per task, then final, and all phrases that reach the least
count are kept.

The kept counts of all lengths make one stream in prefix order (by first word, second,
...), where a phrase stands right after the counts of its own beginnings, and one in
suffix order (by last word, last but one, ...), where it stands after the counts of its
ends. Each stream is dealt out by ranges of that order and sorted, and every task
merges its lengths in lockstep, holding one open count per length: a phrase takes the
left (right) counts that are open, and gives its own count to the phrase it extends. No
table of counts is looked up or hashed. A range can begin in the middle of a beginning:
the few counts that its first rows lack, at most one per length and range, are read
from the kept counts and given to them by a broadcast of no more rows than there are
ranges, so that a word with any share of all phrases is spread over many tasks.

Defined results: null text is empty; null ``lang`` is ``und``; equal scores are ordered
by count, then phrase; repeated rows count again; an empty table gives no rows; columns
other than ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Bloom, Stages, byte_pieces, byte_table, mix, signed, space_parts

MIN_COUNT, LONGEST, TOP, SHARE = 10, 3, 2000, 50
#: Bytes of text that are counted at a time.
PIECE_BYTES = 8 << 20
_BREAK = "\n"
_TABLE = byte_table(lower="", space="\t", line=".,;:!?\n\x0b\x0c\r")


def word_columns(longest: int) -> list[str]:
    return [f"w{i + 1}" for i in range(longest)]


def _hashes(lang: str, words: list) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words], np.uint64)


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all words but the last and that of the last."""
    return mix(before + mix(word))


def _sequence(texts: pa.Array) -> tuple[np.ndarray, list[str], int]:
    """Words of all texts in a row as indices of a list; the break between pieces and
    texts is an index too."""
    raw = "\n".join(["", *texts.to_pylist(), ""]).encode("utf-8", "surrogatepass").translate(_TABLE).replace(b"\n", b" \n ")
    _, parts = space_parts(pa.array([raw], pa.binary()).cast(pa.string()))
    coded = parts.dictionary_encode()
    words = coded.dictionary.to_pylist()
    return coded.indices.to_numpy().astype(np.int64), words, words.index(_BREAK)


def _grams(index: np.ndarray, words: list, cut: int, lang: str, length: int, bloom) -> tuple[np.ndarray, np.ndarray]:
    """First positions of the phrases of ``length`` words that may reach the least count,
    one position per distinct phrase, and how often each occurs."""
    live = index != cut
    if length == 1:
        times = np.bincount(index[live], minlength=len(words))
        first = np.full(len(words), -1)
        first[index[::-1]] = np.arange(len(index))[::-1]
        return first[times > 0], times[times > 0]
    shorter, ids = live.copy(), index
    hashes = _hashes(lang, words)[index]
    run = hashes if length > 2 else None
    for k in range(2, length):  # phrases of length - 1 words: hash and whole-ness by position
        shorter = shorter[:-1] & live[k - 1 :]
        run = _joined(run[:-1], hashes[k - 1 :])
    if length == 2:
        run = hashes
    shorter[shorter] = bloom.has(run[shorter])
    at = np.flatnonzero(shorter[:-1] & shorter[1:])
    if not len(at):
        return at, at
    ids = index[at]
    for k in range(1, length):  # number the distinct phrases word by word, so that keys stay below 2^62
        _, ids = np.unique(ids, return_inverse=True)
        ids = ids * len(words) + index[at + k]
    _, first, times = np.unique(ids, return_index=True, return_counts=True)
    return at[first], times


def _count(batches, length: int, bloom):
    for batch in byte_pieces(batches, "text", PIECE_BYTES):
        for lang in pc.unique(batch["lang"]).to_pylist():
            index, words, cut = _sequence(batch["text"].filter(pc.equal(batch["lang"], lang)))
            at, times = _grams(index, words, cut, lang, length, bloom.value if bloom else None)
            dictionary = pa.array(words, pa.string())
            columns = {f"w{k + 1}": dictionary.take(pa.array(index[at + k])) for k in range(length)}
            n = len(at)
            if length == 1:  # and the total, under no word
                columns, n = {"w1": pa.concat_arrays([columns["w1"], pa.array([None], pa.string())])}, n + 1
                times = np.r_[times, times.sum()]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * n, pa.string()), **columns, "n": pa.array(times.astype(np.int64))})


def _hash_rows(batches, length: int):
    for batch in batches:
        out = np.zeros(len(batch), np.uint64)
        langs = np.array(batch["lang"].to_pylist(), object)
        for lang in set(langs):
            rows = np.flatnonzero(langs == lang)
            some = pa.array(rows)
            run = _hashes(lang, batch["w1"].take(some).to_pylist())
            for k in range(2, length + 1):
                run = _joined(run, _hashes(lang, batch[f"w{k}"].take(some).to_pylist()))
            out[rows] = run
        yield pa.RecordBatch.from_pydict({"h": signed(out)})


def phrase_counts(spark: SparkSession, docs: DataFrame, stages: Stages, longest: int = LONGEST, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """``(counts, totals)``: ``counts(lang, w1 .., n)`` of all words and phrases of up to
    ``longest`` words that occur ``least`` times or more, missing words null; ``totals(lang,
    n)`` counts all words."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    tables, totals, bloom = [], None, None
    for length in range(1, longest + 1):
        names = word_columns(length)
        schema = f"lang string, {', '.join(f'{w} string' for w in names)}, n bigint"
        found = rows.mapInArrow(lambda b, length=length, bloom=bloom: _count(b, length, bloom), schema)
        kept = F.col("n") >= least
        kept = kept | F.col("w1").isNull() if length == 1 else kept
        table = stages.write(found.groupBy("lang", *names).agg(F.sum("n").alias("n")).where(kept), f"counts{length}")
        if length == 1:
            totals, table = table.where("w1 is null").select("lang", "n"), table.where("w1 is not null")
        tables.append(table)
        if length < longest:
            hashed = table.mapInArrow(lambda b, length=length: _hash_rows(b, length), "h bigint")
            bloom = spark.sparkContext.broadcast(Bloom.build(stages.write(hashed, f"hashes{length}"), "h"))
    counts = tables[0]
    for table in tables[1:]:
        counts = counts.unionByName(table, allowMissingColumns=True)
    return counts, totals


def _merge(batches, keys: list[str]):
    """The lockstep merge of one range: ``f1, f2, ..`` of a row are the counts of its first
    1, 2, .. keys where they stand in this range; ``ext`` is the largest count of a row that
    is one key longer. Rows of order 0 carry an ``ext`` for a row of an earlier range."""
    longest = len(keys)
    open_n: dict[int, int | None] = dict.fromkeys(range(1, longest))
    held: dict[int, list] = {}  # order -> [row, its ext]

    def out(rows: pa.RecordBatch, counts: dict, ext) -> pa.RecordBatch:
        for o in range(1, longest):
            rows = rows.append_column(f"f{o}", pa.array(counts[o], pa.int64(), from_pandas=False))
        return rows.append_column("ext", pa.array(ext, pa.int64()))

    for batch in batches:
        batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)  # one schema for all that is made
        order, n = batch["ord"].to_numpy().astype(np.int64), batch["n"].to_numpy().astype(np.int64)
        at, ext, keep = np.arange(len(batch)), np.zeros(len(batch), np.int64), np.ones(len(batch), bool)
        counts, last = {}, {}
        for o in range(1, longest):
            head = np.maximum.accumulate(np.where(order == o, at, -1))
            last[o] = int(head[-1]) if len(head) else -1
            none = open_n[o] is None
            value = np.where(head >= 0, n[np.maximum(head, 0)], 0 if none else open_n[o])
            counts[o] = pa.array(value, mask=(order <= o) | ((head < 0) & none))
            child = order == o + 1
            np.maximum.at(ext, head[child & (head >= 0)], n[child & (head >= 0)])
            early = np.flatnonzero(child & (head < 0))
            if len(early) and o > 1:
                most = int(n[early].max())
                if o in held:
                    held[o][1] = max(held[o][1], most)
                else:  # the row is in an earlier range: a row of order 0 stands for it
                    i = int(early[0])
                    row = batch.slice(i, 1)
                    for k in keys[o:]:
                        row = row.set_column(row.schema.get_field_index(k), k, pa.array([None], pa.string()))
                    row = row.set_column(row.schema.get_field_index("ord"), "ord", pa.array([0], pa.int32()))
                    yield out(row, {j: [None] for j in range(1, longest)}, [most])
            if last[o] >= 0:
                open_n[o] = int(n[last[o]])
        full = out(batch, counts, ext)
        for o in range(2, longest):
            if last[o] >= 0:
                if o in held:
                    row, most = held[o]
                    yield row.set_column(row.schema.get_field_index("ext"), "ext", pa.array([most], pa.int64()))
                held[o] = [full.slice(last[o], 1), int(ext[last[o]])]
                keep[last[o]] = False
        yield full.filter(pa.array(keep))
    for row, most in held.values():
        yield row.set_column(row.schema.get_field_index("ext"), "ext", pa.array([most], pa.int64()))


def lockstep(stream: DataFrame, keys: list[str], stages: Stages, name: str) -> DataFrame:
    """``stream(lang, keys.., ord, n, ..)``, one row per phrase of ``ord`` keys, with the counts
    ``f1, f2, ..`` of its first 1, 2, .. keys and ``ext``, the largest count of a row that
    extends it by a key. Every phrase's beginnings are in the stream."""
    where = ["lang", *keys]
    more = ", ".join(f"f{o} bigint" for o in range(1, len(keys)))
    schema = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes) + f", {more}, ext bigint"
    ranges = stream.repartitionByRange(*where).sortWithinPartitions(*where)
    merged = stages.write(ranges.mapInArrow(lambda b: _merge(b, keys), schema), name)
    out = merged.where("ord > 0")
    for o in range(1, len(keys)):
        head = ["lang", *keys[:o]]
        lacking = merged.where((F.col("ord") > o) & F.col(f"f{o}").isNull()).select(*head).distinct()  # one per range at most
        found = stream.where(F.col("ord") == o).join(F.broadcast(lacking), head, "left_semi").select(*head, F.col("n").alias("found"))
        out = out.join(F.broadcast(found), head, "left").withColumn(f"f{o}", F.when(F.col("ord") > o, F.coalesce(f"f{o}", "found"))).drop("found")
        if o > 1:
            later = merged.where((F.col("ord") == 0) & F.col(keys[o - 1]).isNotNull())
            later = later.where(F.col(keys[o]).isNull()).groupBy(*head).agg(F.max("ext").alias("later"))  # one per range at most
            out = out.join(F.broadcast(later), head, "left").withColumn("ext", F.when(F.col("ord") == o, F.greatest("ext", "later")).otherwise(F.col("ext"))).drop("later")
    return out


def rated_phrases(spark: SparkSession, docs: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT, share: int = SHARE) -> DataFrame:
    """All phrases of 2 to ``longest`` words that occur ``least`` times or more and in no
    longer such phrase that has ``share`` percent of their count: ``lang, phrase, a, l, r,
    n, score`` by the lowest-scoring cut."""
    stages = Stages(spark, "phrases")
    words = word_columns(longest)
    counts, totals = phrase_counts(spark, docs, stages, longest, least)
    order = sum(F.col(w).isNotNull().cast("int") for w in words)
    left = lockstep(counts.select("lang", *words, order.cast("int").alias("ord"), "n"), words, stages, "prefix")
    left = left.withColumnsRenamed({f"f{o}": f"l{o}" for o in range(1, longest)} | {"ext": "left_ext"})
    backward = F.reverse(F.filter(F.array(*words), lambda w: w.isNotNull()))
    keys = [f"k{i + 1}" for i in range(longest)]
    turned = left.withColumn("back", backward).select("lang", *[F.get("back", F.lit(i)).alias(k) for i, k in enumerate(keys)], "ord", "n", "left_ext", *[f"l{o}" for o in range(1, longest)])
    both = lockstep(stages.write(turned, "turned"), keys, stages, "suffix").where("ord > 1")
    exact = lambda c: c.cast("decimal(15,0)")  # noqa: E731  a * a * 10^6 stays below 10^38
    cut = [F.when(F.col("ord") == o, F.array(*[_cut(k, o, exact) for k in range(1, o)])) for o in range(2, longest + 1)]
    best = both.withColumn("cut", F.array_min(F.coalesce(*cut)))
    best = best.where(F.greatest("left_ext", "ext") * 100 < F.col("n") * share)
    phrase = F.concat_ws(" ", *reversed(keys))
    return best.select("lang", phrase.alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", F.col("cut.score").alias("score")).join(F.broadcast(totals), "lang")  # a row per lang


def _cut(k: int, order: int, exact):
    """The cut after the first k of ``order`` words as ``(score, k, l, r)``."""
    a, left, right = exact(F.col("n")), F.col(f"l{k}"), F.col(f"f{order - k}")
    top = F.lit(1_000_000).cast("decimal(7,0)") * a * a
    score = F.call_function("div", top, exact(left) * exact(right))
    return F.struct(score.cast("bigint").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


def collocations(spark: SparkSession, docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = MIN_COUNT, share: int = SHARE) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rated_phrases(spark, docs, longest, least, share).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
