"""Alignment of two tokenizers over the same texts.

Both id lists of a text are laid over its bytes. The cumulative byte ends of each list
are a dictionary from end to index; the ends that both dictionaries hold (an
intersection of hash sets), in order, slice both lists into groups, and the links of a
slice, its pairs of tokens whose bytes overlap, are expanded from its ends.

A text is cut before every single space between two characters that are no white
space, where neither tokenizer joins anything: such a cut is an end of both lists, so
that a text's groups and links are those of its segments in a row. A segment is encoded
and sliced once per batch of texts, many of them with their bytes in a row, and
remembered in bounded memory. Whether the two
tokenizers allow it is read from their definitions when they are loaded
(:func:`splits_at_spaces`); otherwise a text is one segment.

Links are counted per pair of ids over the whole corpus: distinct pairs per text, then
partial and final sums. Their counts come back to the texts in two ways that together
cover every pair: the pairs that hold a ``HEAVY``-th of all links, of which there can be
no more than ``HEAVY``, by broadcast; all others, each of them in few texts, by a join.

Defined results: null and empty texts, and texts whose joined token bytes differ from a
space and the text in either list, have no tokens, zeros and an empty digest; each row
of a repeated id or text is answered; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY, Stages, byte_pieces, heavy_and_tail, held, per_text, ship_file, shipped, space_parts, spans_of

#: Bytes of text that are aligned at a time.
PIECE_BYTES = 4 << 20
#: Remembered segments of a task.
KNOWN = 400_000
#: New segments that are aligned at a time, and that are encoded as one text.
AT_ONCE, JOINED = 50_000, 500
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself,
    the other bytes in order for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level tokenizer file; encodes a space and the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes = [b""] * self.size
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def splits_at_spaces(self) -> bool:
        made = json.loads(self.tokenizer.to_str())
        pre = made["pre_tokenizer"] or {}
        return made["normalizer"] is None and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True)


class PieceBpe:
    """A sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def splits_at_spaces(self) -> bool:
        """No piece goes on after a character with a space, and spaces stay as they are."""
        whole = "a b" + 3 * " " + "c"
        return (not any(re.search("[^▁]▁", p) for p in self.pieces)
                and b"".join(self.bytes[i] for i in self.model.encode(whole)) == (" " + whole).encode())


def splits_at_spaces(a: ByteBpe, b: PieceBpe) -> bool:
    """Neither tokenizer joins anything across a single space between two characters that
    are no white space: the byte-level pattern begins a word there, and no piece of the
    other vocabulary holds a space after another character."""
    return a.splits_at_spaces() and b.splits_at_spaces()


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either list end at or before each common byte end, in order:
    the keys that both dictionaries from end to index hold."""
    index_a, index_b = dict(zip(ends_a.tolist(), count(1))), dict(zip(ends_b.tolist(), count(1)))
    common = sorted(index_a.keys() & index_b.keys())
    return tuple(np.fromiter(map(index.__getitem__, common), np.int64, len(common)) for index in (index_a, index_b))


def expand(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, end)``: index pairs of the tokens that overlap, in order. Each end of either
    list closes the last stretch of bytes that one pair shares."""
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")
    ends = ends[np.diff(ends, prepend=0) > 0]
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), ends


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and the length of each list."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(lengths.sum())), lengths


class Spelling:
    """The bytes of every token of a vocabulary in one row."""

    def __init__(self, tokens: list[bytes]):
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def equals(self, ids: np.ndarray, counts: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of each list of ``counts`` ids are its ``sizes`` bytes of ``text``."""
        lengths = self.lengths[ids]
        same = per_text(lengths, offsets(counts)) == sizes
        of_ids = np.repeat(same, counts)
        got = self.blob[spans_of(self.starts[ids[of_ids]], lengths[of_ids])]
        same[same] = per_text((got != text[np.repeat(same, sizes)]).astype(np.int64), offsets(sizes[same])) == 0
        return same


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(lengths)]


class Decimals:
    """Decimal numbers as bytes."""

    def __init__(self, size: int):
        width = len(str(size))
        names = [str(i).encode() for i in range(size)]
        self.lengths = np.fromiter(map(len, names), np.int64, size)
        self.digits = np.frombuffer(b"".join(n.ljust(width) for n in names), np.uint8).reshape(size, width)

    def row(self, numbers: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The numbers in a row, a mark after each, and where each begins."""
        lengths = self.lengths[numbers]
        at = offsets(lengths + 1)
        out = np.empty(at[-1], np.uint8)
        for k in range(self.digits.shape[1]):
            has = lengths > k
            out[at[:-1][has] + k] = self.digits[numbers[has], k]
        out[at[1:] - 1] = marks
        return out.tobytes(), at


class Aligner:
    """Aligns segments and remembers up to about ``known`` of them, those met again for longer."""

    def __init__(self, path_a: str, path_b: str, known: int = KNOWN):
        self.a, self.b, self.limit = ByteBpe(path_a), PieceBpe(path_b), known
        self.split = splits_at_spaces(self.a, self.b)
        self.spell_a, self.spell_b = Spelling(self.a.bytes), Spelling(self.b.bytes)
        self.decimals = Decimals(max(self.a.size, self.b.size))
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.groups: list[bytes] = []  # `a1,a2|b1;a3|b2,b3;`
        self.links, self.counts = array("q"), array("q")  # counts: n_a, n_b, n_groups, n_links, bytes equal
        self.met = np.zeros(0, np.int32)  # batches that held a segment

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """``(order, starts, parts)``: the segments of text ``order[i]``."""
        if not self.split:
            return np.arange(len(texts)), np.arange(len(texts) + 1), texts
        starts, parts = space_parts(texts, keep_empty=True)
        coded = parts.dictionary_encode()
        odd = np.array([not w or w.strip() != w for w in coded.dictionary.to_pylist()], bool)
        mixed = per_text(odd[coded.indices.to_numpy()].astype(np.int64), starts) > 0
        if not mixed.any():
            return np.arange(len(texts)), starts, parts
        plain, odd = np.flatnonzero(~mixed), np.flatnonzero(mixed)
        split = [_CUT.split(" " + t) for t in texts.take(pa.array(odd)).to_pylist()]
        rest = pa.array([w for first, *more in split for w in (first[1:], *more)], pa.string())
        starts, parts = space_parts(texts.take(pa.array(plain)), keep_empty=True)
        return np.r_[plain, odd], np.r_[starts, starts[-1] + np.cumsum([len(s) for s in split])], pa.concat_arrays([parts, rest])

    def rows_of(self, segments: list[str]) -> np.ndarray:
        fresh = [s for s in segments if s not in self.rows]
        if len(self.rows) + len(fresh) > self.limit:
            self._forget()
            fresh = [s for s in segments if s not in self.rows]
        for start in range(0, len(fresh), AT_ONCE):
            self._add(fresh[start : start + AT_ONCE])
        rows = np.fromiter(map(self.rows.__getitem__, segments), np.int64, len(segments))
        self.met = np.r_[self.met, np.zeros(len(self.rows) - len(self.met), np.int32)]
        self.met[rows] += 1
        return rows

    def _forget(self) -> None:
        """Keep the segments met in more than one batch, unless they are half of what may be kept."""
        kept, rows, named, met = np.flatnonzero(self.met > 1), [*self.rows], self.groups, self.met
        counts, links = self._arrays()
        self._clear()
        if len(kept) > self.limit // 2:
            return
        self.rows = {rows[r]: k for k, r in enumerate(kept.tolist())}
        self.groups, self.met = [named[r] for r in kept.tolist()], met[kept]
        first = np.cumsum(counts[:, 3]) - counts[:, 3]
        self.counts.frombytes(counts[kept].tobytes())
        self.links.frombytes(links[spans_of(first[kept], counts[kept, 3])].tobytes())

    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """The counts, a row per segment, and the links of all segments."""
        return np.frombuffer(self.counts.tobytes(), np.int64).reshape(-1, 5), np.frombuffer(self.links.tobytes(), np.int64)

    def _add(self, fresh: list[str]) -> None:
        """Align new segments, their bytes laid one after the other."""
        raw = [(" " + s).encode("utf-8", "surrogatepass") for s in fresh]
        sizes, text = np.fromiter(map(len, raw), np.int64, len(raw)), np.frombuffer(b"".join(raw), np.uint8)
        ids_a, n_a = self._encode_a(fresh, sizes)
        ids_b, n_b = flat(self.b.encode(fresh))
        same = self.spell_a.equals(ids_a, n_a, text, sizes) & self.spell_b.equals(ids_b, n_b, text, sizes)
        ids_a, ids_b = ids_a[np.repeat(same, n_a)], ids_b[np.repeat(same, n_b)]
        ends_a, ends_b = np.cumsum(self.spell_a.lengths[ids_a]), np.cumsum(self.spell_b.lengths[ids_b])
        segment_ends = offsets(np.where(same, sizes, 0))
        i1, j1 = align(ends_a, ends_b)
        i, j, ends = expand(ends_a, ends_b)
        links = np.searchsorted(ends, segment_ends, "right")
        groups = np.searchsorted(ends_a[i1 - 1], segment_ends, "right")
        # Tokens in the order of the digest: those of A of a group, then those of B.
        numbers, marks = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        i0, j0 = offsets(np.diff(i1, prepend=0))[:-1], offsets(np.diff(j1, prepend=0))[:-1]
        numbers[np.arange(len(ids_a)) + np.repeat(j0, i1 - i0)] = ids_a
        numbers[np.arange(len(ids_b)) + np.repeat(i1, j1 - j0)] = ids_b
        marks[i1 + j0 - 1], marks[i1 + j1 - 1] = ord("|"), ord(";")
        row, at = self.decimals.row(numbers, marks)
        cuts = at[offsets(np.where(same, n_a + n_b, 0))].tolist()
        self.groups.extend([row[s:e] for s, e in zip(cuts, cuts[1:])])
        self.links.frombytes((ids_a[i] * self.b.size + ids_b[j]).tobytes())
        self.counts.frombytes(np.stack([n_a, n_b, np.diff(groups), np.diff(links), same], axis=1).astype(np.int64).tobytes())
        self.rows.update(zip(fresh, count(len(self.rows))))

    def _encode_a(self, segments: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments in a row and their numbers. Where the tokenizers allow cuts, segments
        that start and end with a character that is no white space are encoded joined by spaces."""
        if not self.split:
            return flat(self.a.encode(segments))
        joins = np.fromiter((s != "" and s.strip() == s for s in segments), bool, len(segments))
        if not joins.all():
            counts, at = np.zeros(len(segments), np.int64), np.flatnonzero
            parts = [self._encode_joined([segments[k] for k in at(joins)], sizes[joins]), flat(self.a.encode([segments[k] for k in at(~joins)]))]
            counts[joins], counts[~joins] = parts[0][1], parts[1][1]
            ids, of_joined = np.empty(int(counts.sum()), np.int64), np.repeat(joins, counts)
            ids[of_joined], ids[~of_joined] = parts[0][0], parts[1][0]
            return ids, counts
        return self._encode_joined(segments, sizes)

    def _encode_joined(self, segments: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, _ = flat(self.a.encode([" ".join(segments[k : k + JOINED]) for k in range(0, len(segments), JOINED)]))
        ends, bounds = np.cumsum(self.spell_a.lengths[ids]), np.cumsum(sizes)
        last = np.searchsorted(ends, bounds)
        if len(ids) and (ends[-1] != bounds[-1] or (ends[last] != bounds).any()):
            return flat(self.a.encode(segments))
        return ids, np.diff(np.r_[0, last + 1])

    def texts(self, texts: pa.Array) -> dict[str, np.ndarray | pa.Array]:
        """Counts, digest and distinct links (``keys`` a * size of B + b, ``times``) per text."""
        order, starts, parts = self.segments(texts)
        coded = parts.dictionary_encode()
        rows = self.rows_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        counts, links = self._arrays()
        first = np.cumsum(counts[:, 3]) - counts[:, 3]
        # Segments whose bytes agree make a text whose bytes agree. One that differs makes a text
        # that differs: no tokenizer here moves bytes from one segment into another.
        bad = per_text(1 - counts[rows, 4], starts) > 0
        bad |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)[order]
        sums = {c: np.where(bad, 0, per_text(counts[rows, k], starts)) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        named = self.groups
        index = rows.tolist()
        digests = ["" if b else hashlib.sha256(b"".join([named[r] for r in index[s:e]])[:-1]).hexdigest() for b, s, e in zip(bad.tolist(), starts[:-1].tolist(), starts[1:].tolist())]
        text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
        live = ~bad[text_of]
        rows, text_of = rows[live], text_of[live]
        pairs = self.a.size * self.b.size
        every = np.repeat(text_of, counts[rows, 3]) * pairs + links[spans_of(first[rows], counts[rows, 3])]
        every, times = np.unique(every, return_counts=True)
        offsets = np.searchsorted(every, np.arange(len(texts) + 1, dtype=np.int64) * pairs).astype(np.int32)
        back = np.argsort(order)
        lists = {"keys": pa.ListArray.from_arrays(pa.array(offsets), pa.array(every % pairs)), "times": pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int32)))}
        return {c: v[back] for c, v in sums.items()} | {"groups_sha256": pa.array(digests, pa.string()).take(pa.array(back))} | {c: v.take(pa.array(back)) for c, v in lists.items()}


_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"


def _align(batches, name_a: str, name_b: str):
    aligner = held(("align", name_a, name_b), lambda: Aligner(shipped(name_a), shipped(name_b)))
    uid = TaskContext.get().partitionId() << 33
    for batch in byte_pieces(batches, "text", PIECE_BYTES):
        found = aligner.texts(batch["text"].cast(pa.string()))
        n = len(batch)
        yield pa.RecordBatch.from_pydict({"uid": np.arange(uid, uid + n), "doc_id": batch["doc_id"], **found})
        uid += n


def aligned_texts(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per row with its counts, the digest of its groups
    and its distinct links. ``uid`` names a row once this is written."""
    a, b = ship_file(spark, path_a), ship_file(spark, path_b)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lambda batches: _align(batches, a, b), f"uid bigint, doc_id bigint, {_COUNTS}, groups_sha256 string, keys array<bigint>, times array<int>")


def link_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``(key, n, best)``: how many links of the corpus hold a pair, and whether no pair
    of its B id is in more (one row per id of B is broadcast)."""
    counts = aligned.select(F.inline(F.arrays_zip("keys", "times"))).groupBy(F.col("keys").alias("key")).agg(F.sum("times").alias("n"))
    return counts.withColumn("b", F.col("key") % size_b)


def _look_up(batches, table):
    keys, n, best = table.value
    for batch in batches:
        lists, times = batch["keys"], batch["times"].flatten().to_numpy().astype(np.int64)
        own = lists.flatten().to_numpy()
        starts = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))]
        at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        counted = np.where(known, times * n[at], 0) if len(keys) else np.zeros(len(own), np.int64)
        bests = np.where(known & best[at], times, 0) if len(keys) else counted
        rest = np.r_[0, np.cumsum(~known)][starts].astype(np.int32)
        yield pa.RecordBatch.from_pydict({
            **{c: batch[c] for c in ("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": per_text(bests, starts), "count_sum": per_text(counted, starts),
            "groups_sha256": batch["groups_sha256"], "keys": pa.ListArray.from_arrays(pa.array(rest), pa.array(own[~known])),
            "times": pa.ListArray.from_arrays(pa.array(rest), pa.array(times[~known].astype(np.int32)))})


def align_tokenizers(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, heavy: int = HEAVY) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_a, n_b, n_groups, n_links, n_best`` (links
    whose pair is the most counted of its B id), ``count_sum`` and ``groups_sha256``."""
    stages = Stages(spark, "align")
    size_b = PieceBpe(path_b).size
    aligned = stages.write(aligned_texts(spark, docs, path_a, path_b), "aligned")
    counts = stages.write(link_counts(aligned, size_b), "counts")
    most = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))  # at most one row per id of B
    rated = stages.write(counts.join(most, "b").select("key", "n", (F.col("n") == F.col("most")).alias("best")), "rated")
    most_linked, rest = heavy_and_tail(rated, heavy=heavy)
    table = most_linked.orderBy("key").toArrow()
    table = spark.sparkContext.broadcast((table["key"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()))
    schema = f"uid bigint, doc_id bigint, {_COUNTS}, n_best bigint, count_sum bigint, groups_sha256 string, keys array<bigint>, times array<int>"
    partial = stages.write(aligned.mapInArrow(lambda b: _look_up(b, table), schema), "partial")
    stages.drop("aligned", "counts")
    more = (partial.select("uid", F.inline(F.arrays_zip("keys", "times"))).withColumnRenamed("keys", "key").join(rest, "key")
            .groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    add = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).cast("bigint").alias(c)
    return partial.drop("keys", "times").join(more, "uid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "more_best"), add("count_sum", "more_sum"), "groups_sha256")
