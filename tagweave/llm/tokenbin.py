"""Token ids in bit-packed binary files.

Documents are dealt out and sorted by ``doc_id``; each task encodes its documents and
writes one file in the shared folder, so files follow one another in document order.
A file is a run of blocks of ``BLOCK`` ids, each id in the fewest bits the vocabulary
needs, then an index: document ids, the documents' first ids, and the blocks' byte
offsets. Any id is found by one division and one offset; a block unpacks with a few
numpy operations.

File layout, little-endian: blocks; int64 document ids; one byte per document that is
1 for a null id; uint64 first id per document and the total; uint64 offset per block
and their end; footer of 40 bytes: uint64 documents, ids, blocks, uint32 bits, block
size, 8 bytes ``TOKFWB01``.

A task writes under a name of its own attempt and renames, so a task that runs twice
leaves one whole file. Folders that pyarrow can open (local, NFS, HDFS, S3, GCS) serve.

Defined results: null text is empty and has the end id alone; null ids come first,
then ascending; rows with equal ids are ordered by their text's hashes and each kept;
an empty table writes no ids; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages, byte_pieces, byte_table, held, ship_file, shipped, space_parts, text_key, translated

BLOCK, MAGIC = 1 << 14, b"TOKFWB01"
#: Bytes of text that a task encodes at a time.
PIECE_BYTES = 8 << 20
_LINES = byte_table(space="\n")


def bits_for(vocabulary: int) -> int:
    """Bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # the same bytes without taking the bits apart
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :bits] = spread
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").reshape(-1)


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class TokenWriter:
    """Appends documents' ids to one file; holds one block and the index."""

    def __init__(self, path: str, vocabulary: int, attempt: str = "0", block: int = BLOCK):
        self.files, self.path = _open(path)
        self.bits, self.block, self.temporary = bits_for(vocabulary), block, f"{self.path}.{attempt}.tmp"
        self.files.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.files.open_output_stream(self.temporary)
        self.doc_ids: list = []
        self.firsts, self.offsets, self.waiting, self.n_waiting = [0], [0], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.firsts.append(self.firsts[-1] + len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // self.block * self.block
            for at in range(0, whole, self.block):
                self._put(flat[at : at + self.block])
            self.waiting, self.n_waiting = [flat[whole:]], len(flat) - whole

    def _put(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.out.write(raw)
        self.offsets.append(self.offsets[-1] + len(raw))

    def close(self) -> None:
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        known = np.array([d is not None for d in self.doc_ids], bool)
        named = np.array([d if d is not None else 0 for d in self.doc_ids], "<i8")
        self.out.write(named.tobytes() + (~known).astype(np.uint8).tobytes() + np.array(self.firsts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([len(named), self.firsts[-1], len(self.offsets) - 1], "<u8").tobytes() + np.array([self.bits, self.block], "<u4").tobytes() + MAGIC)
        self.out.close()
        self.files.move(self.temporary, self.path)


class TokenReader:
    """Random access to the ids of one file."""

    def __init__(self, path: str):
        files, inner = _open(path)
        self.file = files.open_input_file(inner)
        size = self.file.size()
        foot = self.file.read_at(40, size - 40)
        if foot[32:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.n_docs, self.n_ids, n_blocks = map(int, np.frombuffer(foot, "<u8", 3))
        self.bits, self.block = map(int, np.frombuffer(foot, "<u4", 2, 24))
        index = self.n_docs * 9 + 8 * (self.n_docs + 1) + 8 * (n_blocks + 1)
        raw = self.file.read_at(index, size - 40 - index)
        named, null = np.frombuffer(raw, "<i8", self.n_docs), np.frombuffer(raw, np.uint8, self.n_docs, 8 * self.n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(named, null)]
        self.firsts = np.frombuffer(raw, "<u8", self.n_docs + 1, 9 * self.n_docs).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1, 17 * self.n_docs + 8).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (end - 1) // self.block + 1
        raw = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        n = min(b * self.block, self.n_ids) - a * self.block
        return unpack(raw, n, self.bits)[start - a * self.block : end - a * self.block]

    def documents(self) -> Iterator[tuple]:
        """``(doc_id, first id, ids)`` in order, a run of blocks at a time."""
        held, base = np.zeros(0, np.uint32), 0
        for i, doc_id in enumerate(self.doc_ids):
            a, b = int(self.firsts[i]), int(self.firsts[i + 1])
            if b > base + len(held):
                base, held = a, self.ids(a, min(self.n_ids, max(b, a + 16 * self.block)))
            yield doc_id, a, held[a - base : b - base]

    def close(self) -> None:
        self.file.close()


#: What may stand in a normaliser under which text can be cut at white space: none of
#: these moves or joins characters across it.
_PLAIN = {"NFC", "NFD", "Lowercase", "Replace"}


def drops_white_space(tokenizer) -> bool:
    """Whether a tokenizer's own definition allows to encode a text cut at spaces and line
    feeds: its normaliser leaves white space in place, its pre-tokeniser keeps only
    matches of a pattern, none of which holds white space, and no added token does."""
    made = json.loads(tokenizer.to_str())
    normaliser, pre = made["normalizer"] or {"type": "Sequence", "normalizers": []}, made["pre_tokenizer"] or {}
    steps = normaliser["normalizers"] if normaliser["type"] == "Sequence" else [normaliser]
    first = pre["pretokenizers"][0] if pre.get("type") == "Sequence" else pre
    keeps = (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
    for step in steps:
        keeps &= step["type"] in _PLAIN and (step["type"] != "Replace" or (step["pattern"], step["content"]) == ({"Regex": r"\s+"}, " "))
    for token in made["added_tokens"]:
        keeps &= not (token["lstrip"] or token["rstrip"] or token["single_word"] or any(c.isspace() for c in token["content"]))
    if not keeps:
        return False
    signs = [chr(c) for c in range(33, 127)] + ["é", "e\u0301", "日", "\u0301", "٣"]
    return all(tokenizer.encode(f"{x}{gap}{y}", add_special_tokens=False).ids == tokenizer.encode(x, add_special_tokens=False).ids + tokenizer.encode(y, add_special_tokens=False).ids
               for x in signs for y in ("a", "'", "s", "7", "-", "\u0301", "日") for gap in (" ", "\n"))


#: Letters, then ASCII signs without an apostrophe: under :func:`end_marks` one piece each.
_SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+([!-&(-/:-@\\[-`{-~]*)")
#: Words of one call of the tokenizer.
RUN_WORDS = 256


def end_marks(tokenizer) -> np.ndarray | None:
    """Per id whether it ends a piece of the pre-tokenizer, where the tokenizer's definition
    shows that a word of :data:`_SIMPLE` is cut in just its letters and its signs and that
    the last id of each piece is marked by the vocabulary; otherwise None."""
    made = json.loads(tokenizer.to_str())
    normaliser, pre, model = made["normalizer"] or {"type": "Sequence", "normalizers": []}, made["pre_tokenizer"] or {}, made["model"]
    steps = normaliser["normalizers"] if normaliser["type"] == "Sequence" else [normaliser]
    cuts = pre.get("pretokenizers", [pre]) if drops_white_space(tokenizer) else []
    if not cuts or any(step["type"] == "NFD" for step in steps) or [c["type"] for c in cuts[1:]] != ["ByteLevel"] or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"]:
        return None
    kinds = set(cuts[0]["pattern"].get("Regex", "").split("|"))
    whole = {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"}
    if not whole <= kinds or any(not re.fullmatch("'[a-z]+", k) and k != r"[\p{N}]" for k in kinds - whole):
        return None
    suffix = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or model.get("dropout") or model.get("continuing_subword_prefix"):
        return None
    marks = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    marks[[i for piece, i in model["vocab"].items() if piece.endswith(suffix)]] = True
    return marks


class WordEncoder:
    """Encodes whole texts; where the tokenizer's definition shows that it never joins
    anything across a space or line feed (:func:`drops_white_space`), each distinct word of
    a batch once, remembering up to two generations of ``limit`` words, of which the
    older goes when the newer is full. Words new to it go to the tokenizer many in a call and
    are told apart by the ids that end a piece, where :func:`end_marks` has them. Otherwise, or
    with ``by_word=False``, the tokenizer gets the texts as they are."""

    def __init__(self, path: str, end_id: int, by_word: bool = True, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.end_id, self.by_word = end_id, by_word and drops_white_space(self.tokenizer)
        self.marks = end_marks(self.tokenizer) if self.by_word else None
        self.limit, self.known, self.older = limit, {}, {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, words: list[str]) -> list[bytes]:
        """Ids of words, as if each were encoded alone."""
        fits = [_SIMPLE.fullmatch(w) for w in words] if self.marks is not None else []
        pieces = [1 + (m[1] != "") for m in fits if m]
        if not pieces:
            return self._alone(words)
        plain = [w for w, m in zip(words, fits) if m] if len(pieces) < len(words) else words
        runs = [" ".join(plain[i : i + RUN_WORDS]) for i in range(0, len(plain), RUN_WORDS)]
        flat = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)])
        ends, last = np.flatnonzero(self.marks[flat]) + 1, np.cumsum(pieces)
        if len(ends) != last[-1]:
            return self._alone(words)
        raw, at = flat.tobytes(), (ends[last - 1] * 4).tolist()
        out = [raw[a:b] for a, b in zip([0, *at], at)]
        if plain is words:
            return out
        out, rest = iter(out), iter(self._alone([w for w, m in zip(words, fits) if not m]))
        return [next(out if m else rest) for m in fits]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words as bytes."""
        if len(self.known) >= self.limit:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh = [w for w in words if w not in known and (w not in older or known.setdefault(w, older[w]) is None)]
        known.update(zip(fresh, self._fresh(fresh)))
        return [known[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(firsts, ids)`` of texts without nulls in a row, the end id after each."""
        if self.by_word:
            starts, parts = space_parts(translated(texts, _LINES))
            coded = parts.dictionary_encode()
            found, index = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
        else:
            found, index, starts = self._alone(texts.to_pylist()), np.arange(len(texts)), np.arange(len(texts) + 1)
        # The end id stands as one more word after the words of each text.
        found.append(np.array([self.end_id], "<u4").tobytes())
        order = np.insert(index.astype(np.int64), starts[1:], len(found) - 1)
        taken = pa.array(found, pa.large_binary()).take(pa.array(order))
        offsets = np.frombuffer(taken.buffers()[1], "<i8")[: len(order) + 1] // 4
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4")
        return offsets[starts + np.arange(len(starts))], ids


def _write(batches, folder: str, tokenizer: str, end_id: int, by_word: bool):
    task = TaskContext.get()
    encoder = held(("token files", tokenizer, end_id, by_word), lambda: WordEncoder(shipped(tokenizer), end_id, by_word))
    name = f"{folder}/part-{task.partitionId():08d}.tok"
    writer = TokenWriter(name, max(encoder.vocabulary, end_id + 1), str(task.taskAttemptId()))
    for batch in byte_pieces(batches, "text", PIECE_BYTES):
        firsts, ids = encoder.encode(batch["text"])
        for doc_id, known, a, b in zip(batch["doc_id"].to_pylist(), batch["named"].to_pylist(), firsts[:-1].tolist(), firsts[1:].tolist()):
            writer.add(doc_id if known else None, ids[a:b])
    writer.close()
    yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [name], "n_docs": pa.array([len(writer.doc_ids)], pa.int64()), "n_ids": pa.array([writer.firsts[-1]], pa.int64())})


def write_token_files(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int, by_word: bool = True) -> DataFrame:
    """Write ``docs(doc_id, text)`` to files under ``folder``; returns the written
    manifest ``(part, path, n_docs, n_ids)``, one row per file in document order."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"),
                       F.coalesce("text", F.lit("")).alias("text"), *text_key(F.col("text")))
    order = ["named", "doc_id", "t1", "t2"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "named", "text")
    shipped_as = ship_file(spark, tokenizer)
    manifest = dealt.mapInArrow(lambda b: _write(b, folder, shipped_as, end_id, by_word), "part int, path string, n_docs bigint, n_ids bigint")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        for path, base in zip(files["path"], files["base"]):
            reader, out = TokenReader(path), []
            for doc_id, first, ids in reader.documents():
                out.append((doc_id, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(out) == 10_000:
                    yield _frame(out)
                    out = []
            reader.close()
            yield _frame(out)


def _frame(rows: list) -> pd.DataFrame:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pd.DataFrame({"doc_id": pd.array(columns[0], "Int64"), "start": np.array(columns[1], np.int64),
                         "n_tokens": np.array(columns[2], np.int64), "ids_crc32": np.array(columns[3], np.int64)})


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest: ``(doc_id, start, n_tokens, ids_crc32)``."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = based.repartition(max(1, manifest.count()), "path")
    return files.mapInPandas(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, by_word: bool = True) -> DataFrame:
    """Write ``docs`` to token files in ``folder`` (a new one in the shared folder
    unless given), read them back and return ``(doc_id, start, n_tokens, ids_crc32)``."""
    folder = folder or Stages(spark, "tokens").path("files")
    return read_token_files(spark, write_token_files(spark, docs, folder, tokenizer, end_id, by_word))
