"""Named file formats as Spark data sources.

* ``token_list`` -- one token per line, plain or ``.gz``; rows ``file, line, token`` with
  the 0-based line inside the file, blank lines dropped. One task reads a file.
* ``caption_json`` -- caption records as JSON lines, plain or ``.gz``; absent fields are
  null, other fields are ignored, blank lines dropped, anything else that is no record is
  an error. Plain files are read in ranges of ``split_bytes`` (64 MiB by default): a line
  belongs to the range that holds its first byte. A gzip file is read by one task.

Both take a file or a folder (names that begin with ``_`` or ``.`` are left out), a local
path or a URI that pyarrow's file systems open, and hand Spark Arrow batches of about
``PIECE`` bytes of whole lines. :func:`register` makes them known to a session.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.json as pj
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 4 << 20
SPLIT_BYTES = 64 << 20

CAPTION_DDL = "booru string, fid bigint, key string, tags array<struct<tag: string, tag_cat: int>>"
CAPTION_ARROW = pa.schema([("booru", pa.string()), ("fid", pa.int64()), ("key", pa.string()),
                           ("tags", pa.list_(pa.struct([("tag", pa.string()), ("tag_cat", pa.int32())])))])


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    if root.startswith("file:"):
        root = "/" + root[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), os.path.abspath(root))


@dataclass
class FileRange(InputPartition):
    """The lines of ``path``, in the file system of ``root``, whose first byte is in
    ``[start, end)``; ``end`` None is the end of the file."""

    root: str
    path: str
    start: int = 0
    end: int | None = None

    def pieces(self) -> Iterator[list[bytes]]:
        """The lines, in order, in lists of about ``PIECE`` bytes."""
        system, _ = _open(self.root)
        file = (system.open_input_stream(self.path, compression="gzip") if self.path.endswith(".gz")
                else system.open_input_file(self.path))
        with io.BufferedReader(file, PIECE) as lines:
            at = self.start
            if at:
                # The line that holds the byte before belongs to an earlier range.
                lines.seek(at - 1)
                at += len(lines.readline()) - 1
            while self.end is None or at < self.end:
                want = PIECE if self.end is None else min(PIECE, self.end - at)
                # readlines(n) goes on until it has more than n bytes, and 0 has no bound.
                piece = lines.readlines(want - 1) if want > 1 else [lines.readline()]
                if not any(piece):
                    return
                at += sum(map(len, piece))
                yield piece


def files_below(root: str) -> list[tuple[str, int]]:
    """``(path, size)`` of a file, or of all files below a folder, by path."""
    system, place = _open(root)
    info = system.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.is_file:
        return [(info.path, info.size)]
    found = system.get_file_info(pafs.FileSelector(place, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "_.")


class _LinesReader(DataSourceReader):
    def __init__(self, options):
        if not options.get("path"):
            raise ValueError("no path to load")
        self.root, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        if self.split < 1:
            raise ValueError(f"split_bytes {self.split}: at least 1")

    def read(self, partition):
        # Spark reads one partition, None, where there are no files.
        return iter(()) if partition is None else self.batches(partition)


class TokenListReader(_LinesReader):
    def partitions(self):
        return [FileRange(self.root, path) for path, _ in files_below(self.root)]

    def batches(self, partition):
        line = 0
        for piece in partition.pieces():
            tokens = pc.replace_substring_regex(pa.array(piece, pa.binary()).cast(pa.string()), r"\r?\n\z", "")
            batch = pa.RecordBatch.from_pydict({
                "file": pa.repeat(pa.scalar(partition.path), len(piece)),
                "line": np.arange(line, line + len(piece)), "token": tokens})
            line += len(piece)
            yield batch.filter(pc.not_equal(tokens, ""))


class CaptionJsonReader(_LinesReader):
    def partitions(self):
        return [FileRange(self.root, path, start, None if path.endswith(".gz") else min(size, start + self.split))
                for path, size in files_below(self.root)
                for start in ([0] if path.endswith(".gz") else range(0, size, self.split))]

    def batches(self, partition):
        options = pj.ParseOptions(explicit_schema=CAPTION_ARROW, unexpected_field_behavior="ignore")
        for piece in partition.pieces():
            text = b"".join(piece)
            if text.strip():
                # One block, so that no record lies across two.
                table = pj.read_json(io.BytesIO(text), pj.ReadOptions(use_threads=False, block_size=len(text) + 1), options)
                yield from table.select(CAPTION_ARROW.names).to_batches()


class TokenList(DataSource):
    @classmethod
    def name(cls):
        return "token_list"

    def schema(self):
        return "file string, line bigint, token string"

    def reader(self, schema):
        return TokenListReader(self.options)


class CaptionJson(DataSource):
    @classmethod
    def name(cls):
        return "caption_json"

    def schema(self):
        return CAPTION_DDL

    def reader(self, schema):
        return CaptionJsonReader(self.options)


def register(spark: SparkSession) -> None:
    """Let ``spark.read.format("token_list" | "caption_json")`` find the sources."""
    for source in (TokenList, CaptionJson):
        spark.dataSource.register(source)
