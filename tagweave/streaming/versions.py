"""A table of newest values by key that grows by versions (R-2).

A version adds one part, the rows that changed, so that what a trigger writes is in
proportion to what it changed. A manifest, one small file per version that appears by a
rename when its parts are whole, names the parts of the table; a reader takes the newest
manifest and, per key, the row of the newest version. Before a version is published, the
newest parts are merged into one as long as the part before them has at most twice their
bytes: there are about log(size) parts, and a row is written again about log(size) times.
Manifests beyond the last ``KEPT`` expire with the parts that only they name, so that a
reader who holds one of the last versions goes on undisturbed. There is one writer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import listing, remove

#: Versions that readers may still hold.
KEPT = 3
VERSION = "_version"


class VersionedTable:
    """Rows of ``schema`` at ``path``, one per value of ``keys`` (the other columns are values)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.stored = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType())])

    def versions(self) -> list[int]:
        """Numbers of the published versions that are kept, ascending."""
        names = [path.rsplit("/", 1)[-1] for path, size, _ in listing(self.spark, f"{self.path}/_versions") if size >= 0]
        return sorted(int(name) for name in names if name.isdigit())

    def parts(self, version: int) -> list[str]:
        """Names of the parts of a version, oldest first."""
        place, files = self._place(f"_versions/{version}")
        stream = files.open(place)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a kept version (None: the newest); no version: no rows."""
        held = self.versions()
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(self.parts(held[-1] if version is None else version)).select(*self.schema.names)

    def publish(self, changes: DataFrame, version: int) -> None:
        """Add the changed rows, one per key, as ``version``. The last version again (its
        writer failed after it was published) changes nothing; an older one is an error."""
        held = self.versions()
        if held and version <= held[-1]:
            if version < held[-1]:
                raise ValueError(f"version {version} at {self.path}, which holds {held[-1]}: the stream's checkpoint is not this table's")
            return
        parts = self.parts(held[-1]) if held else []
        parts.append(self._write(changes.select(*self.schema.names, F.lit(version).cast("long").alias(VERSION))))
        first, total = len(parts) - 1, self._bytes(parts[-1])
        while first and (before := self._bytes(parts[first - 1])) <= 2 * total:
            first, total = first - 1, total + before
        if first < len(parts) - 1:
            parts[first:] = [self._write(self._merged(parts[first:]))]
        self._put(f"_versions/{version}", "\n".join(parts))
        self._expire()

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, name: str, text: str) -> None:
        """A file that is there as a whole or not at all."""
        place, files = self._place(name)
        unfinished, _ = self._place(f"_unfinished-{uuid.uuid4().hex}")
        stream = files.create(unfinished, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        files.mkdirs(place.getParent())
        if not files.rename(unfinished, place):
            raise OSError(f"{place} could not be published")

    def _write(self, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _bytes(self, part: str) -> int:
        return sum(size for _, size, _ in listing(self.spark, f"{self.path}/{part}"))

    def _merged(self, parts: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self.stored).parquet(*(f"{self.path}/{part}" for part in parts))
        if len(parts) == 1:
            return rows
        values = [c for c in self.stored.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), VERSION).alias("_newest"))
        return newest.select(*self.keys, *(F.col(f"_newest.{c}").alias(c) for c in values)).select(*self.stored.names)

    def _expire(self) -> None:
        held = self.versions()
        for version in held[:-KEPT]:
            remove(self.spark, f"{self.path}/_versions/{version}")
        named = {part for version in held[-KEPT:] for part in self.parts(version)}
        place, files = self._place("")
        for status in files.listStatus(place):
            name = status.getPath().getName()
            if name.startswith("part-") and name not in named:
                remove(self.spark, f"{self.path}/{name}")
