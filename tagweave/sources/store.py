"""Stored results: bucketed tables and a cache that follows its inputs.

A result is built once per application and kept under a key of its inputs' files (path,
length, time), its parameters and the code's version, so that changed input is seen;
``overwrite`` builds it again and removes the earlier one. What is kept is removed when
the driver ends. Tables keyed by file are bucketed and sorted by that key in the session
catalog, with their files in the shared folder, so that joins and groupings on the key
(or on more columns) read co-located rows without an exchange.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

#: Bytes of input per bucket, and the most buckets that Spark takes by default. A line item
#: becomes several tags, so that a bucket in memory has some 40 times these bytes.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 100_000
#: Raise when stored results of the same inputs would differ.
VERSION = 1


def listing(spark: SparkSession, *paths: str) -> list[tuple[str, int, int]]:
    """``(path, length, time)`` of all files at or below the paths, by name; a path that
    is not there has length -1."""
    out, conf = [], spark._jsc.hadoopConfiguration()
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(conf)
        if not files.exists(path):
            out.append((name, -1, 0))
            continue
        found = files.listFiles(path, True)
        while found.hasNext():
            status = found.next()
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(out)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class ResultCache:
    """Results by name; one entry per key of inputs and parameters."""

    def __init__(self):
        self.entries: dict = {}

    def get(self, spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[str, list], object],
            params: Sequence = (), overwrite: bool = False):
        """What ``build(folder, files)`` returned for these inputs; it writes below ``folder``."""
        files = listing(spark, *inputs)
        text = repr((name, files, list(params), VERSION))
        key = (spark.sparkContext.applicationId, name, hashlib.sha256(text.encode()).hexdigest())
        if overwrite and key in self.entries:
            remove(spark, self.entries.pop(key)[0])
        if key not in self.entries:
            folder = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
            if not self.entries:
                atexit.register(self.clear, spark)
            self.entries[key] = (folder, build(folder, files))
        return self.entries[key][1]

    def clear(self, spark: SparkSession) -> None:
        """Remove all that is kept, as far as the file system can still be reached."""
        for folder, _ in self.entries.values():
            try:
                remove(spark, folder)
            except Exception:  # noqa: BLE001  the JVM may be gone when the driver ends
                break
        self.entries.clear()


RESULTS = ResultCache()


def buckets_for(spark: SparkSession, files: list[tuple[str, int, int]]) -> int:
    size = sum(max(0, n) for _, n, _ in files)
    return min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)))


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int, order: Sequence[str] = (),
                   dealt: bool = False) -> str:
    """``df`` as a table of ``buckets`` files at ``path``, each sorted by ``keys`` and ``order``; the
    rows are dealt out as the buckets are (``dealt``: they already lie so), so that a task
    writes one file. Returns its name."""
    name = f"stored_{uuid.uuid4().hex[:12]}"
    rows = df if dealt else df.repartition(buckets, *keys)
    (rows.write.format("parquet").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(name))
    return name


def create_table(spark: SparkSession, path: str, columns: str, partition_by: str) -> str:
    """An empty catalog table of ``columns`` (DDL) with its files at ``path``, partitioned by one
    of them, which then comes last; rows are put in with ``insertInto``. Returns its name."""
    name = f"stored_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({partition_by}) LOCATION '{path}'")
    return name


#: Partitions that one task writes side by side; with more, it sorts what it has left.
OPEN_PARTITIONS = 8


def insert_into(rows: DataFrame, table: str, overwrite: bool = False) -> None:
    """Insert rows into a partitioned table, columns by name; with ``overwrite`` the partitions
    that get rows are replaced and the others stay. A task keeps a file open per partition, so
    that rows are not sorted by partition first."""
    conf = rows.sparkSession.conf
    # The writer's option of the first name does not reach insertInto.
    wanted = {"spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_PARTITIONS)}
    before = {name: conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        conf.set(name, value)
    try:
        rows.select(*rows.sparkSession.table(table).columns).write.insertInto(table, overwrite=overwrite)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
