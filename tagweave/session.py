"""Spark session defaults and the shared checkpoint folder.

Everything here is ordinary SparkSession configuration: adaptive query
execution (runtime coalescing, skew-join splitting, runtime broadcast
choice), the UI switched off, and a checkpoint folder that is read from the
cluster configuration and only invented when it is unset (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale. AQE re-plans every exchange with real sizes:
# it coalesces small shuffle partitions, splits skewed join partitions and
# turns a sort-merge join into a broadcast join only when the measured side is
# below ``autoBroadcastJoinThreshold`` -- the size check we rely on for every
# join whose small side is not bounded by construction.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tagweave") -> SparkSession:
    """Return the active session, creating a local one with our defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local") and "SPARK_DRIVER_MEMORY" not in os.environ:
        # A local master runs its tasks in the driver: half of the machine, 16 GB at most.
        half = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // 2**31
        builder = builder.config("spark.driver.memory", f"{max(1, min(16, half))}g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def is_local(master: str) -> bool:
    """Driver and executors are one process on one machine."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS / object store)
    folder and is used as is; a folder set with ``setCheckpointDir`` serves as
    well. Where neither is set, a local master gets a fresh scratch folder and
    any other one an error, since executors would not see the driver's disk.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not conf_dir:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tagweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written stages."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def written_stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, can be
    pruned by column, and tells the planner its size."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tagweave`` importable in executor Python workers (pandas UDFs and
    ``mapInPandas`` functions refer to it): zip the package once per
    application and add it with ``addPyFile``, as ``--py-files`` would."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="tagweave-pkg-"), "tagweave.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, names in os.walk(pkg_dir):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


#: Bytes of an Arrow batch between Spark and a Python worker, and Spark's default. Batches of
#: whole texts are held by the JVM, the worker and the worker's results at the same time.
ARROW_BYTES, ARROW_DEFAULT = 8 << 20, 64 << 20


def bound_arrow_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has a setting of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name in spark.conf.getAll and spark.conf.getAll[name].rstrip("b") != str(ARROW_DEFAULT):
        return
    spark.conf.set(name, str(ARROW_BYTES))


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder, package shipping and batch size for a session we did not create."""
    ensure_checkpoint_dir(spark)
    bound_arrow_batches(spark)
    ship_package(spark)
    return spark
