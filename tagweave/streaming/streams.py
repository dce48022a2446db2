"""Structured Streaming forms of the pipeline (R-1, R-2).

* :func:`prevalence_stream` -- label prevalence that grows as tag files arrive
  (A14 / A15 on a stream): a streaming ``groupBy(label).count()`` in
  ``update`` mode; the state is one row per label in the state store, and a
  trigger writes the labels whose count changed as a version of a
  :class:`~tagweave.streaming.versions.VersionedTable`.
* :func:`caption_example_stream` -- caption records (one row per file with
  its tag array) arrive; every micro-batch is turned into examples by the
  batch functions (``foreachBatch``). A micro-batch holds whole captions, so
  no cross-batch state is needed, unless records can arrive twice: with
  ``repeats_within`` they carry a time, and the key of a record is kept in the
  state store until the watermark has passed its time by that delay.

Both read a file source. The caller names the stream's checkpoint (by default
beside the output), so a query that is started again goes on where it stopped.
A micro-batch publishes the version, or writes the folder with overwrite, of its
own number, so a batch that runs twice after a failure leaves its rows once.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CaptionConfig
from ..functions.text import ascii_lower
from ..operators import captions as cp
from ..operators.tokenize import Vocabulary
from .versions import VersionedTable

TAG_EVENT_SCHEMA = T.StructType([
    T.StructField("booru", T.StringType()),
    T.StructField("fid", T.LongType()),
    T.StructField("tag", T.StringType()),
    T.StructField("tag_cat", T.IntegerType()),
])

CAPTION_RECORD_SCHEMA = T.StructType([
    T.StructField("booru", T.StringType()),
    T.StructField("fid", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StructType([
        T.StructField("tag", T.StringType()),
        T.StructField("tag_cat", T.IntegerType()),
    ]))),
])

TIMED_RECORD_SCHEMA = T.StructType([*CAPTION_RECORD_SCHEMA.fields, T.StructField("arrived", T.TimestampType())])

#: Bytes of input files in a micro-batch, about.
BYTES_PER_TRIGGER = 8 << 30


def _source(spark: SparkSession, schema: T.StructType, source_dir: str, files_per_trigger: int | None) -> DataFrame:
    """The file source, cut into micro-batches by bytes unless a number of files is given."""
    reader = spark.readStream.schema(schema)
    reader = (reader.option("maxBytesPerTrigger", BYTES_PER_TRIGGER) if files_per_trigger is None
              else reader.option("maxFilesPerTrigger", files_per_trigger))
    return reader.parquet(source_dir)


PREVALENCE_SCHEMA = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("prevalence", T.LongType()),
])


def prevalence_table(spark: SparkSession, out_dir: str) -> VersionedTable:
    return VersionedTable(spark, out_dir, PREVALENCE_SCHEMA, ["label"])


def latest_result(spark: SparkSession, out_dir: str) -> DataFrame:
    """``label, prevalence`` of the newest published version under ``out_dir``, whole at any time."""
    return prevalence_table(spark, out_dir).read()


def prevalence_stream(spark: SparkSession, source_dir: str, out_dir: str, general: bool | None,
                      files_per_trigger: int | None = None, checkpoint: str | None = None):
    """Start the growing-prevalence query; returns the StreamingQuery.

    ``general`` True / False selects the category side (None: all rows). Each
    trigger publishes the counts that it changed as a version of the table at
    ``out_dir``; read the newest with :func:`latest_result`.
    """
    rows = _source(spark, TAG_EVENT_SCHEMA, source_dir, files_per_trigger)
    if general is True:
        rows = rows.where(F.col("tag_cat") == 0)
    elif general is False:
        rows = rows.where(F.col("tag_cat") != 0)
    counts = (rows.groupBy(ascii_lower("tag").alias("label"))
              .agg(F.count(F.lit(1)).alias("prevalence")))

    table = prevalence_table(spark, out_dir)
    return (counts.writeStream.outputMode("update").foreachBatch(table.publish)
            .option("checkpointLocation", checkpoint or f"{out_dir}-checkpoint")
            .trigger(availableNow=True).start())


def caption_records(files: DataFrame, tags: DataFrame) -> DataFrame:
    """One record per file: key ``BOORU_FID`` and its tags sorted.

    A left join keeps files without tags (empty list).
    """
    per_file = tags.groupBy("booru", "fid").agg(
        F.sort_array(F.collect_set(F.struct("tag", "tag_cat"))).alias("tags"))
    return (files.select("booru", "fid").join(per_file, ["booru", "fid"], "left")
            .select("booru", "fid",
                    F.concat_ws("_", "booru", F.col("fid").cast("string")).alias("key"),
                    F.coalesce("tags", F.array().cast(CAPTION_RECORD_SCHEMA["tags"].dataType))
                    .alias("tags")))


def examples_of_records(records: DataFrame, vocab: Vocabulary,
                        cfg: CaptionConfig = CaptionConfig()) -> DataFrame:
    """Caption records -> examples with the batch operators (C1-C8). Records are dealt out by
    file before they become tags, so that tags are not exchanged."""
    lying = records.select("booru", "fid", F.inline("tags"))
    tags = records.repartition("booru", "fid").select("booru", "fid", F.inline("tags"))
    labelled = cp.caption_candidates(tags, vocab, cfg, lying)
    return cp.examples(cp.suitable_captions(labelled, vocab, cfg), cfg)


#: Keys of records are kept in RocksDB, on the executors' disks: the default store holds all of them,
#: some hundred bytes each, in the executors' heaps. Its memory is bounded for an executor.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started inside keep their state on disk; settings of the session's own stay."""
    added = [name for name in ON_DISK if name not in spark.conf.getAll]
    for name in added:
        spark.conf.set(name, ON_DISK[name])
    try:
        yield
    finally:
        for name in added:
            spark.conf.unset(name)


def first_arrivals(records: DataFrame, delay: str) -> DataFrame:
    """Timed records (``arrived``), each ``key`` once: a record whose key came before within
    ``delay`` of its time is dropped, and so is one that arrives later than that behind the
    newest time. The watermark starts at 1970, so that earlier times are late. Which of
    several records of one key and micro-batch stays is open; they are copies."""
    return (records.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["key"])
            .drop("arrived"))


def caption_example_stream(spark: SparkSession, source_dir: str, out_dir: str, vocab: Vocabulary,
                           cfg: CaptionConfig = CaptionConfig(), files_per_trigger: int | None = None,
                           checkpoint: str | None = None, repeats_within: str | None = None):
    """Start the caption-record -> example query: ``out_dir/micro_batch=<id>`` per batch. With
    ``repeats_within`` the records are timed, and one that arrives again makes no example."""
    schema = CAPTION_RECORD_SCHEMA if repeats_within is None else TIMED_RECORD_SCHEMA
    records = _source(spark, schema, source_dir, files_per_trigger)
    if repeats_within is not None:
        records = first_arrivals(records, repeats_within)

    def convert(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # labels, totals and candidates each read it
        try:
            examples_of_records(batch, vocab, cfg).write.mode("overwrite").parquet(f"{out_dir}/micro_batch={batch_id}")
        finally:
            batch.unpersist()

    stream = (records.writeStream.foreachBatch(convert)
              .option("checkpointLocation", checkpoint or f"{out_dir}-checkpoint").trigger(availableNow=True))
    with state_on_disk(spark):
        return stream.start()
