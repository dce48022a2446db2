"""Shards that are built again, and records that arrive twice."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from tagweave.session import scratch_path
from tagweave.sources.tsv import write_table
from tagweave.streaming import streams as st


def test_a_shard_replaces_itself_alone(spark):
    path = scratch_path(spark, f"rebuilt-{uuid.uuid4().hex}")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "shard string, n int")
    write_table(rows, path, ["shard"], ["n"])
    write_table(rows.where("n = 3").withColumn("n", F.lit(9)), path, ["shard"], keep_others=True)
    read = lambda: sorted(map(tuple, spark.read.parquet(path).select("shard", "n").collect()))
    assert read() == [("a", 1), ("a", 2), ("b", 9)]
    write_table(rows.where("n > 9"), path, ["shard"], keep_others=True)
    assert read() == [("a", 1), ("a", 2), ("b", 9)]
    write_table(rows.where("n = 1"), path, ["shard"])
    assert read() == [("a", 1)]
    with pytest.raises(ValueError):
        write_table(rows, path, keep_others=True)


def test_repeats_within_the_delay_go(spark):
    base = scratch_path(spark, f"arrivals-{uuid.uuid4().hex}")
    batches = [[("k1", 0), ("k2", 0), ("k1", 5)], [("k1", 60), ("k3", 3600)], [("k2", 3500), ("k3", 3700), ("k4", 7200)]]
    for keys in batches:
        rows = spark.createDataFrame(keys, "key string, s long")
        timed = rows.select(F.lit("b").alias("booru"), F.lit(1).cast("long").alias("fid"), "key",
                            F.array().cast(st.CAPTION_RECORD_SCHEMA["tags"].dataType).alias("tags"), F.timestamp_seconds(F.col("s") + 1_640_995_200).alias("arrived"))
        timed.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = st.first_arrivals(spark.readStream.schema(st.TIMED_RECORD_SCHEMA).parquet(f"{base}/in"), "2 hours")
        (stream.select("key").writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start(f"{base}/out").awaitTermination())
    assert sorted(r.key for r in spark.read.parquet(f"{base}/out").collect()) == ["k1", "k2", "k3", "k4"]
