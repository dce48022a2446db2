"""Global positions, splits, frames, features."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagweave.config import CaptionConfig
from tagweave.operators import features as fe
from tagweave.operators import splits as sp
from tagweave.operators import tagstats as ts
from tagweave.operators.ranking import global_index, running_sum


def test_global_index_equals_row_number(spark):
    rnd = random.Random(7)
    rows = [(f"{rnd.getrandbits(32):08x}" if rnd.random() > 0.05 else None, i) for i in range(3000)]
    base = spark.createDataFrame(rows, "h string, k long")
    expected = {r["k"]: r["rn"] for r in base.withColumn(
        "rn", F.row_number().over(Window.orderBy(F.col("h").asc_nulls_first(), "k")) - 1).collect()}
    for parts in (1, 4, 64):
        df = base.repartition(parts)
        got = global_index(df, bucket=[F.substring("h", 1, 2)],
                           order=[F.col("h").asc_nulls_first(), F.col("k")])
        assert {r["k"]: r["idx"] for r in got.collect()} == expected


def test_splits_disjoint_and_positions(spark):
    cfg = CaptionConfig(test_quantity=5, validation_pct=10)
    df = spark.range(1000).withColumnRenamed("id", "idx")
    rows = sp.assign_splits(df, cfg).collect()
    by = {}
    for r in rows:
        by.setdefault(r["split"], []).append((r["idx"], r["split_idx"]))
    assert sum(len(v) for v in by.values()) == 1000
    for split, items in by.items():
        items.sort()
        assert [p for _, p in items] == list(range(len(items))), split
    assert len(by["test"]) == 5 and len(by["validation"]) == 100


def test_frames_golden(spark):
    fc = spark.createDataFrame([("b", 1, 9), ("b", 2, 11), ("b", 3, 23), ("b", 4, 100)],
                               "booru string, fid long, frames int")
    out = ts.frames(fc)
    assert out.where("fid < 4").count() == 43
    assert out.where("fid = 4").count() == fc.where("fid = 4").first()["frames"] > 69
    assert out.agg(F.min("frame")).collect()[0][0] == 0


def test_multi_hot_golden(spark):
    coords = spark.createDataFrame([(0, 5), (0, 7), (0, 2), (0, 2)], "row int, label_id int")
    counts = {r["label_id"]: r["value"] for r in fe.multi_hot_counts(coords, "row").collect()}
    assert counts == {5: 1, 7: 1, 2: 2}
    flags = fe.multi_hot_flags(coords, "row").collect()
    assert all(r["value"] for r in flags) and len(flags) == 3
    dense = fe.densify(fe.multi_hot_counts(coords, "row"), "row", 8).collect()[0]
    assert list(dense["vector"]) == [0, 0, 2, 0, 0, 1, 0, 1]


def test_running_sum_and_batches(spark):
    df = spark.createDataFrame([(b, b % 3 + 1) for b in range(10000)], "batch_id long, n long")
    got = {r["batch_id"]: r["seen"] for r in fe.captions_seen(df).collect()}
    total = 0
    for b in range(10000):
        total += b % 3 + 1
        assert got[b] == total
    perm = sp.permutation_index(sp.epochs(spark.range(20).withColumnRenamed("id", "pos"), 2, 20),
                                42, "epoch", "pos", "perm")
    for e in (0, 1):
        assert sorted(r["perm"] for r in perm.where(F.col("epoch") == e).collect()) == list(range(20))
    eb = sp.epoch_batches(sp.epochs(spark.range(5).withColumnRenamed("id", "pos"), 2, 5), 3)
    firsts = {r["batch_id"]: r["batch_epoch"] for r in eb.collect()}
    assert firsts == {0: 0, 1: 0, 2: 1, 3: 1}


def test_eval_metrics(spark):
    df = spark.createDataFrame([([0.0, 1.0], 1), ([2.0, 0.0], 1)], "logits array<double>, label int")
    rows = fe.example_metrics(df.withColumn("batch_id", F.lit(0))).collect()
    import math
    assert abs(rows[0]["loss"] - (math.log(1 + math.e) - 1.0)) < 1e-9
    assert rows[0]["accuracy"] == 1.0 and rows[1]["accuracy"] == 0.0
