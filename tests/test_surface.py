"""SQL views, parameterised lookup, user UDF surface, sinks, loaders, small helpers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tagweave.functions import udfs
from tagweave.operators import captions as cp
from tagweave.operators import features as fe
from tagweave.operators import splits as sp
from tagweave.plans.views import register_views, tags_of_file
from tagweave.sources import datasets, sinks


def _corpus(spark):
    files = spark.createDataFrame([("b", 1), ("b", 2), ("c", 1)], "booru string, fid long")
    tags = spark.createDataFrame(
        [("b", 1, "touhou", 3), ("b", 1, "red_hair", 0), ("b", 1, "hat", 0),
         ("b", 2, "touhou", 3), ("b", 2, "hat", 0), ("c", 1, "hat", 0)],
        "booru string, fid long, tag string, tag_cat int")
    return files, tags


def test_views_and_lookup(spark):
    files, tags = _corpus(spark)
    names = register_views(spark, files, tags, ["touhou"], prefix="t_")
    assert "t_general_tag_prevalence" in names
    got = {r["tag"]: r["prevalence"] for r in spark.sql("SELECT * FROM t_general_tag_prevalence").collect()}
    assert got == {"red_hair": 1, "hat": 2}
    assert spark.sql("SELECT n FROM t_general_tag_count").collect()[0][0] == 2
    rows = tags_of_file(spark, "b", 1, prefix="t_").collect()
    assert [r["tag"] for r in rows] == ["hat", "red_hair", "touhou"]


def test_rule_a_udf_matches_golden(spark):
    from test_tokenize import GOLDEN, VOCAB
    udfs.register_tokenize_label(spark, VOCAB)
    df = spark.createDataFrame([(k,) for k in GOLDEN], "label string")
    out = {r["label"]: list(r["t"]) for r in df.selectExpr("label", "tokenize_label(label) AS t").collect()}
    assert out == GOLDEN


def test_batched_map(spark):
    df = spark.range(10)
    out = udfs.batched_map(df, lambda b: b.assign(id=b["id"] * 2), "id long")
    assert sorted(r["id"] for r in out.collect()) == list(range(0, 20, 2))


def test_sinks_roundtrip(spark, tmp_dir):
    prev = spark.createDataFrame([(3, "b"), (5, "a"), (3, "a")], "prevalence long, label string")
    path = os.path.join(tmp_dir, "prev")
    sinks.write_prevalence_tsv(prev, path)
    lines = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            lines += open(os.path.join(path, name)).read().splitlines()
    assert lines == ["5\ta", "3\ta", "3\tb"]
    toks = spark.createDataFrame([(1, "y"), (0, "x")], "rank long, token string")
    tpath = os.path.join(tmp_dir, "toks")
    sinks.write_token_list(toks, tpath)
    assert [r["token"] for r in datasets.read_token_list(spark, tpath).orderBy("rank").collect()] == ["x", "y"]
    mpath = os.path.join(tmp_dir, "metrics")
    sinks.write_metrics_json(spark.createDataFrame([(0.5, 2.0)], "loss double, accuracy double"), mpath)
    part = [n for n in os.listdir(mpath) if n.startswith("part-")][0]
    assert list(json.loads(open(os.path.join(mpath, part)).read()).keys()) == ["accuracy", "loss"]


def test_loaders_and_checks(spark, tmp_dir):
    with pytest.raises(ValueError):
        datasets.check_data_args(None, None)
    with pytest.raises(ValueError):
        datasets.check_data_args("x.parquet", None)
    datasets.check_data_args("x.txt", None)
    datasets.register_loader("numbers", lambda n: spark.range(n))
    assert datasets.load_named("numbers", 3).count() == 3
    p = os.path.join(tmp_dir, "d.json")
    with open(p, "w") as f:
        f.write('{"a": 1, "body": "x"}\n')
    assert datasets.text_column(datasets.load_by_extension(spark, p)) == "a"


def test_small_helpers(spark):
    df = spark.createDataFrame([(c,) for c in (0, 1, 2, 3, 4, None)], "c int")
    rows = df.select(cp.known_category("c").alias("k"), cp.is_franchise("c").alias("f")).collect()
    assert [r["k"] for r in rows] == [0, 1, None, 3, 4, None]
    assert [r["f"] for r in rows] == [False, False, False, True, True, None]
    idx = spark.range(10).withColumnRenamed("id", "idx")
    assert [r["idx"] for r in sp.slice_percent(idx, 10, None, 25).collect()] == [0, 1]
    wrap = sp.wraparound(spark.range(3).withColumnRenamed("id", "pos"), 3, 7)
    assert sorted(r["run_pos"] for r in wrap.collect()) == list(range(7))
    assert fe.embedding_width(32100) == 512 and fe.embedding_width(100) == 2


def test_split_variants_offsets_steps_and_quality(spark):
    from tagweave.config import CaptionConfig
    from tagweave.operators import quality
    from tagweave.operators import spans
    idx = spark.range(50).withColumnRenamed("id", "idx")
    rows = sp.assign_splits(idx, CaptionConfig(test_quantity=3, validation_pct=None)).collect()
    assert {r["split"] for r in rows} == {"test", "train"}
    assert sorted(r["split_idx"] for r in rows if r["split"] == "train") == list(range(47))
    assert [r["idx"] for r in sp.files_from_nth(idx, 47).orderBy("idx").collect()] == [47, 48, 49]
    assert spans.steps_per_run(100, 8, 3) == 36
    df = spark.createDataFrame([("b", 1, "x", 2), ("b", 1, "x", 1), ("b", 2, "y", 0)],
                               "booru string, fid long, tag string, tag_cat int")
    kept = quality.dedup_on_key(df, ["booru", "fid", "tag"], [F.col("tag_cat")]).collect()
    assert sorted((r["fid"], r["tag_cat"]) for r in kept) == [(1, 1), (2, 0)]
    files = spark.createDataFrame([("b", 1)], "booru string, fid long")
    assert [r["fid"] for r in quality.cascade_tags(df, files).collect()] == [1, 1]
    assert [r["fid"] for r in quality.orphan_tags(df, files).collect()] == [2]
