"""Storage rule, restartable streams, line-level quote rule and the train / validation pair."""

import os
import types

import pytest
from pyspark.sql import functions as F

from tagweave import session
from tagweave.sources import datasets, tsv
from tagweave.streaming import streams as st


def test_a_cluster_without_a_shared_folder_is_refused():
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    conf = types.SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(types.SimpleNamespace(sparkContext=context, conf=conf))
    assert session.is_local("local[4]") and not session.is_local("local-cluster[2,1,1024]")


def test_a_restarted_stream_counts_everything_once(spark, tmp_dir):
    rows = spark.range(100).select(F.lit("b").alias("booru"), F.col("id").alias("fid"), F.lit("T").alias("tag"), F.lit(0).alias("tag_cat"))
    for part in (0, 1, 2):
        if part < 2:
            rows.where(F.col("fid") % 2 == part).write.mode("append").parquet(f"{tmp_dir}/in")
        st.prevalence_stream(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", None, files_per_trigger=1).awaitTermination()
    assert [tuple(r) for r in st.latest_result(spark, f"{tmp_dir}/out").select("label", "prevalence").collect()] == [("t", 100)]


def test_quotes_anywhere_drop_the_line_and_the_smallest_row_stays(spark, tmp_dir):
    path = os.path.join(tmp_dir, "tags.tsv")
    with open(path, "w") as f:
        f.write("booru\tfid\ttag\ttag_id\ttag_cat\tdanb_fr\n"
                'b\t1\tx\t\t4\t\tseventh "field"\nb\t1\ty\t\t4\t\nb\t1\ty\t\t3\tz\nb\t1\t"q"\t\t0\t\nb\t2\tshort\n')
    got = sorted(tuple(r) for r in tsv.ingest_tags(spark, [path]).collect())
    assert got == [("b", 1, "y", None, 3, "z"), ("b", 2, "short", None, None, "")]


def test_train_and_validation_rows(spark, tmp_dir):
    train, other = os.path.join(tmp_dir, "a.txt"), os.path.join(tmp_dir, "b.txt")
    for path, n in ((train, 40), (other, 3)):
        with open(path, "w") as f:
            f.write("".join(f"line {i}\n" for i in range(n)))
    rest, first = datasets.train_and_validation(spark, train, validation_pct=5)
    assert sorted(r.text for r in first.collect()) == ["line 0", "line 1"] and rest.count() == 38
    assert [df.count() for df in datasets.train_and_validation(spark, train, other)] == [40, 3]
    with pytest.raises(ValueError):
        datasets.check_data_args(train, None, "b.parquet")
