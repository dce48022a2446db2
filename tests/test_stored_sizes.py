"""Caption records are made from stored keys of files, without their names and hashes."""

import pytest

import __spark_entry__ as E
from tagweave.sources import tables


def _tables(spark, folder):
    rows = {
        "orders": ([(1, "a"), (2, "b"), (3, "b")], "o_orderkey long, o_orderpriority string"),
        "lineitem": ([(1, 1, 1, 2.0), (1, 2, 1, 1.0), (2, 2, 1, 3.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double"),
        "part": ([(1, "red sky", "BIG", "Brand#1", 5), (2, "sea", "TIN", "Brand#2", 6)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int"),
        "supplier": ([(1, "S#1", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(1, "PERU")], "n_nationkey int, n_name string"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.mark.parametrize("name", ["caption_records", "loaded_caption_records"])
def test_records_store_keys_alone(spark, monkeypatch, tmp_path, name):
    _tables(spark, str(tmp_path))
    asked = []
    real = tables.StoredCorpus.table
    monkeypatch.setattr(tables.StoredCorpus, "table", lambda self, field, *a, **k: asked.append((field, got := real(self, field, *a, **k))) or got)
    rows = {r.key: r.n_tags for r in E.queries()[name](spark, str(tmp_path)).collect()}
    assert rows == {"a_1": 9, "b_2": 5, "b_3": 0}
    for field, table in asked:
        assert field in ("file_keys", "tags")
        assert field == "tags" or table.columns == ["booru", "fid"]


def test_keys_of_repeated_files_stay(spark, tmp_path):
    orders = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "o_orderkey long, o_orderpriority string")
    corpus = tables.TagCorpus(tables.files_from_orders(orders), None, None)
    assert sorted(map(tuple, corpus.file_keys.collect()), key=repr) == sorted([("a", 1), ("a", 1), ("b", None), (None, 2)], key=repr)
