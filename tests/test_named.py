"""Named data sources, stored frames and the table function."""

from __future__ import annotations

import gzip
import json
import os
import uuid

import pytest

from tagweave.functions import udfs
from tagweave.operators import tagstats
from tagweave.operators.tokenize import materialize_vocab, tokenize_labels
from tagweave.session import prepare, scratch_path
from tagweave.sources import datasets, named
from tagweave.sources.store import create_table


def _put(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open if path.endswith(".gz") else open)(path, "wb") as f:
        f.write(data)


def test_token_lists_keep_order_over_files(spark, tmp_dir):
    prepare(spark)
    _put(f"{tmp_dir}/l/a.txt", "x\n\nÿ y\r\n".encode())
    _put(f"{tmp_dir}/l/b.txt.gz", b"\nz\nlast")
    _put(f"{tmp_dir}/l/c/d.txt", b"")
    _put(f"{tmp_dir}/l/_SUCCESS", b"no token\n")
    got = datasets.load_named("token_list", spark, f"{tmp_dir}/l").orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, "x"), (1, "ÿ y"), (2, "z"), (3, "last")]
    named.register(spark)
    rows = spark.read.format("token_list").load(f"file:{tmp_dir}/l/a.txt").collect()
    assert [(r.line, r.token) for r in rows] == [(0, "x"), (2, "ÿ y")]
    os.makedirs(f"{tmp_dir}/none")
    assert spark.read.format("token_list").load(f"{tmp_dir}/none").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("token_list").load(f"{tmp_dir}/nowhere").count()


def test_unknown_names_are_refused():
    with pytest.raises(KeyError, match="caption_records"):
        datasets.load_named("no such set")


RECORDS = [
    {"booru": "b", "fid": 1, "key": "b_1", "tags": [{"tag": "long " * 60, "tag_cat": 0}, {"tag": None, "tag_cat": 4}]},
    {"booru": "b", "fid": 2, "key": "b_2", "tags": []},
    {"fid": None, "key": "ÿ\n", "more": {"x": 1}},
    *({"booru": "c", "fid": i, "key": f"c_{i}", "tags": [{"tag": "t" * i, "tag_cat": i}]} for i in range(40)),
]


def _expected(records):
    return sorted(((r.get("booru"), r.get("fid"), r["key"], None if r.get("tags") is None else [(t["tag"], t["tag_cat"]) for t in r["tags"]])
                   for r in records), key=repr)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_every_record_is_in_one_range(spark, tmp_dir, split):
    prepare(spark)
    text = b"\n" + b"".join(json.dumps(r, ensure_ascii=False).encode() + b"\n" * (1 + i % 2) for i, r in enumerate(RECORDS))
    _put(f"{tmp_dir}/r/plain.json", text.rstrip(b"\n"))
    lines = [line for part in named.CaptionJsonReader({"path": f"{tmp_dir}/r", "split_bytes": split}).partitions() for piece in part.pieces() for line in piece]
    assert b"".join(lines) == text.rstrip(b"\n")
    if split >= 64:
        _put(f"{tmp_dir}/r/packed.json.gz", text)
        got = datasets.load_caption_records(spark, f"{tmp_dir}/r", split_bytes=split).collect()
        rows = sorted(((r.booru, r.fid, r.key, None if r.tags is None else [tuple(t) for t in r.tags]) for r in got), key=repr)
        assert rows == _expected(RECORDS * 2)


def test_a_booru_replaces_its_stored_frames_alone(spark):
    table = create_table(spark, scratch_path(spark, f"frames-{uuid.uuid4().hex}"), "fid BIGINT, frame INT, booru STRING", "booru")
    counts = spark.createDataFrame([("a", 1, 2), ("b", 1, 1), ("b", 2, 0), ("c", 3, None)], "booru string, fid long, frames int")
    tagstats.insert_frames(counts, table)
    read = lambda: sorted((r.booru, r.fid, r.frame) for r in spark.table(table).collect())
    assert read() == [("a", 1, 0), ("a", 1, 1), ("b", 1, 0)]
    tagstats.insert_frames(spark.createDataFrame([("b", 7, 2)], counts.schema), table, overwrite=True)
    assert read() == [("a", 1, 0), ("a", 1, 1), ("b", 7, 0), ("b", 7, 1)]
    tagstats.insert_frames(spark.createDataFrame([("a", 9, 1)], counts.schema), table)
    assert ("a", 9, 0) in read() and len(read()) == 5
    tagstats.insert_frames(counts.where("false"), table, overwrite=True)
    assert len(read()) == 5


def test_the_table_function_equals_the_join_plan(spark):
    prepare(spark)
    tokens = spark.createDataFrame([(0, "<pad>", 0), (1, "<unk>", 0), (2, "blue", 1), (3, "long_hair", 1), (4, "hair", 1), (5, "sky_(sea)", 1)],
                                   "id int, token string, origin int")
    vocab = materialize_vocab(tokens, "<pad>", "<unk>")
    udfs.register_label_tokens(spark, vocab, "label_tokens_test")
    labels = spark.createDataFrame([(x,) for x in ("blue", "long_hair", "blue-hair", "x_(blue)", "a_(cosplay)_(hair)", "sky_(sea)", "", "?", None, "blue")], "label string")
    plan = {r.label: (list(r.ids), list(r.tokens)) for r in tokenize_labels(labels, vocab).collect()}
    rows = spark.sql("SELECT DISTINCT l.label, t.* FROM {labels} l, LATERAL label_tokens_test(l.label) t", labels=labels).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.label, r.pos)):
        ids, names = got.setdefault(r.label, ([], []))
        ids.append(r.id)
        names.append(r.token)
    assert got == plan and None not in got
    with pytest.raises(ValueError):
        udfs.register_label_tokens(spark, vocab, held_bytes=1)
