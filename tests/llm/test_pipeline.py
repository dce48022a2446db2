"""The pipeline's stages against brute force on a small table."""

import random

from test_operators import brute_classes, prose, words

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(21)
    passage = prose(rng, 30, 5000)
    rows = [(i, prose(rng, 60, 5000), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200, rows[5][1], "en", "s0"), (201, rows[6][1] + " tail", None, None), (202, "x " + passage, "en", "s1"), (203, None, "en", "s1"), (204, "123 ...", "en", "s1"), (205, rows[5][1], "en", "s0"), (205, rows[5][1], "en", "s0")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "token_files" or docs.columns == columns
        kept[name] = docs.collect()
    assert {r.doc_id for r in kept["language_id"]} == {r[0] for r in rows} - {203, 204}
    classes = brute_classes([(r.doc_id, r.text) for r in kept["language_id"]])
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted(set(classes.values()))
    assert {r.doc_id for r in kept["near_dedup"]} - {r.doc_id for r in kept["decontaminate"]} == {202}
    total = sum(len(words(r.text)) for r in kept["decontaminate"])
    mixed = sum(len(words(r.text)) for r in kept["mix_sources"])
    assert abs(mixed - 1.5 * total) <= 3 * 60  # a document is 60 words, a source can miss by less than one
    assert len(kept["token_files"]) == len(kept["mix_sources"])
    assert sorted(r.start for r in kept["token_files"])[0] == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["token_files"])
