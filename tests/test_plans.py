"""Physical-plan properties that matter at scale (checked on the small fixture)."""

import __spark_entry__ as E
from tagweave.config import CaptionConfig
from tagweave.operators import captions as cp
from tagweave.operators import tokenize as tk
from tagweave.plans import q_vocab
from tagweave.sources.tables import tag_corpus

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_pushes_filters_and_uses_semi_joins(spark):
    df = E.queries()["general_tag_prevalence"](spark, SMALL)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(tag_cat,0)" in text                       # category filter at the scan
    assert "In(tag, [nation_0,nation_15,nation_3])" in text    # franchise list at the scan
    assert "LeftSemi" in text                                   # EXISTS as semi join
    assert "ReadSchema: struct<booru:string,fid:bigint,tag:string,tag_cat:int>" in text


def test_caption_candidates_top_k_is_partial_on_map_side(spark):
    corpus = tag_corpus(spark, SMALL)
    vocab = q_vocab.tag_vocabulary(spark, SMALL)
    plan = _plan(cp.caption_candidates(corpus.tags, vocab, CaptionConfig()))
    assert "WindowGroupLimit" in plan
    assert "BroadcastHashJoin" in plan    # checked-size label table, no shuffle by label


def test_text_tokenisation_looks_up_in_place(spark):
    vocab = q_vocab.text_vocabulary(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    plan = _plan(tk.tokenize_text(docs, vocab, with_tokens=False))
    assert "Join" not in plan and "Exchange" not in plan and "MapInArrow" in plan
    assert "SortMergeJoin" not in plan


def test_no_python_in_caption_feed(spark):
    corpus = tag_corpus(spark, SMALL)
    vocab = q_vocab.tag_vocabulary(spark, SMALL)
    plan = _plan(cp.caption_feed(corpus.files, corpus.tags, vocab, CaptionConfig()))
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert "MapInPandas" not in plan
