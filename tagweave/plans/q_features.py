"""Named feature / evaluation / batching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SpanConfig
from ..operators import features as fe
from ..operators import splits as sp
from ..operators.captions import caption_feed
from ..operators.ranking import ordered_index, range_index
from ..sources.tables import read_table, tag_corpus
from .catalog import query
from .q_captions import CFG as CAP_CFG
from .q_captions import _captions_sql
from .q_spans import MLM_CTES, chunk_table
from .q_vocab import TEXT_CTES, _vocab_sql, tag_vocabulary

SPAN = SpanConfig()
EVAL_BATCH = 8
EPOCHS = 2
HOSTS = 2


def _coords(spark, sf_dir):
    vocab = tag_vocabulary(spark, sf_dir)
    tags = tag_corpus(spark, sf_dir).tags
    rows = tags.select(F.concat_ws("_", "booru", F.col("fid").cast("string")).alias("key"),
                       F.lower("tag").alias("label"))
    return fe.label_ordinals(rows, "key", "label", vocab)


_COORD_SQL = """
SELECT t.booru || '_' || CAST(t.fid AS VARCHAR) AS key, coalesce(v.id, 1) AS label_id
FROM tags t LEFT JOIN reg_a v ON v.token = lower(t.tag)
"""


@query("multi_hot_counts", _vocab_sql(f"""
SELECT key, label_id, CAST(count(*) AS BIGINT) AS value FROM ({_COORD_SQL}) c GROUP BY key, label_id
"""))
def q_multi_hot_counts(spark, sf_dir):
    """Sparse multi-hot counts of every file's labels (whole-label ordinals)."""
    return fe.multi_hot_counts(_coords(spark, sf_dir), "key")


@query("multi_hot_flags", _vocab_sql(f"""
SELECT DISTINCT key, label_id, true AS value FROM ({_COORD_SQL}) c
"""))
def q_multi_hot_flags(spark, sf_dir):
    """Sparse boolean multi-hot of every file's labels."""
    return fe.multi_hot_flags(_coords(spark, sf_dir), "key")


@query("eval_metrics", f"""
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS lg,
         row_number() OVER (ORDER BY vec_id) - 1 AS idx
  FROM embeddings
), s AS (
  SELECT idx // {EVAL_BATCH} AS batch_id,
         list_max(lg) + ln(list_sum(list_transform(lg, lambda x: exp(x - list_max(lg))))) - lg[label + 1] AS loss,
         CASE WHEN list_position(lg, list_max(lg)) - 1 = label THEN 1.0 ELSE 0.0 END AS accuracy
  FROM e
), b AS (SELECT batch_id, avg(loss) AS loss, avg(accuracy) AS accuracy FROM s GROUP BY batch_id)
SELECT round(avg(loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy, count(*) AS batches FROM b
""")
def q_eval_metrics(spark, sf_dir):
    """Mean cross-entropy / accuracy over batches of 8 rows of (logits, label)
    taken from the embeddings table in vec_id order."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    indexed = ordered_index(emb, "vec_id")
    scored = fe.example_metrics(indexed.withColumn("batch_id", F.floor(F.col("idx") / EVAL_BATCH)),
                                "embedding", "label")
    out = fe.batch_metrics(scored)
    return out.select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"),
                      "batches")


@query("captions_seen", _captions_sql("""
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(count(*)) OVER (ORDER BY batch_id) AS BIGINT) AS seen
FROM ex3 WHERE split = 'train' GROUP BY batch_id
"""))
def q_captions_seen(spark, sf_dir):
    """Training batches of the caption feed with the running count of captions seen."""
    corpus = tag_corpus(spark, sf_dir)
    feed = caption_feed(corpus.files, corpus.tags, tag_vocabulary(spark, sf_dir), CAP_CFG, with_caption=False)
    per_batch = (feed.where(F.col("split") == "train").groupBy("batch_id")
                 .agg(F.count(F.lit(1)).cast("long").alias("n")))
    return fe.captions_seen(per_batch).select("batch_id", "n", F.col("seen").cast("long"))


@query("mlm_batches", _vocab_sql(f"""
SELECT CAST(epoch AS INTEGER) AS epoch, CAST(grp AS BIGINT) AS "group", CAST(chunk AS BIGINT) AS chunk,
       CAST(perm AS BIGINT) AS perm, CAST(perm // {SPAN.batch_size} AS BIGINT) AS batch_id,
       CAST((perm % {SPAN.batch_size}) // {SPAN.batch_size // HOSTS} AS INTEGER) AS host
FROM (
  SELECT epoch, grp, chunk,
         row_number() OVER (PARTITION BY epoch ORDER BY md5('{SPAN.seed}|' || CAST(epoch AS VARCHAR) || '|' || CAST(pos AS VARCHAR)), pos) - 1 AS perm,
         count(*) OVER (PARTITION BY epoch) AS total
  FROM (SELECT grp, chunk, row_number() OVER (ORDER BY grp, chunk) - 1 AS pos FROM ch) c,
       (SELECT range AS epoch FROM range({EPOCHS})) e
) x
WHERE perm < (total // {SPAN.batch_size}) * {SPAN.batch_size}
""", TEXT_CTES, MLM_CTES))
def q_mlm_batches(spark, sf_dir):
    """Epochs of a random permutation of the chunks, fixed batches of 8 with
    the remainder dropped, and the host slice of each batch (2 hosts)."""
    _, chunks = chunk_table(spark, sf_dir)
    ids = chunks.select("group", "chunk")
    numbered = range_index(ids, [F.col("group"), F.col("chunk")], "pos")
    count = numbered.count()
    rep = sp.epochs(numbered, EPOCHS, count)
    perm = sp.permutation_index(rep, SPAN.seed, "epoch", "pos", "perm")
    usable = (count // SPAN.batch_size) * SPAN.batch_size
    kept = perm.where(F.col("perm") < usable)
    out = sp.host_shard(sp.batches(kept, SPAN.batch_size, "perm"), SPAN.batch_size, HOSTS)
    return out.select(F.col("epoch").cast("int"), F.col("group").cast("long"),
                      F.col("chunk").cast("long"), F.col("perm").cast("long"), "batch_id", "host")



@query("chunk_epoch_batches", _vocab_sql(f"""
SELECT CAST(epoch AS INTEGER) AS epoch, CAST(grp AS BIGINT) AS "group", CAST(chunk AS BIGINT) AS chunk,
       CAST(run_pos // 10 AS BIGINT) AS batch_id,
       CAST(min(epoch) OVER (PARTITION BY run_pos // 10) AS INTEGER) AS batch_epoch
FROM (
  SELECT e.epoch, c.grp, c.chunk, e.epoch * (SELECT count(*) FROM ch) + c.pos AS run_pos
  FROM (SELECT grp, chunk, row_number() OVER (ORDER BY grp, chunk) - 1 AS pos FROM ch) c,
       (SELECT range AS epoch FROM range(3)) e
) x
""", TEXT_CTES, MLM_CTES))
def q_chunk_epoch_batches(spark, sf_dir):
    """Three epochs of the chunks in order, batches of 10 over the running
    position; a batch that straddles two epochs takes its first row's epoch (W8)."""
    _, chunks = chunk_table(spark, sf_dir)
    numbered = range_index(chunks.select("group", "chunk"), [F.col("group"), F.col("chunk")], "pos")
    count = numbered.count()
    out = sp.epoch_batches(sp.epochs(numbered, 3, count), 10)
    return out.select(F.col("epoch").cast("int"), F.col("group").cast("long"),
                      F.col("chunk").cast("long"), "batch_id", F.col("batch_epoch").cast("int"))
