"""Named chunking / span-corruption queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SpanConfig
from ..operators import spans as sp
from ..operators.ranking import ordered_index
from ..operators.tokenize import ids_text, tokenize_text
from ..session import written_stage
from ..sources.tables import documents
from .catalog import query
from .q_vocab import TEXT_CTES, _vocab_sql, text_vocabulary

CFG = SpanConfig()
SEQ = sp.effective_seq_length(CFG.max_seq_length)
CHUNK, TARGET = sp.input_and_target_lengths(SEQ, CFG.noise_density, CFG.mean_noise_span_length)


def chunk_table(spark, sf_dir):
    vocab = text_vocabulary(spark, sf_dir)
    tok = tokenize_text(documents(spark, sf_dir), vocab, with_tokens=False)
    return vocab, sp.cut_chunks(tok, "doc_id", "ids", CHUNK, CFG.group_rows, CFG.keep_short_chunks)


def _cuts(n_items: str, n_seg: str, purpose: str) -> str:
    """Bounds [0, cuts..., n_items] of two SQL numbers; cuts drawn like Floyd's sampling of
    the ``n_seg - 1`` cut points among the ``n_items - 1`` gaps."""
    u = (f"(('0x' || substr(md5('{CFG.seed}|{purpose}|' || key || '|' || CAST(j AS VARCHAR)), 1, 8))"
         f"::UBIGINT / 4294967296.0)")
    draws = f"list_transform(range({n_items} - {n_seg} + 1, {n_items}), lambda j: {{'j': j, 't': CAST(floor({u} * j) + 1 AS BIGINT)}})"
    picked = (f"list_reduce({draws}, lambda acc, d: CASE WHEN list_contains(acc, d.t) "
              f"THEN list_append(acc, d.j) ELSE list_append(acc, d.t) END, []::BIGINT[])")
    return f"list_concat([0], list_sort({picked}), [{n_items}])"


def _lengths(bounds: str, n_seg: str) -> str:
    return f"list_transform(range(1, {n_seg} + 1), lambda k: {bounds}[k + 1] - {bounds}[k])"


MLM_CTES = f"""
doc_ids AS (SELECT doc_id, list(id ORDER BY pos, cpos) AS ids FROM dlook GROUP BY doc_id),
didx AS (SELECT doc_id, ids, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM doc_ids),
grp AS (SELECT idx // {CFG.group_rows} AS grp, flatten(list(ids ORDER BY idx)) AS flat
        FROM didx GROUP BY idx // {CFG.group_rows}),
grp_chunks AS (
  SELECT grp, flat, unnest(range(greatest(len(flat) // {CHUNK}, 1))) AS chunk FROM grp WHERE len(flat) > 0
),
ch AS (
  SELECT *, CAST(greatest(round_even(noise / {float(CFG.mean_noise_span_length)}, 0), 1) AS BIGINT) AS spans FROM (
    SELECT *, least(greatest(CAST(round_even(len(ids) * CAST({CFG.noise_density} AS DOUBLE), 0) AS BIGINT), 1), len(ids) - 1) AS noise FROM (
      SELECT grp, chunk, CAST(grp AS VARCHAR) || '_' || CAST(chunk AS VARCHAR) AS key,
             flat[chunk * {CHUNK} + 1 : (chunk + 1) * {CHUNK}] AS ids
      FROM grp_chunks))
),
bnds AS (
  SELECT grp, chunk, ids, spans, {_cuts('noise', 'spans', 'noise')} AS nb,
         {_cuts('(len(ids) - noise)', 'spans', 'nonnoise')} AS cb
  FROM ch
),
segs AS (
  SELECT grp, chunk, ids, spans, {_lengths('nb', 'spans')} AS nl, {_lengths('cb', 'spans')} AS cl FROM bnds
),
vsize AS (SELECT CAST(count(*) AS BIGINT) AS v FROM reg_b),
offs AS (
  SELECT *, list_transform(range(1, spans + 1), lambda k:
           coalesce(list_sum(cl[1:k - 1]), 0) + coalesce(list_sum(nl[1:k - 1]), 0)) AS cs
  FROM segs, vsize
),
built AS (
  SELECT grp, chunk,
    list_concat(flatten(list_transform(range(1, spans + 1), lambda k:
        list_concat(ids[cs[k] + 1 : cs[k] + cl[k]], [v - k]))), [1]) AS input_ids,
    list_concat(flatten(list_transform(range(1, spans + 1), lambda k:
        list_concat([v - k], ids[cs[k] + cl[k] + 1 : cs[k] + cl[k] + nl[k]]))), [1]) AS labels
  FROM offs
)"""


def _ids(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: CAST(x AS VARCHAR)), ' ')"


@query("mlm_chunks", _vocab_sql(f"""
SELECT CAST(grp AS BIGINT) AS "group", CAST(chunk AS BIGINT) AS chunk,
       {_ids('input_ids')} AS input_ids, {_ids('labels')} AS labels,
       {_ids("list_concat([0], labels[1:len(labels) - 1])")} AS decoder_input_ids
FROM built
""", TEXT_CTES, MLM_CTES))
def q_mlm_chunks(spark, sf_dir):
    """Documents -> rule-B ids -> doc_id order -> groups of 1,000 rows cut into
    chunks of the expanded length -> span corruption with sentinels, EOS and
    decoder inputs (length-checked)."""
    vocab, chunks = chunk_table(spark, sf_dir)
    key = F.concat_ws("_", F.col("group").cast("string"), F.col("chunk").cast("string"))
    out = sp.corrupt(chunks, CHUNK, CFG, vocab.rows, key)
    return out.select(F.col("group").cast("long").alias("group"), F.col("chunk").cast("long"),
                      ids_text("input_ids").alias("input_ids"), ids_text("labels").alias("labels"),
                      ids_text("decoder_input_ids").alias("decoder_input_ids"))


@query("mlm_group_lengths", _vocab_sql(f"""
SELECT CAST(grp AS BIGINT) AS "group", CAST(len(flat) AS BIGINT) AS total_tokens,
       CAST(CASE WHEN len(flat) BETWEEN 1 AND {CHUNK - 1} THEN 1 ELSE len(flat) // {CHUNK} END AS BIGINT) AS chunks
FROM grp
""", TEXT_CTES, MLM_CTES))
def q_mlm_group_lengths(spark, sf_dir):
    """Concatenated length per group of 1,000 documents and its chunk count."""
    vocab = text_vocabulary(spark, sf_dir)
    tok = tokenize_text(documents(spark, sf_dir), vocab, with_tokens=False)
    # Numbering reads its rows twice (bounds of the ranges and rows).
    sizes = written_stage(tok.select("doc_id", F.size("ids").alias("n")), "sizes")
    indexed = ordered_index(sizes, "doc_id")
    total = F.col("total_tokens")
    return (indexed.groupBy(F.floor(F.col("idx") / CFG.group_rows).cast("long").alias("group"))
            .agg(F.sum("n").cast("long").alias("total_tokens"))
            .withColumn("chunks", F.when(total.between(1, CHUNK - 1), 1).otherwise(F.floor(total / CHUNK)).cast("long")))
