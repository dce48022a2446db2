"""Named vocabulary and tokenisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EOS_TOKEN, PAD_TOKEN, UNK_TOKEN
from ..functions.udfs import register_label_tokens
from ..operators import tagstats as ts
from ..operators import tokenize as tk
from ..operators import vocab as vb
from ..sources.datasets import load_named
from ..sources.sinks import write_token_list
from ..sources.store import RESULTS
from ..sources.tables import SOURCES, documents, table_paths, tag_corpus
from .catalog import query
from .oracle_sql import ascii_lower_sql, with_corpus

QUAL = r"^(.*)_\(([^)]*?)\)$"
ZERO = r"^[ \t\n]*[+-]?(0+\.?0*|\.0+)([eE][+-]?[0-9]+)?[ \t\n]*$"


# ---------------------------------------------------------------- Spark side

def tag_vocab_lists(spark, sf_dir):
    """(general token counts, general tokens, label tokens) from the tag corpus."""
    tags = tag_corpus(spark, sf_dir).tags
    counts = vb.general_token_counts(ts.label_prevalence(tags, general=True))
    return counts, vb.general_tokens(counts), vb.label_tokens(ts.label_prevalence(tags, general=False))


def tag_registry_a(spark, sf_dir):
    _, gen, lab = tag_vocab_lists(spark, sf_dir)
    return vb.registry_a(spark, lab, gen)


def text_registry_b(spark, sf_dir):
    """Registry B for the text corpus: name labels of the tags, words >= 31."""
    _, _, lab = tag_vocab_lists(spark, sf_dir)
    words = vb.general_tokens(vb.word_counts(documents(spark, sf_dir)))
    return vb.registry_b(spark, lab, words)


def _memo(spark, sf_dir, kind, build):
    """Built once per application and state of its input tables."""
    inputs = table_paths(sf_dir, *SOURCES, *["documents"] * (kind == "b"))
    return RESULTS.get(spark, f"vocab-{kind}", inputs, lambda folder, files: build())


def tag_vocabulary(spark, sf_dir) -> vb.Vocabulary:
    """Registry A of the corpus, materialised once per application."""
    return _memo(spark, sf_dir, "a", lambda: tk.materialize_vocab(
        tag_registry_a(spark, sf_dir), PAD_TOKEN, UNK_TOKEN))


def text_vocabulary(spark, sf_dir) -> vb.Vocabulary:
    """Registry B of the text corpus, materialised once per application."""
    return _memo(spark, sf_dir, "b", lambda: tk.materialize_vocab(
        text_registry_b(spark, sf_dir), PAD_TOKEN, UNK_TOKEN, EOS_TOKEN))


# ---------------------------------------------------------------- SQL side

VOCAB_CTES = f"""
glp AS (
  SELECT count(*) AS prevalence, {ascii_lower_sql('tag')} AS label
  FROM tags WHERE tag_cat = 0 GROUP BY {ascii_lower_sql('tag')}
),
nlp AS (
  SELECT count(*) AS prevalence, {ascii_lower_sql('tag')} AS label
  FROM tags WHERE tag_cat != 0 GROUP BY {ascii_lower_sql('tag')}
),
gpeel(label, prevalence, rest, qual, depth, stop) AS (
  SELECT label, prevalence, label, CAST(NULL AS VARCHAR), 0, false FROM glp WHERE length(label) > 4
  UNION ALL
  SELECT label, prevalence, regexp_extract(rest, '{QUAL}', 1), regexp_extract(rest, '{QUAL}', 2),
         depth + 1, regexp_extract(rest, '{QUAL}', 2) = 'cosplay'
  FROM gpeel WHERE NOT stop AND regexp_matches(rest, '{QUAL}')
),
glast AS (
  SELECT label, prevalence, arg_max(rest, depth) AS rest, bool_or(stop) AS cosplay
  FROM gpeel GROUP BY label, prevalence
),
gparts AS (
  SELECT label AS token, prevalence FROM glp
   WHERE length(label) <= 4 AND label <> '' AND NOT regexp_matches(label, '{ZERO}')
  UNION ALL SELECT qual, prevalence FROM gpeel WHERE depth > 0
  UNION ALL SELECT rest, prevalence FROM glast WHERE cosplay
  UNION ALL SELECT part, prevalence FROM (
     SELECT unnest(string_split_regex(rest, '[-_]')) AS part, prevalence FROM glast WHERE NOT cosplay) s
   WHERE part <> '' AND NOT regexp_matches(part, '{ZERO}')
),
gcounts AS (SELECT token, CAST(sum(prevalence) AS BIGINT) AS count FROM gparts GROUP BY token),
gen_toks AS (
  SELECT row_number() OVER (ORDER BY count DESC, token DESC) - 1 AS rank, token, count
  FROM gcounts WHERE count >= 31
),
lab_toks AS (
  SELECT row_number() OVER (ORDER BY prevalence DESC, label ASC) - 1 AS rank, label AS token,
         prevalence AS count
  FROM nlp WHERE prevalence >= 83
),
reg_a_entries AS (
  SELECT 0 AS origin, 0 AS rank, '<pad>' AS token UNION ALL SELECT 0, 1, '<unk>'
  UNION ALL SELECT 1, rank, token FROM lab_toks WHERE token <> ''
  UNION ALL SELECT 2, rank, token FROM gen_toks WHERE token <> ''
),
reg_a_first AS (
  SELECT DISTINCT ON (token) token, origin, rank FROM reg_a_entries ORDER BY token, origin, rank
),
reg_a AS (
  SELECT CAST(row_number() OVER (ORDER BY origin, rank) - 1 AS INTEGER) AS id, token FROM reg_a_first
)"""


def _vocab_sql(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + with_corpus(VOCAB_CTES, *more, body=body)[len("WITH "):]


LABEL_TOKENS_CTES = f"""
labels AS (SELECT DISTINCT lower(tag) AS label FROM tags WHERE tag IS NOT NULL),
lwhole AS (
  SELECT l.label, v.id IS NOT NULL AS whole FROM labels l LEFT JOIN reg_a v ON v.token = l.label
),
lpeel(label, rest, qual, depth, stop) AS (
  SELECT label, label, CAST(NULL AS VARCHAR), 0, false FROM lwhole
   WHERE NOT whole AND length(label) > 4
  UNION ALL
  SELECT label, regexp_extract(rest, '{QUAL}', 1), regexp_extract(rest, '{QUAL}', 2), depth + 1,
         regexp_extract(rest, '{QUAL}', 2) = 'cosplay'
  FROM lpeel WHERE NOT stop AND regexp_matches(rest, '{QUAL}')
),
lsplit AS (
  SELECT label,
         CASE WHEN bool_or(stop) THEN [arg_max(rest, depth)]
              ELSE string_split_regex(arg_max(rest, depth), '[-_]') END
         || coalesce(list(qual ORDER BY depth DESC) FILTER (WHERE depth > 0), []::VARCHAR[]) AS cands
  FROM lpeel GROUP BY label
),
lcands AS (
  SELECT w.label,
         CASE WHEN w.whole THEN [w.label]
              WHEN length(w.label) > 4 THEN s.cands
              ELSE ['<unk>'] END AS cands
  FROM lwhole w LEFT JOIN lsplit s ON s.label = w.label
),
lexp AS (
  SELECT label, unnest(cands) AS cand, unnest(range(len(cands))) AS pos FROM lcands
),
llook AS (
  SELECT e.label, e.pos, coalesce(v.id, 1) AS id, CASE WHEN v.id IS NULL THEN '<unk>' ELSE e.cand END AS tok
  FROM lexp e LEFT JOIN reg_a v ON v.token = e.cand
)"""


@query("general_token_counts", _vocab_sql("SELECT token, count FROM gcounts"))
def q_general_token_counts(spark, sf_dir):
    counts, _, _ = tag_vocab_lists(spark, sf_dir)
    return counts


@query("general_tokens", _vocab_sql("SELECT rank, token, count FROM gen_toks"))
def q_general_tokens(spark, sf_dir):
    return tag_vocab_lists(spark, sf_dir)[1]


@query("label_tokens", _vocab_sql("SELECT rank, token, count FROM lab_toks"))
def q_label_tokens(spark, sf_dir):
    return tag_vocab_lists(spark, sf_dir)[2]


@query("registry_a", _vocab_sql("SELECT id, token FROM reg_a"))
def q_registry_a(spark, sf_dir):
    return tag_registry_a(spark, sf_dir).select("id", "token")


_LABEL_TOKENIZATION_SQL = _vocab_sql("""
SELECT label,
       array_to_string(list(CAST(id AS VARCHAR) ORDER BY pos), ' ') AS ids,
       array_to_string(list(tok ORDER BY pos), ' ') AS tokens,
       CAST(count(*) AS INTEGER) AS n_tokens,
       CAST(count(*) FILTER (WHERE id = 1) AS INTEGER) AS n_unknown
FROM llook GROUP BY label
""", LABEL_TOKENS_CTES)


@query("label_tokenization", _LABEL_TOKENIZATION_SQL)
def q_label_tokenization(spark, sf_dir):
    """Rule-A tokens of every distinct (lower-cased) tag label, with the ids
    decoded back to tokens through the vocabulary (J7)."""
    vocab = tag_vocabulary(spark, sf_dir)
    tags = tag_corpus(spark, sf_dir).tags
    labels = tags.select(F.lower("tag").alias("label"))
    table = tk.tokenize_labels(labels, vocab)
    decoded = tk.decode_ids(table, ["label"], "ids", vocab)
    return (table.join(decoded, "label")
            .select("label", tk.ids_text("ids").alias("ids"),
                    F.array_join("decoded", " ").alias("tokens"),
                    F.size("ids").alias("n_tokens"),
                    F.size(F.filter("ids", lambda x: x == vocab.unk_id)).alias("n_unknown")))


@query("lateral_label_tokens", _LABEL_TOKENIZATION_SQL)
def q_lateral_label_tokens(spark, sf_dir):
    """The same in SQL by a LATERAL join with the table function ``label_tokens``."""
    register_label_tokens(spark, tag_vocabulary(spark, sf_dir))
    return spark.sql("""
        WITH labels AS (SELECT DISTINCT lower(tag) AS label FROM {tags} WHERE tag IS NOT NULL),
        found AS (SELECT label, array_sort(collect_list(struct(t.pos, t.id, t.token))) AS found
                  FROM labels, LATERAL label_tokens(label) t GROUP BY label)
        SELECT label, array_join(transform(found.id, i -> CAST(i AS STRING)), ' ') AS ids, array_join(found.token, ' ') AS tokens,
               size(found) AS n_tokens, size(filter(found, x -> x.id = {unknown})) AS n_unknown
        FROM found""", tags=tag_corpus(spark, sf_dir).tags, unknown=tag_vocabulary(spark, sf_dir).unk_id)


@query("loaded_token_list", _vocab_sql("""
SELECT row_number() OVER (ORDER BY rank) - 1 AS rank, token FROM gen_toks WHERE token <> ''
"""))
def q_loaded_token_list(spark, sf_dir):
    """The general tokens written as files of one token per line, the later half gzip, and
    loaded by name with their ranks (S8, S10, S12)."""
    def build(base, _files):
        tokens = tag_vocab_lists(spark, sf_dir)[1]
        half = F.lit(tokens.count() // 2)
        write_token_list(tokens.where(F.col("rank") < half), f"{base}/list/a")
        write_token_list(tokens.where(F.col("rank") >= half), f"{base}/list/b", compression="gzip")
        return f"{base}/list"

    path = RESULTS.get(spark, "token-list", table_paths(sf_dir, *SOURCES), build)
    return load_named("token_list", spark, path)


TEXT_CTES = """
words AS (
  SELECT lower(w) AS token FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) s
),
wcounts AS (SELECT token, count(*) AS count FROM words WHERE token <> '' GROUP BY token),
word_toks AS (
  SELECT row_number() OVER (ORDER BY count DESC, token DESC) - 1 AS rank, token, count
  FROM wcounts WHERE count >= 31
),
reg_b_entries AS (
  SELECT 0 AS origin, 0 AS rank, '<pad>' AS token UNION ALL SELECT 0, 1, '</s>'
  UNION ALL SELECT 0, 2, '<unk>'
  UNION ALL SELECT 1, rank, token FROM lab_toks
   WHERE token <> '' AND token NOT IN (SELECT token FROM word_toks WHERE token <> '')
  UNION ALL SELECT 2, rank, token FROM word_toks WHERE token <> ''
  UNION ALL SELECT 3, range, '<extra_id_' || CAST(range AS VARCHAR) || '>' FROM range(100)
),
reg_b AS (
  SELECT CAST(row_number() OVER (ORDER BY origin, rank) - 1 AS INTEGER) AS id, token FROM reg_b_entries
),
dwords AS (
  SELECT doc_id, lower(w) AS lw, pos FROM (
    SELECT doc_id, unnest(string_split(text, ' ')) AS w,
           unnest(range(len(string_split(text, ' ')))) AS pos FROM documents) s
),
dcands AS (
  SELECT d.doc_id, d.pos,
         CASE WHEN v.id IS NOT NULL THEN [d.lw]
              WHEN length(d.lw) > 4 AND regexp_matches(d.lw, '[-_]') THEN string_split_regex(d.lw, '[-_]')
              ELSE ['<unk>'] END AS cands
  FROM dwords d LEFT JOIN reg_b v ON v.token = d.lw
),
dexp AS (
  SELECT doc_id, pos, unnest(cands) AS cand, unnest(range(len(cands))) AS cpos FROM dcands
),
dlook AS (
  SELECT e.doc_id, e.pos, e.cpos, coalesce(v.id, 2) AS id
  FROM dexp e LEFT JOIN reg_b v ON v.token = e.cand
)"""


@query("registry_b", _vocab_sql("SELECT id, token FROM reg_b", TEXT_CTES))
def q_registry_b(spark, sf_dir):
    return text_registry_b(spark, sf_dir).select("id", "token")


@query("document_tokens", _vocab_sql("""
SELECT doc_id,
       CAST(count(*) AS INTEGER) AS n_tokens,
       CAST(count(*) FILTER (WHERE id = 2) AS INTEGER) AS n_unknown,
       array_to_string(list(CAST(id AS VARCHAR) ORDER BY pos, cpos), ' ') AS ids
FROM dlook GROUP BY doc_id
""", TEXT_CTES))
def q_document_tokens(spark, sf_dir):
    """Rule-B tokenisation of whole documents (split on spaces) with the text
    vocabulary (registry B)."""
    vocab = text_vocabulary(spark, sf_dir)
    out = tk.tokenize_text(documents(spark, sf_dir), vocab, with_tokens=False)
    return out.select("doc_id", F.size("ids").alias("n_tokens"),
                      F.size(F.filter("ids", lambda x: x == vocab.unk_id)).alias("n_unknown"),
                      tk.ids_text("ids").alias("ids"))


@query("vocab_sizes", _vocab_sql("""
SELECT 'a' AS registry, CAST(count(*) AS BIGINT) AS vocab_size FROM reg_a
UNION ALL SELECT 'b', CAST(count(*) + 100 AS BIGINT) FROM reg_b
""", TEXT_CTES))
def q_vocab_sizes(spark, sf_dir):
    """Registry sizes (A26); registry B counts its extra ids once more, as its
    size property does."""
    a = vb.vocab_size(tag_registry_a(spark, sf_dir)).select(F.lit("a").alias("registry"), "vocab_size")
    b = vb.vocab_size(text_registry_b(spark, sf_dir), 100).select(F.lit("b").alias("registry"),
                                                                  "vocab_size")
    return a.unionByName(b).select("registry", F.col("vocab_size").cast("long"))


@query("registry_a_added_tokens", _vocab_sql("""
SELECT id, token FROM reg_a
UNION ALL
SELECT CAST((SELECT max(id) FROM reg_a) + row_number() OVER (ORDER BY label) AS INTEGER), label
FROM (SELECT DISTINCT label FROM glp WHERE prevalence >= 31) g
WHERE label NOT IN (SELECT token FROM reg_a)
"""))
def q_registry_a_added_tokens(spark, sf_dir):
    """Registry A extended with the whole general labels of prevalence >= 31
    that it lacks; new ids follow the existing ones in token order (T6)."""
    tags = tag_corpus(spark, sf_dir).tags
    extra = (ts.label_prevalence(tags, general=True).where(F.col("prevalence") >= 31)
             .select(F.col("label").alias("token")))
    return vb.add_tokens(tag_registry_a(spark, sf_dir), extra).select("id", "token")
