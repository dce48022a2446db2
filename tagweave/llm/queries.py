"""The registered queries of the operators, each over its whole table with
production parameters, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table as table
from . import align, dartminhash, decontam, itq, langid, linedup, lm, mixing, phrases, quality, sitestyle, tokenbin, urlfilter
from .common import crc_of_id

TOKENIZER, END_ID = "word_bpe_49k.json", 2


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is 1 modulo 3; a null id is not held out."""
    return F.coalesce(crc_of_id(doc_id) % 3 == 1, F.lit(False))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents by source weights 3, 1, 2 takes of each."""
    mixed = mixing.mix(spark, table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by cross-parsing, learned from the training fold."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(spark, docs, langid.training_fold(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by positive-unlabelled learning on the training fold."""
    scored = quality.score_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda c: crc_of_id(c) % 3 != 1)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page with its host's style tree."""
    text = sitestyle.extract_pages(spark, table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier document holds."""
    out = linedup.dedup_lines(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, d, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT r, d, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(d) AS lo, max(d) AS hi FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(d) <> max(d)),
marked AS (SELECT k.r, k.pos, k.line, f.lo IS NOT NULL AND k.d <> f.lo AS gone FROM keyed k LEFT JOIN firsts f USING (key)),
kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM docs JOIN kept USING (r)
"""


def dated_lists(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stand-in input: fetch times for pages, and dated entries for their hosts, parent
    domains and URLs; times and choices follow from hashes of ids and names."""
    day = lambda n: F.timestamp_add("DAY", n, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int")
    captures = pages.select("page_id", "url", day(F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched_at"))
    urls = pages.select("url").distinct().withColumn("host", F.lower(F.regexp_extract("url", urlfilter.HOST, 1))).where("host <> ''")
    hosts = urls.select("host").distinct().withColumn("n", number(F.col("host").cast("binary")))
    row = lambda df, name, verdict, kind, key, action, at: df.select(
        F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(action).alias("action"), day(at).alias("at"))
    n = F.col("n")
    parents = hosts.select(F.regexp_replace("host", r"^[^.]*\.", "").alias("parent")).where("parent like '%.%'").distinct().withColumn("n", number(F.col("parent").cast("binary")))
    named = urls.select(urlfilter.url_key(F.col("url")).alias("key")).distinct().withColumn("n", number(F.col("key").cast("binary")))
    events = [row(hosts, "spam", "block", "host", F.col("host"), "add", n % 120),
              row(hosts.where("n % 3 = 0"), "spam", "block", "host", F.col("host"), "remove", 120 + n % 97),
              row(hosts.where("n % 6 = 0"), "spam", "block", "host", F.col("host"), "add", 250 + n % 60),
              row(parents.where("n % 5 = 0"), "network", "block", "domain", F.col("parent"), "add", 200 + n % 90),
              row(named.where("n % 10 = 0"), "review", "allow", "url", F.col("key"), "add", n % 300)]
    out = events[0]
    for more in events[1:]:
        out = out.union(more)
    return captures, out


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture against the list entries active at its fetch time."""
    captures, events = dated_lists(table(spark, sf_dir, "pages"))
    out = urlfilter.filter_urls(captures, events)
    return out.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd"))


OP6_SQL = r"""
WITH captures AS (SELECT row_number() OVER () AS r, page_id, url, TIMESTAMP '2024-01-01' + to_days(((page_id * 37) % 366)::INT) AS fetched_at,
  regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', '') AS host,
  regexp_replace(url, '#(.|\n)*', '') AS bare FROM pages),
keyed AS (SELECT *, lower(regexp_extract(bare, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*')) AS head FROM captures),
k AS (SELECT r, page_id, url, fetched_at, host, head || substr(bare, length(head) + 1) AS url_key FROM keyed),
hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 4))::INT AS n FROM k WHERE host <> ''),
parents AS (SELECT DISTINCT p AS parent, ('0x' || substr(md5(p), 1, 4))::INT AS n FROM (SELECT regexp_replace(host, '^[^.]*\.', '') AS p FROM hosts) WHERE p LIKE '%.%'),
urls AS (SELECT DISTINCT url_key, ('0x' || substr(md5(url_key), 1, 4))::INT AS n FROM k WHERE host <> ''),
spans AS (
  SELECT 'spam' AS list, 'block' AS verdict, 'host' AS kind, host AS key, n % 120 AS a, CASE WHEN n % 3 = 0 THEN 120 + n % 97 END AS b FROM hosts
  UNION ALL SELECT 'spam', 'block', 'host', host, 250 + n % 60, NULL FROM hosts WHERE n % 6 = 0
  UNION ALL SELECT 'network', 'block', 'domain', parent, 200 + n % 90, NULL FROM parents WHERE n % 5 = 0
  UNION ALL SELECT 'review', 'allow', 'url', url_key, n % 300, NULL FROM urls WHERE n % 10 = 0),
matches AS (SELECT k.r, s.list, s.verdict FROM k JOIN spans s ON
  ((s.kind = 'host' AND s.key = k.host) OR (s.kind = 'domain' AND ('.' || k.host) LIKE ('%.' || s.key)) OR (s.kind = 'url' AND s.key = k.url_key))
  AND k.fetched_at >= TIMESTAMP '2024-01-01' + to_days(s.a::INT) AND (s.b IS NULL OR k.fetched_at < TIMESTAMP '2024-01-01' + to_days(s.b::INT))),
found AS (SELECT r, count(*) FILTER (verdict = 'block') AS n_block, count(*) FILTER (verdict = 'allow') AS n_allow, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM matches GROUP BY r)
SELECT page_id, url, strftime(fetched_at, '%Y-%m-%d') AS fetched_at, coalesce(n_block, 0) AS n_block, coalesce(n_allow, 0) AS n_allow, coalesce(lists, '') AS lists,
  coalesce(n_block, 0) > 0 AND coalesce(n_allow, 0) = 0 AS blocked FROM k LEFT JOIN found USING (r)
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    found = decontam.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT r, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs) d, sizes s WHERE i + s.n - 1 <= len(w)),
hits AS (SELECT r, item, i, n FROM grams JOIN wins USING (n, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    out = dartminhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


OP8_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
reps AS (SELECT w, min(doc_id) AS rep FROM docs WHERE len(w) > 0 GROUP BY w),
grams AS (SELECT rep, g, count(*) AS c FROM (SELECT rep, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM reps)) GROUP BY rep, g),
sizes AS (SELECT rep, sum(c) AS n FROM grams GROUP BY rep),
common AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.c, b.c)) AS lo FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM common JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b WHERE lo / (x.n + y.n - lo) >= 0.8),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS v, rep AS c FROM reps UNION SELECT ends.b, reach.c FROM reach JOIN ends ON ends.a = reach.v),
classes AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(c.c, d.doc_id) AS class_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept FROM docs d LEFT JOIN reps r ON r.w = d.w LEFT JOIN classes c ON c.v = r.rep
"""


def op9_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survivor flag of every vector."""
    return itq.link_vectors(spark, table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE good AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.v),
parts AS (SELECT v, min(c) AS c FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN parts ON v = vec_id LEFT JOIN n ON a = vec_id
"""


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to bit-packed files and read back."""
    return tokenbin.token_files(spark, table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' ids of every document."""
    return align.align_tokenizers(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best-scoring phrases of two and three words."""
    return phrases.collocations(spark, table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM docs),
places AS (SELECT lang, w, o, unnest(range(1, len(w) - o + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS v(o)),
grams AS (SELECT lang, o, w[i:i + o - 1] AS p, count(*)::HUGEINT AS f FROM places GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE o = 1 GROUP BY lang),
cand AS (SELECT * FROM grams WHERE o >= 2 AND f >= 10),
longer AS (SELECT lang, p[1:2] AS p, f FROM cand WHERE o = 3 UNION ALL SELECT lang, p[2:3], f FROM cand WHERE o = 3),
most AS (SELECT lang, p, max(f) AS f FROM longer GROUP BY ALL),
cuts AS (SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, (1000000 * c.f * c.f) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, o)) AS k FROM cand) c JOIN grams x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN grams y ON y.lang = c.lang AND y.p = c.p[k + 1:c.o]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
kept AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.p = b.p WHERE m.f IS NULL OR 100 * m.f < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and attention-model score of every document."""
    import public_tokenizers

    fold = crc_of_id(F.col("doc_id")) % 7
    return lm.score_documents(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, fold == 2, fold != 2)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_language_id, op3_quality, op4_page_text, op5_line_dedup, op6_url_filters,
                                   op7_decontaminate, op8_near_duplicates, op9_vector_links, op10_token_files, op11_token_alignment, op12_phrase_collocations, op13_lm_scores)}
ORACLES = {"op5_line_dedup": OP5_SQL, "op6_url_filters": OP6_SQL, "op7_decontaminate": OP7_SQL, "op8_near_duplicates": OP8_SQL, "op9_vector_links": OP9_SQL,
           "op12_phrase_collocations": OP12_SQL}
