"""Named analysis queries over the tag corpus (views, counts, joins, frames)."""

from __future__ import annotations

from ..operators import quality, tagstats as ts
from ..sources.store import RESULTS, create_table
from ..sources.tables import SOURCES, table_paths, tag_corpus
from .catalog import query
from .oracle_sql import ascii_lower_sql, sql_list, with_corpus

# Fixture parameters: the derived corpus has nation names as franchise tags
# and "<nation>_(cosplay)" as general tags.
FIXTURE_FRANCHISES = ("nation_0", "nation_3", "nation_15")
FIXTURE_GENERAL_LIST = ("nation_0_(cosplay)", "nation_3_(cosplay)")
FIXTURE_SPLIT_FRANCHISES = ("nation_0", "nation_3")

BLESSED_CTE = f"""
blessed_files AS (
  SELECT f.booru, f.fid
  FROM files f
  JOIN tags t ON t.booru = f.booru AND t.fid = f.fid
  WHERE t.tag_cat != 0 AND t.tag IN ({sql_list(FIXTURE_FRANCHISES)})
  GROUP BY f.booru, f.fid
)"""


def _view_sql(select: str, cat_test: str, tail: str = "") -> str:
    body = f"""
{select}
FROM blessed_files b
JOIN tags t ON t.booru = b.booru AND t.fid = b.fid
WHERE t.tag_cat {cat_test}
{tail}"""
    return body


def _blessed(body: str) -> str:
    return with_corpus(BLESSED_CTE, body=body)


def _corpus(spark, sf_dir):
    return tag_corpus(spark, sf_dir)


@query("blessed_files", _blessed("SELECT booru, fid FROM blessed_files"))
def q_blessed_files(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return ts.blessed_files(c.files, c.tags, FIXTURE_FRANCHISES)


@query("file_count", _blessed("SELECT count(*) AS n FROM blessed_files"))
def q_file_count(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return ts.file_count(c.files, c.tags, FIXTURE_FRANCHISES)


for _general, _prefix, _test in ((True, "general", "= 0"), (False, "non_general", "!= 0")):

    def _make(general=_general, prefix=_prefix, test=_test):
        @query(f"{prefix}_tag_count",
               _blessed(_view_sql("SELECT count(DISTINCT t.tag) AS n", test)))
        def q_count(spark, sf_dir):
            c = _corpus(spark, sf_dir)
            return ts.tag_count(c.files, c.tags, general, FIXTURE_FRANCHISES)

        @query(f"{prefix}_tag_count_popular",
               _blessed("SELECT count(*) AS n FROM ("
                        + _view_sql("SELECT t.tag", test, "GROUP BY t.tag HAVING count(*) > 40")
                        + ") x"))
        def q_count_popular(spark, sf_dir):
            c = _corpus(spark, sf_dir)
            return ts.tag_count_popular(c.files, c.tags, general, FIXTURE_FRANCHISES)

        @query(f"{prefix}_tag_prevalence",
               _blessed(_view_sql("SELECT t.tag, count(*) AS prevalence", test, "GROUP BY t.tag")))
        def q_prevalence(spark, sf_dir):
            c = _corpus(spark, sf_dir)
            return ts.tag_prevalence(c.files, c.tags, general, FIXTURE_FRANCHISES)

        @query(f"{prefix}_tag_prevalence_popular",
               _blessed(_view_sql("SELECT t.tag, count(*) AS prevalence", test,
                                  "GROUP BY t.tag HAVING count(*) > 30")))
        def q_prevalence_popular(spark, sf_dir):
            c = _corpus(spark, sf_dir)
            return ts.popular_prevalence(c.files, c.tags, general, FIXTURE_FRANCHISES)

        @query(f"{prefix}_tags", _blessed(_view_sql("SELECT DISTINCT t.tag", test)))
        def q_tags(spark, sf_dir):
            c = _corpus(spark, sf_dir)
            return ts.distinct_tags(c.files, c.tags, general, FIXTURE_FRANCHISES)

    _make()


@query("names_of_files_with_general_list", with_corpus(body=f"""
SELECT DISTINCT t2.tag
FROM files f
JOIN tags t2 ON t2.booru = f.booru AND t2.fid = f.fid
WHERE t2.tag_cat != 0
  AND EXISTS (SELECT NULL FROM tags t
              WHERE t.booru = f.booru AND t.fid = f.fid AND t.tag_cat = 0
                AND t.tag IN ({sql_list(FIXTURE_GENERAL_LIST)}))
"""))
def q_names_of_files_with_general(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return ts.names_of_files_with_general(c.files, c.tags, FIXTURE_GENERAL_LIST)


def _label_prevalence_sql(test: str) -> str:
    return with_corpus(body=f"""
SELECT count(*) AS prevalence, {ascii_lower_sql('t.tag')} AS label
FROM tags t WHERE t.tag_cat {test}
GROUP BY {ascii_lower_sql('t.tag')}
""")


@query("general_label_prevalence", _label_prevalence_sql("= 0"))
def q_general_label_prevalence(spark, sf_dir):
    return ts.label_prevalence(_corpus(spark, sf_dir).tags, general=True)


@query("name_label_prevalence", _label_prevalence_sql("!= 0"))
def q_name_label_prevalence(spark, sf_dir):
    return ts.label_prevalence(_corpus(spark, sf_dir).tags, general=False)


_FRAMES_SQL = with_corpus(body="""
SELECT booru, fid, CAST(unnest(range(frames)) AS INTEGER) AS frame FROM frame_counts
""")


@query("frames", _FRAMES_SQL)
def q_frames(spark, sf_dir):
    return ts.frames(_corpus(spark, sf_dir).frame_counts)


@query("stored_frames", with_corpus(body="""
SELECT booru, fid, CAST(unnest(range(CASE WHEN booru = '2-HIGH' THEN frames // 2 ELSE frames END)) AS INTEGER) AS frame
FROM frame_counts
"""))
def q_stored_frames(spark, sf_dir):
    """A stored frames table filled by insert-select; then one booru is inserted again with
    half of its frame counts and replaces itself alone (S5)."""
    counts = _corpus(spark, sf_dir).frame_counts

    def build(base, _files):
        table = create_table(spark, f"{base}/frames", "fid BIGINT, frame INT, booru STRING", "booru")
        ts.insert_frames(counts, table)
        again = counts.where("booru = '2-HIGH'").selectExpr("booru", "fid", "frames div 2 AS frames")
        ts.insert_frames(again, table, overwrite=True)
        return table

    return spark.table(RESULTS.get(spark, "frames", table_paths(sf_dir, *SOURCES), build)).select("booru", "fid", "frame")


_SPLIT_FILES_CTE = f"""
franchise_files AS (
  SELECT f.booru, f.fid FROM files f
  WHERE EXISTS (SELECT NULL FROM tags t
                WHERE f.booru = t.booru AND f.fid = t.fid
                  AND t.tag IN ({sql_list(FIXTURE_SPLIT_FRANCHISES)}))
),
validation AS (SELECT booru, fid FROM franchise_files ORDER BY booru, fid LIMIT 128)"""


@query("validation_files", with_corpus(_SPLIT_FILES_CTE, body="SELECT booru, fid FROM validation"))
def q_validation_files(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return ts.validation_files(c.files, c.tags, 128, FIXTURE_SPLIT_FRANCHISES)


@query("test_files", with_corpus(_SPLIT_FILES_CTE, body="""
SELECT f.booru, f.fid FROM files f
WHERE (f.booru, f.fid) NOT IN (SELECT (booru, fid) FROM validation)
"""))
def q_test_files(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return ts.test_files(c.files, c.tags, 128, FIXTURE_SPLIT_FRANCHISES)


@query("tag_key_duplicates", with_corpus(body="""
SELECT booru, fid, tag, count(*) AS copies FROM tags GROUP BY booru, fid, tag HAVING count(*) > 1
"""))
def q_tag_key_duplicates(spark, sf_dir):
    return quality.duplicate_keys(_corpus(spark, sf_dir).tags, quality.TAG_KEY)


@query("file_key_duplicates", with_corpus(body="""
SELECT booru, fid, count(*) AS copies FROM files GROUP BY booru, fid HAVING count(*) > 1
"""))
def q_file_key_duplicates(spark, sf_dir):
    return quality.duplicate_keys(_corpus(spark, sf_dir).files, quality.FILE_KEY)


@query("orphan_tags", with_corpus(body="""
SELECT t.booru, t.fid, t.tag, t.tag_id, t.tag_cat, t.danb_fr FROM tags t
WHERE NOT EXISTS (SELECT NULL FROM files f WHERE f.booru = t.booru AND f.fid = t.fid)
"""))
def q_orphan_tags(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return quality.orphan_tags(c.tags, c.files)


_FILE_COLS = ("booru", "fid", "shard", "file_name", "torr_md5")


@query("file_null_counts", with_corpus(body=" UNION ALL ".join(
    f"SELECT 'files' AS table_name, '{c}' AS column_name, "
    f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls FROM files"
    for c in _FILE_COLS)))
def q_file_null_counts(spark, sf_dir):
    return quality.null_counts(_corpus(spark, sf_dir).files, "files", list(_FILE_COLS))


@query("files_without_tags", with_corpus(body="""
SELECT f.booru, f.fid FROM files f
WHERE NOT EXISTS (SELECT NULL FROM tags t WHERE t.booru = f.booru AND t.fid = f.fid)
"""))
def q_files_without_tags(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return c.files.select("booru", "fid").join(c.tags.select("booru", "fid"),
                                                ["booru", "fid"], "left_anti")



@query("sql_view_general_prevalence_popular",
       _blessed(_view_sql("SELECT t.tag, count(*) AS prevalence", "= 0",
                          "GROUP BY t.tag HAVING count(*) > 30")))
def q_sql_view_general_prevalence_popular(spark, sf_dir):
    """The same view answered through Spark SQL temp views (views registered
    over the stored corpus, queried by name)."""
    from .views import register_views
    c = _corpus(spark, sf_dir)
    register_views(spark, c.files, c.tags, FIXTURE_FRANCHISES, prefix="tw_")
    return spark.sql("SELECT tag, prevalence FROM tw_general_tag_prevalence_popular")
