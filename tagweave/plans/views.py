"""The analysis views as Spark SQL temp views (S15, S16, P7, 3.4).

``register_views`` puts ``files`` / ``tags`` and the eleven named views into
the session catalog, so ad-hoc SQL runs as written (Catalyst inlines the
views). ``tags_of_file`` is the parameterised point lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import FRANCHISES


def _in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(set(values)))


def register_views(spark: SparkSession, files: DataFrame, tags: DataFrame,
                   franchises=FRANCHISES, prefix: str = "") -> list[str]:
    """Create the temp views; returns their names."""
    p = prefix
    files.createOrReplaceTempView(f"{p}files")
    tags.createOrReplaceTempView(f"{p}tags")
    views = {
        "blessed_files": f"""
            SELECT f.booru, f.fid FROM {p}files f
            JOIN {p}tags t ON t.booru = f.booru AND t.fid = f.fid
            WHERE t.tag_cat != 0 AND t.tag IN ({_in_list(franchises)})
            GROUP BY f.booru, f.fid""",
    }
    for general, name, test in ((True, "general", "= 0"), (False, "non_general", "!= 0")):
        base = f"FROM {p}blessed_files b JOIN {p}tags t ON t.booru = b.booru AND t.fid = b.fid " \
               f"WHERE t.tag_cat {test}"
        views[f"{name}_tag_count"] = f"SELECT count(DISTINCT t.tag) AS n {base}"
        views[f"{name}_tag_count_popular"] = \
            f"SELECT count(*) AS n FROM (SELECT t.tag {base} GROUP BY t.tag HAVING count(*) > 40)"
        views[f"{name}_tag_prevalence"] = f"SELECT t.tag, count(*) AS prevalence {base} GROUP BY t.tag"
        views[f"{name}_tag_prevalence_popular"] = \
            f"SELECT t.tag, count(*) AS prevalence {base} GROUP BY t.tag HAVING count(*) > 30"
        views[f"{name}_tags"] = f"SELECT DISTINCT t.tag {base}"
    for name, sql in views.items():
        spark.sql(sql).createOrReplaceTempView(f"{p}{name}")
    return [f"{p}files", f"{p}tags"] + [f"{p}{n}" for n in views]


def tags_of_file(spark: SparkSession, booru: str, fid: int, prefix: str = "") -> DataFrame:
    """Tags of one file, one row per tag, in tag order (P7, A17, O6), with
    bound parameters instead of string formatting."""
    return spark.sql(
        f"SELECT tag, min(tag_cat) AS tag_cat FROM {prefix}tags "
        "WHERE booru = :booru AND fid = :fid GROUP BY tag ORDER BY tag",
        args={"booru": booru, "fid": fid})
