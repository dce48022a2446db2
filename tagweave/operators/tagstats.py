"""The analysis views: franchise files, their tags, prevalence and counts.

Every function takes the ``files`` / ``tags`` DataFrames and returns a
DataFrame; nothing is collected. Shuffle plan at scale:

* the franchise filter (``tag_cat != 0 AND tag IN (...)``) is pushed to the
  parquet scan of ``tags`` (an ``InSet`` predicate);
* the distinct file keys are pre-aggregated map-side before the shuffle;
* "tags of the chosen files" is a left-semi join on ``(booru, fid)`` -- no
  row multiplication, and with ``tags`` bucketed by ``(booru, fid)`` no
  shuffle of the big side;
* prevalence is ``groupBy(tag)`` with partial aggregation, so a tag sitting on
  a third of all files costs one partial row per map task, not a hot reducer.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (CAT_GENERAL, FRANCHISES, POPULAR_COUNT_MIN,
                      POPULAR_LIST_MIN)
from ..functions.text import ascii_lower
from ..sources.store import insert_into

KEY = ["booru", "fid"]


def _names(franchises: Iterable[str] | None) -> list[str]:
    # The reference list repeats one name; an IN list is a set either way.
    return sorted(set(FRANCHISES if franchises is None else franchises))


def is_general(tags: DataFrame):
    return tags.tag_cat == CAT_GENERAL


def is_non_general(tags: DataFrame):
    # NULL categories pass neither test, as in SQL.
    return tags.tag_cat != CAT_GENERAL


def blessed_files(files: DataFrame, tags: DataFrame, franchises=None) -> DataFrame:
    """Distinct files carrying a non-general tag from the franchise list (A1)."""
    hits = (tags.where(is_non_general(tags) & tags.tag.isin(_names(franchises)))
            .select(*KEY).distinct())
    return hits.join(files.select(*KEY), KEY, "left_semi")


def file_count(files: DataFrame, tags: DataFrame, franchises=None) -> DataFrame:
    """``count(*)`` of the franchise files (A2)."""
    return blessed_files(files, tags, franchises).agg(F.count(F.lit(1)).alias("n"))


def tags_of_blessed(files: DataFrame, tags: DataFrame, general: bool,
                    franchises=None) -> DataFrame:
    """Tag rows (general or non-general) of the franchise files (J1 as a semi join)."""
    chosen = blessed_files(files, tags, franchises)
    side = tags.where(is_general(tags) if general else is_non_general(tags))
    return side.join(chosen, KEY, "left_semi")


def tag_prevalence(files, tags, general: bool, franchises=None, more_than: int | None = None):
    """Count per tag (A6 / A11); ``more_than`` adds the HAVING of A7 / A12."""
    counted = (tags_of_blessed(files, tags, general, franchises)
               .groupBy("tag").agg(F.count(F.lit(1)).alias("prevalence")))
    if more_than is not None:
        counted = counted.where(F.col("prevalence") > more_than)
    return counted


def distinct_tags(files, tags, general: bool, franchises=None) -> DataFrame:
    """Distinct tags."""
    return tags_of_blessed(files, tags, general, franchises).select("tag").distinct()


def tag_count(files, tags, general: bool, franchises=None) -> DataFrame:
    """``count(distinct tag)``.

    Written as distinct-then-count so the distinct is a partial + final hash
    aggregate on ``tag`` instead of a single-group aggregate holding a set.
    """
    return distinct_tags(files, tags, general, franchises).agg(F.count(F.lit(1)).alias("n"))


def tag_count_popular(files, tags, general: bool, franchises=None,
                      more_than: int = POPULAR_COUNT_MIN) -> DataFrame:
    """Number of tags whose count exceeds ``more_than`` (A5 / A10)."""
    return (tag_prevalence(files, tags, general, franchises, more_than)
            .agg(F.count(F.lit(1)).alias("n")))


def popular_prevalence(files, tags, general: bool, franchises=None,
                       more_than: int = POPULAR_LIST_MIN) -> DataFrame:
    return tag_prevalence(files, tags, general, franchises, more_than)


def names_of_files_with_general(files: DataFrame, tags: DataFrame, labels) -> DataFrame:
    """Distinct non-general tags of files that carry a general tag from ``labels``.

    The stand-alone query file has its category tests the other way round from
    the ``general_tags`` view; both are kept (A3). EXISTS becomes a semi join.
    """
    wanted = (tags.where(is_general(tags) & tags.tag.isin(sorted(set(labels))))
              .select(*KEY).distinct())
    with_files = files.select(*KEY).join(wanted, KEY, "left_semi")
    return (tags.where(is_non_general(tags)).join(with_files, KEY, "left_semi")
            .select("tag").distinct())


def label_prevalence(tags: DataFrame, general: bool) -> DataFrame:
    """Corpus prevalence per ASCII-lower-cased label.

    Returns ``(prevalence, label)``; order with :func:`order_prevalence`.
    """
    side = tags.where(is_general(tags) if general else is_non_general(tags))
    return (side.groupBy(ascii_lower("tag").alias("label"))
            .agg(F.count(F.lit(1)).alias("prevalence"))
            .select("prevalence", "label"))


def order_prevalence(df: DataFrame) -> DataFrame:
    """Prevalence descending, label ascending as the tie-break."""
    return df.orderBy(F.desc("prevalence"), F.asc("label"))


def frames(frame_counts: DataFrame) -> DataFrame:
    """One row per (file, frame number) with ``0 <= frame < frames``.

    The theta join ``x < frames`` against a list of numbers becomes a
    generator: ``sequence`` builds exactly the matching numbers per row, so no
    nested-loop join, no shuffle and no longest file.
    """
    return (frame_counts.where(F.col("frames") > 0)
            .select(*KEY, F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame")))


def insert_frames(frame_counts: DataFrame, table: str, overwrite: bool = False) -> None:
    """Insert the frames of ``frame_counts`` into the stored ``table`` (S5); with
    ``overwrite`` the boorus among them replace themselves and the others stay."""
    insert_into(frames(frame_counts), table, overwrite)


def franchise_files(files: DataFrame, tags: DataFrame, franchises) -> DataFrame:
    """Files with any tag in ``franchises`` (EXISTS of the split queries)."""
    hits = tags.where(tags.tag.isin(sorted(set(franchises)))).select(*KEY).distinct()
    return files.select(*KEY).join(hits, KEY, "left_semi")


def validation_files(files: DataFrame, tags: DataFrame, limit: int = 128,
                     franchises=("hololive", "touhou")) -> DataFrame:
    """First ``limit`` franchise files in key order.

    The reference has LIMIT without ORDER; the key order makes it repeatable.
    ``orderBy().limit()`` plans as TakeOrderedAndProject: a per-partition top-k
    then a merge of k rows per partition, never a global sort.
    """
    return franchise_files(files, tags, franchises).orderBy(*KEY).limit(limit)


def test_files(files: DataFrame, tags: DataFrame, validation_limit: int = 128,
               franchises=("hololive", "touhou")) -> DataFrame:
    """All files except the validation selection (O5, NOT IN as an anti join)."""
    chosen = validation_files(files, tags, validation_limit, franchises)
    return files.select(*KEY).join(chosen, KEY, "left_anti")
