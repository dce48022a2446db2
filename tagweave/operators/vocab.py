"""Vocabulary building: prevalence lists -> token lists -> id registries.

* :func:`peel_qualifiers` -- the right-to-left ``_(qualifier)`` peel shared by
  the token-count job (T1) and the label tokeniser (T7). It runs as one
  ``aggregate`` over an array with one slot per ``)`` in the label (each peel
  consumes one), so the depth bound is exact and there is no driver loop.
* :func:`general_token_counts` -- weighted token counts (A16): explode the
  parts of every *distinct* label with its prevalence, ``groupBy.sum``.
* :func:`ranked` / :func:`general_tokens` / :func:`label_tokens` -- threshold
  and rank (T2, T3) with the two-level global index (no single-task sort).
* :func:`registry_a` / :func:`registry_b` -- ordered first-occurrence unions
  with dense ids (T4, T5, U4, U5), :func:`add_tokens` (T6).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (COSPLAY, EOS_TOKEN, EXTRA_ID_FORMAT, GENERAL_TOKEN_MIN, NAME_LABEL_MIN,
                      PAD_TOKEN, QUALIFIER_PATTERN, SHORT_LABEL_MAX, UNK_TOKEN)
from ..functions.text import awk_truthy, char_length, col_, split_delimiters
from .ranking import range_index



def peel_qualifiers(label) -> Column:
    """``struct<rest, quals, cosplay>`` of repeatedly removing a trailing ``_(q)``.

    ``quals`` are in peel order (last qualifier of the label first). The peel
    stops after a ``cosplay`` qualifier (``cosplay`` true) or when no trailing
    group is left.
    """
    label = col_(label)
    closes = (char_length(label) - char_length(F.replace(label, F.lit(")"), F.lit("")))).cast("int")
    init = F.struct(label.alias("rest"), F.array().cast("array<string>").alias("quals"),
                    F.lit(False).alias("done"), F.lit(False).alias("cosplay"))

    def step(acc, _):
        q = F.regexp_extract(acc.rest, QUALIFIER_PATTERN, 2)
        nominal = F.regexp_extract(acc.rest, QUALIFIER_PATTERN, 1)
        peeled = F.struct(nominal.alias("rest"), F.concat(acc.quals, F.array(q)).alias("quals"),
                          (q == COSPLAY).alias("done"), (q == COSPLAY).alias("cosplay"))
        stopped = F.struct(acc.rest.alias("rest"), acc.quals.alias("quals"),
                           F.lit(True).alias("done"), F.lit(False).alias("cosplay"))
        return (F.when(acc.done, acc)
                .when(acc.rest.rlike(QUALIFIER_PATTERN), peeled)
                .otherwise(stopped))

    return F.aggregate(F.array_repeat(F.lit(0), closes), init, step)


def general_label_parts(label) -> Column:
    """Token strings one general label contributes to the counts.

    Short labels count whole (if awk would find them true); longer labels count
    every peeled qualifier, then either the nominal whole (after ``cosplay``)
    or its ``-``/``_`` parts that awk finds true.
    """
    label = F.coalesce(col_(label), F.lit(""))
    p = peel_qualifiers(label)
    short = F.when(awk_truthy(label), F.array(label)).otherwise(F.array().cast("array<string>"))
    rest = F.when(p.cosplay, F.array(p.rest)).otherwise(
        F.filter(split_delimiters(p.rest), awk_truthy))
    return F.when(char_length(label) <= SHORT_LABEL_MAX, short).otherwise(F.concat(p.quals, rest))


def general_token_counts(label_prevalence: DataFrame) -> DataFrame:
    """``(token, count)``: sum of label prevalences over label parts.

    Input is the prevalence list ``(prevalence, label)`` (one row per distinct
    label), so the explode is per distinct label; the sum is a partial + final
    aggregate keyed by token.
    """
    return (label_prevalence
            .select(F.explode(general_label_parts("label")).alias("token"), "prevalence")
            .groupBy("token").agg(F.sum("prevalence").alias("count")))


def ranked(df: DataFrame, count_col: str, token_col: str, token_desc: bool) -> DataFrame:
    """``rank`` = position in (count desc, token desc|asc), 0-based, exact."""
    tok = F.col(token_col)
    return range_index(df, [F.col(count_col).desc(), tok.desc() if token_desc else tok.asc()], "rank")


def general_tokens(token_counts: DataFrame, min_count: int = GENERAL_TOKEN_MIN) -> DataFrame:
    """``(rank, token, count)`` with count >= ``min_count``.

    Ordered by count descending, then token descending (a reverse numeric sort
    breaks ties by the whole line, reversed).
    """
    kept = token_counts.where(F.col("count") >= min_count)
    return ranked(kept, "count", "token", token_desc=True).select("rank", "token", "count")


def label_tokens(name_prevalence: DataFrame, min_count: int = NAME_LABEL_MIN) -> DataFrame:
    """``(rank, token, count)``: non-general labels with prevalence >= ``min_count``."""
    kept = (name_prevalence.where(F.col("prevalence") >= min_count)
            .select(F.col("label").alias("token"), F.col("prevalence").alias("count")))
    return ranked(kept, "count", "token", token_desc=False).select("rank", "token", "count")


def _specials(spark: SparkSession, tokens) -> DataFrame:
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(tokens)],
                                 "origin int, rank long, token string")


def _listed(df: DataFrame, origin: int) -> DataFrame:
    # Blank lines of a token file are skipped when it is read.
    return (df.where(F.col("token") != "")
            .select(F.lit(origin).alias("origin"), F.col("rank").cast("long"), "token"))


def extra_id_tokens(spark: SparkSession, n: int, origin: int = 3) -> DataFrame:
    return spark.range(n).select(
        F.lit(origin).alias("origin"), F.col("id").alias("rank"),
        F.format_string(EXTRA_ID_FORMAT.replace("{}", "%d"), F.col("id")).alias("token"))


def _number(entries: DataFrame, group: str = "origin") -> DataFrame:
    """Dense ids in (group, rank) order."""
    return range_index(entries, [F.col(group), F.col("rank")], "id").select(F.col("id").cast("int").alias("id"), "token", "origin")


def registry_a(spark: SparkSession, label_toks: DataFrame, general_toks: DataFrame,
               extra_tokens: DataFrame | None = None) -> DataFrame:
    """``<pad>``=0, ``<unk>``=1, labels, general tokens, extra tokens (T4, U4).

    A token keeps its first position: ``min(struct(origin, rank))`` per token
    is a keyed aggregate, then the survivors are numbered densely.
    """
    parts = [_specials(spark, (PAD_TOKEN, UNK_TOKEN)), _listed(label_toks, 1),
             _listed(general_toks, 2)]
    if extra_tokens is not None:
        parts.append(extra_tokens.select(F.lit(3).alias("origin"), F.col("rank").cast("long"),
                                         "token"))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    first = (union.groupBy("token").agg(F.min(F.struct("origin", "rank")).alias("f"))
             .select(F.col("f.origin").alias("origin"), F.col("f.rank").alias("rank"), "token"))
    return _number(first)


def registry_b(spark: SparkSession, label_toks: DataFrame, general_toks: DataFrame,
               extra_ids: int = 100) -> DataFrame:
    """``<pad>``,``</s>``,``<unk>`` = 0,1,2; labels not among the general tokens;
    general tokens; ``<extra_id_0..n-1>`` (T5, U5). No other de-duplication:
    a token listed twice is reported by :func:`duplicate_tokens`."""
    labels = _listed(label_toks, 1)
    general = _listed(general_toks, 2)
    labels = labels.join(general.select("token"), "token", "left_anti")
    union = (_specials(spark, (PAD_TOKEN, EOS_TOKEN, UNK_TOKEN))
             .unionByName(labels).unionByName(general)
             .unionByName(extra_id_tokens(spark, extra_ids)))
    return _number(union)


def duplicate_tokens(registry: DataFrame) -> DataFrame:
    return (registry.groupBy("token").agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def add_tokens(registry: DataFrame, new_tokens: DataFrame) -> DataFrame:
    """Append tokens not yet present, with ids after the current ones.

    Existing rows keep their (dense) ids; new tokens follow in token order.
    """
    fresh = new_tokens.select("token").distinct().join(registry.select("token"), "token",
                                                        "left_anti")
    numbered = range_index(fresh, [F.col("token")], "pos")
    existing = registry.select(F.lit(0).alias("part"), F.col("id").cast("long").alias("rank"),
                               "token", "origin")
    added = numbered.select(F.lit(1).alias("part"), F.col("pos").alias("rank"), "token",
                            F.lit(4).alias("origin"))
    return _number(existing.unionByName(added), group="part")


def vocab_size(registry: DataFrame, extra_ids_counted_twice: int = 0) -> DataFrame:
    """Registry size (A26); registry B reports ``extra_ids`` on top of its rows."""
    return registry.agg((F.count(F.lit(1)) + F.lit(extra_ids_counted_twice)).alias("vocab_size"))


@dataclass
class Vocabulary:
    """A registry DataFrame with its special ids resolved."""

    table: DataFrame          # (id int, token string, origin int)
    pad_id: int
    unk_id: int
    eos_id: int | None = None
    rows: int | None = None   # row count once written
    size: int | None = None   # bytes of its tokens once written

    @property
    def unk_token(self) -> str:
        return UNK_TOKEN


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(token, count)`` of lower-cased space-separated words of a text column
    (the general-token list of a text corpus); empty pieces are not words."""
    from ..functions.text import split_words, unicode_lower
    words = docs.select(F.explode(split_words(text_col)).alias("w"))
    return (words.select(unicode_lower("w").alias("token")).where(F.col("token") != "")
            .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
