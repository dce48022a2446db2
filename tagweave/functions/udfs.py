"""User-callable surface (2.15): user tokenisers as Arrow UDFs, batched maps, and rule A
for SQL users as a function of a value and as a table function for LATERAL joins.

The library's own tokenisation is the join plan of
:mod:`tagweave.operators.tokenize`; these helpers exist so a user can plug in
their own per-label function, or call the rule from SQL on a few values.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import COSPLAY, DELIMITER_PATTERN, QUALIFIER_PATTERN, SHORT_LABEL_MAX, UNK_TOKEN
from ..operators.tokenize import HELD_BYTES
from ..operators.vocab import Vocabulary


def label_tokenizer_udf(fn: Callable[[str], Iterable[str]]):
    """Wrap ``label -> tokens`` as an Arrow-batched UDF returning ``array<string>``."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokenize(labels: pd.Series) -> pd.Series:
        return labels.map(lambda s: None if s is None else list(fn(s)))

    return tokenize


def batched_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Apply a ``pandas.DataFrame -> pandas.DataFrame`` function to Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)


def rule_a(known: set[str]) -> Callable[[str], list[str]]:
    """Rule A for one label against a (small) known-token set: a convenience
    twin of the join plan, for ``register_tokenize_label``."""
    qualifier = re.compile(QUALIFIER_PATTERN)

    def lookup(t: str) -> str:
        return t if t in known else UNK_TOKEN

    def split_form(label: str) -> list[str]:
        quals: list[str] = []
        rest = label
        while True:
            m = qualifier.search(rest)
            if m is None:
                return [lookup(p) for p in re.split(DELIMITER_PATTERN, rest)] + quals
            rest, q = m.group(1), m.group(2)
            quals.insert(0, lookup(q))
            if q == COSPLAY:
                return [lookup(rest)] + quals

    def tokenize(label: str) -> list[str]:
        if label in known:
            return [label]
        if len(label) > SHORT_LABEL_MAX:
            return split_form(label)
        return [UNK_TOKEN]

    return tokenize


def register_tokenize_label(spark: SparkSession, tokens: list[str],
                            name: str = "tokenize_label") -> None:
    """Register rule A as a SQL function over a given token list (small lists
    only: the list travels with the function)."""
    spark.udf.register(name, label_tokenizer_udf(rule_a(set(tokens))))


def register_label_tokens(spark: SparkSession, vocab: Vocabulary, name: str = "label_tokens",
                          held_bytes: int = HELD_BYTES) -> None:
    """Register rule A as a table function: ``LATERAL label_tokens(label)`` gives a row
    ``pos, token, id`` per token of a (lower-cased) label, and no row for null.

    The vocabulary is broadcast, and so must be known to have at most ``held_bytes`` of
    tokens; with a larger one labels are tokenised by ``operators.tokenize.tokenize_labels``.
    """
    if vocab.size is None or vocab.size > held_bytes:
        raise ValueError(f"vocabulary of {vocab.size} bytes, more than {held_bytes}: use tokenize_labels")
    table, unk_id = vocab.table.select("token", "id").toArrow(), vocab.unk_id
    held = spark.sparkContext.broadcast((table["token"].to_pylist(), table["id"].to_pylist()))

    class LabelTokens:
        def __init__(self):
            self.ids = dict(zip(*held.value))
            self.rule = rule_a(self.ids.keys())

        def eval(self, label: str):
            if label is not None:
                for pos, token in enumerate(self.rule(label)):
                    yield pos, token, self.ids.get(token, unk_id)

    spark.udtf.register(name, F.udtf(LabelTokens, returnType="pos int, token string, id int"))
