"""Registry of named queries and their SQL twins.

A query is a function ``(spark, sf_dir) -> DataFrame`` built from the library
operators. Its twin, when it has one, is SQL that DuckDB runs over the same
parquet tables; the two are compared row by row by the correctness check.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Optional

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: Optional[str] = None):
    """Register ``fn`` under ``name`` with an optional SQL twin."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query name {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return wrap


def _load_all() -> None:
    # Importing the modules registers their queries.
    from . import q_tagstats, q_vocab, q_captions, q_spans, q_features, q_ingest, q_stream, q_subword  # noqa: F401


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
