"""Dataset loading by extension, named loaders and token-list files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import range_index
from . import named

EXTENSIONS = ("csv", "json", "txt")


def check_data_args(train_file: str | None, dataset_name: str | None, validation_file: str | None = None) -> None:
    """Some training source must be named, and files must have a known extension (M7)."""
    if not (dataset_name or train_file):
        raise ValueError("no training data: name a dataset or a file")
    for role, path in (("training", train_file), ("validation", validation_file)):
        if path is not None and path.rpartition(".")[2] not in EXTENSIONS:
            raise ValueError(f"{role} file {path!r}: expected one of the extensions {', '.join(EXTENSIONS)}")


def train_and_validation(spark: SparkSession, train_file: str, validation_file: str | None = None,
                         validation_pct: int = 5) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows: of two files, or the first ``validation_pct``
    percent of the one file's rows and the rest."""
    check_data_args(train_file, None, validation_file)
    train = load_by_extension(spark, train_file)
    if validation_file is not None:
        return train, load_by_extension(spark, validation_file)
    numbered = in_file_order(train, "_idx")
    cut = train.count() * validation_pct // 100
    return numbered.where(F.col("_idx") >= cut).drop("_idx"), numbered.where(F.col("_idx") < cut).drop("_idx")


def in_file_order(rows: DataFrame, out: str) -> DataFrame:
    """Rows as a file source reads them, with ``out``, their 0-based position by file name,
    then line: inside a block of a file, rows are read in order by one task."""
    places = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_line"))
    return range_index(places, [F.col(c) for c in ("_file", "_block", "_line")], out).drop("_file", "_block", "_line")


def load_by_extension(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """csv / json / txt file(s) -> DataFrame; ``txt`` lines land in ``text``."""
    ext = extension or path.rsplit(".", 1)[-1]
    if ext == "txt":
        return spark.read.text(path).withColumnRenamed("value", "text")
    if ext == "csv":
        return spark.read.option("header", "true").csv(path)
    if ext == "json":
        return spark.read.json(path)
    raise ValueError(f"unsupported extension {ext!r}; expected one of {EXTENSIONS}")


def text_column(df: DataFrame) -> str:
    """``text`` when present, else the first column."""
    return "text" if "text" in df.columns else df.columns[0]


def read_token_list(spark: SparkSession, path: str) -> DataFrame:
    """One token per line -> ``(rank, token)`` in line order, blank lines dropped
    (S10). Compressed files (``.gz``) are read natively.

    Several files follow one another by name; lists we write ourselves carry ``rank``.
    """
    return in_file_order(spark.read.text(path).where(F.col("value") != ""), "rank").select("rank", F.col("value").alias("token"))


def load_token_list(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, token)`` of a folder of plain or gzip token lists through the ``token_list``
    source: files by name, then lines."""
    named.register(spark)
    lines = spark.read.format("token_list").load(path)
    return range_index(lines, [F.col("file"), F.col("line")], "rank").select("rank", "token")


def load_caption_records(spark: SparkSession, path: str, **options) -> DataFrame:
    """Caption records of plain or gzip JSON lines through the ``caption_json`` source."""
    named.register(spark)
    return spark.read.format("caption_json").options(**options).load(path)


_LOADERS: dict[str, Callable[..., DataFrame]] = {"token_list": load_token_list, "caption_records": load_caption_records}


def register_loader(name: str, fn: Callable[..., DataFrame]) -> None:
    """A named dataset builder of the user's own beside ours (S8); :func:`load_named` calls it."""
    _LOADERS[name] = fn


def load_named(name: str, *args, **kwargs) -> DataFrame:
    if name not in _LOADERS:
        raise KeyError(f"no loader registered under {name!r}; there are {', '.join(sorted(_LOADERS))}")
    return _LOADERS[name](*args, **kwargs)
