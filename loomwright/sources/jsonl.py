"""Tolerant JSON lines, catalogs and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .publish import publish, read_published


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with ``ok``: whether the line is JSON. The torn last line of a file that is still being written is not ok."""
    return mark_lines(spark.read.text(path))


def mark_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("value").rlike(r"\S")).withColumn("ok", F.try_parse_json("value").isNotNull())


def read_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the decodable lines, and the count of skipped ones."""
    lines = read_lines(spark, path)
    rows = lines.filter("ok").select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows, lines.agg(F.count_if(~F.col("ok")).alias("skipped"))


READERS = {"parquet": "parquet", "json": "json", "jsonl": "json"}


def scan(spark: SparkSession, path: str, where: Column | str | None = None, columns: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """Rows of a Parquet or JSON dataset that satisfy ``where``; filter and columns reach the reader.

    ``kind`` is taken from the path's ending by default. A condition that is
    null for a row drops it.
    """
    kind = kind or READERS.get(path.rstrip("/").rpartition(".")[2])
    if kind not in READERS.values():
        raise ValueError(f"no reader for {path}")
    rows = spark.read.format(kind).load(path)
    rows = rows if where is None else rows.filter(where)
    return rows.select(*columns) if columns else rows


def scan_split(spark: SparkSession, path: str, column: str, held: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` is ``held``, all others, null ones too): the evaluation and training parts of one dataset."""
    mine = F.col(column).eqNullSafe(held)
    return scan(spark, path, mine, kind=kind), scan(spark, path, ~mine, kind=kind)


def write_rows(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in UTF-8, nulls left out."""
    rows.write.mode(mode).json(path)


def write_packed(rows: DataFrame, path: str, split: str = "split") -> None:
    """Packed sequences as Parquet, a folder per split."""
    rows.write.mode("overwrite").partitionBy(split).parquet(path)


def publish_packed(rows: DataFrame, path: str, split: str = "split") -> int:
    """Packed sequences as the next version of a published set, a folder per split; the version's number."""
    return publish(rows, path, by=(split,))


def read_packed(spark: SparkSession, path: str, split: str, version: int | None = None, column: str = "split") -> DataFrame:
    """Packed sequences of one split, by default of the latest version; only its folder is read."""
    return read_published(spark, path, version).filter(F.col(column) == split).drop(column)


def write_by_status(rows: DataFrame, quarantined: DataFrame, source: str, path: str) -> None:
    """Rows in folders ``status=kept`` and ``status=quarantined``; input files are never changed in place."""
    flags = quarantined.select(source, "quarantined")
    status = F.when(F.coalesce("quarantined", F.lit(False)), "quarantined").otherwise("kept")
    rows.join(flags, source, "left").withColumn("status", status).drop("quarantined").write.mode("overwrite").partitionBy("status").json(path)


def write_metrics(table: DataFrame, path: str) -> None:
    """A small table as one JSON file."""
    table.coalesce(1).write.mode("overwrite").json(path)
