"""Results that appear whole or not at all, in numbered versions.

Rows are staged beside the published versions and become visible by one rename
of their folder. The rename never replaces anything, so of two writers that
build on the same version one is refused. Readers see whole versions only; a
write that breaks off leaves a staged folder that nobody reads.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

STAGED = "_staged"


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to become."""


def _paths(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, ascending; none for a path that doesn't exist."""
    hadoop, files = _paths(spark, path)
    found = files.globStatus(hadoop(f"{path}/version=*")) or []
    return sorted(int(s.getPath().getName().rpartition("=")[2]) for s in found)


def publish(rows: DataFrame, path: str, base: int | None = None, by: tuple[str, ...] = ()) -> int:
    """Write ``rows`` as the version after ``base`` (by default the latest) and return its number; ``Conflict`` if that is taken."""
    spark = rows.sparkSession
    base = max(versions(spark, path), default=0) if base is None else base
    hadoop, _ = _paths(spark, path)
    staged = f"{path}/{STAGED}/{uuid.uuid4().hex}"
    rows.write.partitionBy(*by).parquet(staged)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop(staged).toUri(), spark._jsc.hadoopConfiguration()) if "://" in path else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    never_replace = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(hadoop(staged), hadoop(f"{path}/version={base + 1:08d}"), never_replace)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass()):
            raise
        context.delete(hadoop(staged), True)
        raise Conflict(f"version {base + 1} of {path} exists") from e
    return base + 1


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of one version, by default the latest; a version stays as it is while others are published."""
    found = versions(spark, path)
    if not found or version not in (None, *found):
        raise FileNotFoundError(f"no version {version or ''} of {path}")
    return spark.read.parquet(f"{path}/version={version or found[-1]:08d}")
