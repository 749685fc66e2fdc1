"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Bytes from which on a table is worth dealing out.
SPREAD = 1 << 20


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan; one of fewer partitions than cores (a file of few large row groups) is dealt to all cores.

    Partitions are counted by planning the scan, so nothing runs here.
    """
    execution = scan._jdf.queryExecution()
    cores = scan.sparkSession.sparkContext.defaultParallelism
    few = execution.toRdd().getNumPartitions() < cores and int(str(execution.optimizedPlan().stats().sizeInBytes())) > SPREAD
    return scan.repartition(cores) if few else scan


#: Bytes of a scan for each partition that ``dealt`` makes.
DEALT = 1 << 18


def dealt(scan: DataFrame) -> DataFrame:
    """A plain scan of short rows that cost much work each, dealt to as many partitions as its size asks for; so no task grows with the table, however its files are cut."""
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(max(scan.sparkSession.sparkContext.defaultParallelism, size // DEALT)) if size > SPREAD else scan


def in_pieces(one: Callable, kind: pa.DataType, rows: int = 64) -> Callable[[pa.Array], pa.Array]:
    """``one`` over an Arrow batch, a few values at a time: only their Python objects exist at once, however long the values are. Nulls stay."""

    def run(values: pa.Array) -> pa.Array:
        parts = [pa.array([None if x is None else one(x) for x in values.slice(at, rows).to_pylist()], kind) for at in range(0, len(values), rows)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; without one, a temporary folder where everything runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp("-loomwright")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder once, so that what depends on its partitions is the same for all its readers."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it while ``df`` has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that Python workers find it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_loomwright_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp("-loomwright"), "loomwright.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._loomwright_shipped = True
