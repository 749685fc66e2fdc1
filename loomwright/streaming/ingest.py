"""Structured Streaming forms of ingest: append-only lines, running duplicates, spending and its cap."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import collapse
from ..operators.training import COMPLETION_PRICE, PROMPT_PRICE, running
from ..session import shared_folder
from ..sources.jsonl import mark_lines


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder to which whole files are added, blank ones left out, marked ``ok`` if they are JSON.

    A file that grows after it was read needs ``sources.growing.stream_growing``.
    """
    return mark_lines(spark.readStream.text(path))


def stream_new(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose collapsed text has not come before. State grows with the distinct texts; its key is a digest."""
    return rows.withColumn("key__", F.sha2(collapse(F.col(text)), 256)).dropDuplicates(["key__"]).drop("key__")


def stream_new_within(rows: DataFrame, text: str, time: str, delay: str) -> DataFrame:
    """The same with bounded state: repeats are only recognised within ``delay`` of event time."""
    keyed = rows.withColumn("key__", F.sha2(collapse(F.col(text)), 256)).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["key__"]).drop("key__")


def stream_spending(rows: DataFrame, account: str, prompt: str, completion: str, cap: float) -> DataFrame:
    """Running cost of each account after every micro-batch, and whether it is above the cap."""

    def add(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (cost,) = state.get if state.exists else (0.0,)
        n = 0
        for b in batches:
            cost += float((b[prompt] * PROMPT_PRICE + b[completion] * COMPLETION_PRICE).sum())
            n += len(b)
        state.update((cost,))
        yield pd.DataFrame({"account": [str(key[0])], "n": [n], "cost": [cost], "over": [cost > cap]})

    return rows.groupBy(account).applyInPandasWithState(add, "account string, n long, cost double, over boolean", "cost double", "update", GroupStateTimeout.NoTimeout)


def run_to_cap(stream: DataFrame, order: str, cost: Column, cap: int, folder: str) -> bool:
    """Process a stream until its rows have cost more than ``cap`` in all, then end the query; whether that happened.

    Rows come in the order of micro-batches, within one of ``order``; costs
    are whole and not negative, a null costs nothing. Rows up to the cap go to
    ``folder``/rows (``capped_rows`` reads them). The row that exceeds it, rows
    of the same place in the order and all later ones don't, in a restarted
    query either; null places come first. Running costs are sums over ranges of
    the order, so no task sees all rows of a micro-batch.

    ``folder``/spent holds what was spent after each micro-batch. A micro-batch
    that is run again reads the one before and replaces its own.
    """
    spark = stream.sparkSession
    schema, over = "spent long, over boolean", []

    def write(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(schema).parquet(f"{folder}/spent/{number - 1}").collect()[0] if number else None
        spent, done = (before["spent"], before["over"]) if before else (0, False)
        if not done:
            each = batch.groupBy(F.col(order).alias("at__")).agg(F.coalesce(F.sum(cost), F.lit(0)).cast("long").alias("cost__"))
            total = spent + (each.agg(F.sum("cost__")).collect()[0][0] or 0)
            if total > cap:
                sums = running(each.withColumn("all__", F.lit(0)), "all__", "at__", F.col("cost__"), F.sum, True)
                sums = sums.withColumn("sum__", F.coalesce("earlier__", F.lit(0)) + F.col("inside__") + spent)
                cut = sums.filter(F.col("sum__") > cap).agg(F.min(F.struct("at__", F.col("sum__") - F.col("cost__"))).alias("first")).collect()[0]["first"]
                at, total, done = cut[0], cut[1], True
                batch = batch.filter(F.lit(False) if at is None else F.col(order).isNull() | (F.col(order) < F.lit(at)))
            batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
            spent = total
        spark.createDataFrame([(spent, done)], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/spent/{number}")
        over.append(done)

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")  # also there if nothing comes
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        while not query.awaitTermination(1):
            if over and over[-1]:
                break
    finally:
        query.stop()
    return bool(over and over[-1])


def capped_rows(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows that ``run_to_cap`` let through to ``folder``."""
    kinds = StructType([*schema.fields, StructField("batch", LongType())])
    return spark.read.schema(kinds).parquet(f"{folder}/rows").drop("batch")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end; what each micro-batch gave, from the shared folder.

    A micro-batch that is run again replaces its own files, so every result is
    there once. ``mode`` may be ``update``, which file sinks don't take.
    """
    folder = f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/batch=-1")  # also there if nothing comes
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    kinds = StructType([*stream.schema.fields, StructField("batch", LongType())])
    return stream.sparkSession.read.schema(kinds).parquet(f"{folder}/rows").drop("batch")


def counted(rows: DataFrame, ok: Column, cost: Column, name: str = "progress") -> DataFrame:
    """``rows``, with running counts for ``Progress`` gathered as they pass; no second pass."""
    return rows.observe(name, F.count_if(ok).alias("ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("rejected"), F.coalesce(F.sum(cost.cast("double")), F.lit(0.0)).alias("spent"))


class Progress(StreamingQueryListener):
    """Running totals of streams that pass through ``counted``, and a line for every ``every`` rows more."""

    def __init__(self, every: int = 2000, name: str = "progress", say: Callable[[str], None] = print) -> None:
        self.every, self.name, self.say = every, name, say
        self.ok, self.rejected, self.spent, self.told = 0, 0, 0.0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is None:
            return
        self.ok, self.rejected, self.spent = self.ok + seen["ok"], self.rejected + seen["rejected"], self.spent + seen["spent"]
        if (self.ok + self.rejected) // self.every > self.told:
            self.told = (self.ok + self.rejected) // self.every
            self.say(self.line())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.say("final: " + self.line())

    def line(self) -> str:
        return f"{self.ok} ok / {self.rejected} rejected, ~${self.spent:.2f} spent"


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to Parquet exactly once; the checkpoint folder must be shared."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
