"""One JSON array a file, read by many tasks.

Spark's text reader cuts files at commas, wherever they stand; a comma never
parts an escape. What a piece does to the state (inside a string or not, depth)
is computed for both states that it may begin in, so a block sums up to a few
numbers without what comes before it. Put together block after block, they tell
the state and the element that each block begins with, and a second pass joins
pieces to elements. Only elements that cross blocks are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

SUMMARY = "file string, block long, opens boolean, flips int, " + ", ".join(f"depth{h} long, low{h} long, at_low{h} long, above_low{h} long" for h in (0, 1))
BEGIN = "file string, block long, inside int, depth long, first long"
BLANK = " \t\r\n\ufeff"
ROWS = 10_000  #: elements of a batch


def _turn(text: Column) -> Column:
    """By how much the brackets outside strings of a text without escapes change the depth."""
    bare = F.regexp_replace(text, r'"[^"]*(?:"|\z)', "")
    return (F.length(F.translate(bare, "]}", "")) - F.length(F.translate(bare, "[{", ""))).cast("long")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of all files with what they do: ``flips`` (1 if quotes leave a piece in the other state), ``turn0`` and ``turn1`` (change of depth if it begins outside or inside a string)."""
    read = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    has = lambda c: F.contains("value", F.lit(c))
    bare = F.when(has("\\"), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    quotes = F.length(bare) - F.length(F.translate(bare, '"', ""))
    # Most pieces of texts have neither quotes nor brackets; a search of bytes tells.
    brackets = has("[") | has("]") | has("{") | has("}")
    turn = lambda text: F.when(brackets, _turn(text)).otherwise(F.lit(0).cast("long"))
    return read.withColumns({"flips": F.when(has('"'), quotes % 2).otherwise(0).cast("int"), "turn0": turn(bare), "turn1": turn(F.concat(F.lit('"'), bare))})


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], slice]]:
    """Rows of one block after another."""
    blocks, files = batch["block"].to_numpy(), batch["file"].dictionary_encode().indices.to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1).tolist(), len(blocks)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield (batch["file"][a].as_py(), int(blocks[a])), slice(a, b)


class _Side:
    """A block under one assumption about its beginning: depth after it, the lowest depth of a comma outside strings, and how many commas are there and one above."""

    def __init__(self) -> None:
        self.depth, self.low, self.at_low, self.above_low = 0, None, 0, 0

    def take(self, depths: np.ndarray, outside: np.ndarray) -> None:
        self.depth = int(depths[-1])
        commas = depths[outside]
        if not len(commas):
            return
        low = int(commas.min())
        if self.low is None or low < self.low:
            self.above_low = self.at_low if self.low == low + 1 else 0
            self.low, self.at_low = low, 0
        self.at_low += int((commas == self.low).sum())
        self.above_low += int((commas == self.low + 1).sum())

    def values(self) -> tuple[int, int, int, int]:
        return self.depth, self.low or 0, self.at_low, self.above_low


def _walk(flips: np.ndarray, turns: tuple[np.ndarray, np.ndarray], inside: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(inside, depth) after each piece."""
    after = (inside + np.cumsum(flips)) % 2
    return after, depth + np.cumsum(np.where((after - flips) % 2 == 0, *turns))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMMARY of each block; its pieces come one after another."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("opens", pa.bool_()), ("flips", pa.int32()), *((n, pa.int64()) for n in names[4:])])
    key, opens, flips, sides = None, False, 0, ()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, (*key, opens, flips, *sides[0].values(), *sides[1].values()), strict=True))], schema)

    for batch in batches:
        columns = [batch[c].to_numpy() for c in ("flips", "turn0", "turn1")]
        for found, rows in _runs(batch):
            if found != key:
                if key is not None:
                    yield row()
                key, opens, flips, sides = found, bool(batch["opens"][rows.start].as_py()), 0, (_Side(), _Side())
            f, *turns = (c[rows] for c in columns)
            for h in (0, 1):
                inside, depths = _walk(f, tuple(turns), flips ^ h, sides[h].depth)
                sides[h].take(depths, inside == 0)
            flips = (flips + int(f.sum())) % 2
    if key is not None:
        yield row()


def _begins(blocks: pd.DataFrame) -> pd.DataFrame:
    """BEGIN of the blocks of one file: the state and the number of the element that each begins with; ``first`` is -1 in a file that doesn't begin with a bracket."""
    blocks = blocks.sort_values("block")
    array = blocks["block"].iloc[0] == 0 and bool(blocks["opens"].iloc[0])
    out, inside, depth, first = [], 0, 0, 0
    for r in blocks.to_dict("records"):
        out.append((r["file"], r["block"], inside, depth, first if array else -1))
        level = depth + r[f"low{inside}"]
        first += r[f"at_low{inside}"] if level == 1 else r[f"above_low{inside}"] if level == 0 else 0
        depth += r[f"depth{inside}"]
        inside ^= r["flips"]
    return pd.DataFrame(out, columns=[c.split()[0] for c in BEGIN.split(", ")])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, row_idx, block, value, whole): elements, and parts of those that cross blocks."""
    schema = pa.schema([("file", pa.string()), ("row_idx", pa.int64()), ("block", pa.int64()), ("value", pa.string()), ("whole", pa.bool_())])
    out: list[tuple] = []
    key, held, fresh, opening, inside, depth, at = None, [], False, False, 0, 0, 0

    def give(whole: bool) -> None:
        out.append((key[0], at, key[1], ",".join(held), whole))
        held.clear()

    def full() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        columns = [batch[c].to_numpy() for c in ("flips", "turn0", "turn1")]
        for found, rows in _runs(batch):
            if found != key:
                if held:
                    give(False)
                key = found
                if batch["first"][rows.start].as_py() is None:
                    raise RuntimeError(f"{key[0]} was cut into other blocks than before: it changed, or the number of cores did")
                inside, depth, at = (batch[c][rows.start].as_py() for c in ("inside", "depth", "first"))
                opening = key[1] == 0
                fresh = opening or (inside == 0 and depth == 1)
            if at < 0 or (depth == 0 and not opening):  # no array, or behind its end
                continue
            f, *turns = (c[rows] for c in columns)
            insides, depths = _walk(f, tuple(turns), inside, depth)
            texts = batch["value"][rows.start : rows.stop].to_pylist()
            if opening:
                texts[0] = texts[0].lstrip(BLANK)[1:]
                opening = False
            ends = np.flatnonzero((insides == 0) & (depths == 0))
            if len(ends):  # the array's closing bracket
                texts = texts[: ends[0] + 1]
                texts[-1] = texts[-1].rstrip(BLANK).removesuffix("]")
            done = 0
            cuts = np.flatnonzero((insides[: len(texts)] == 0) & (depths[: len(texts)] == 1))
            for i in cuts.tolist():
                held += texts[done : i + 1]
                give(fresh)
                fresh, done, at = True, i + 1, at + 1
            held += texts[done:]
            inside, depth = int(insides[-1]), int(depths[-1])
            if len(ends):
                depth = 0
                give(fresh)
            if len(out) >= ROWS:
                yield full()
    if held:
        give(False)
    if out:
        yield full()


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_idx, value): the elements of the JSON arrays in files, one array a file, as texts without the blanks around them; ``row_idx`` counts from 0 in each file.

    Files are cut into blocks as Spark cuts texts, so one file of any size is
    read by many tasks; memory is bounded by a batch and an element. Files are
    read three times (states, elements within a block, parts of the others).
    The states, one row of five numbers for each block that the driver lists
    anyway, are broadcast. An element that isn't JSON comes as it stands; the
    last one of a torn file, too. Files that don't begin with a bracket, empty
    arrays and empty files give nothing. What follows the closing bracket is not
    read as long as it lies in the same block.
    """
    ship(spark)
    pieces = _pieces(spark, path)
    opens = pieces.withColumn("opens", F.ltrim("value", F.lit(BLANK)).startswith("[")).drop("value")
    begins = opens.mapInArrow(_summaries, SUMMARY).groupBy("file").applyInPandas(_begins, BEGIN)
    parts = pieces.join(F.broadcast(begins), ["file", "block"], "left").mapInArrow(_elements, "file string, row_idx long, block long, value string, whole boolean")
    whole = parts.filter("whole").select("file", "row_idx", "value")
    ordered = F.array_sort(F.collect_list(F.struct("block", "value")))
    crossing = parts.filter("NOT whole").groupBy("file", "row_idx").agg(F.array_join(F.transform(ordered, lambda p: p["value"]), ",").alias("value"))
    return whole.unionByName(crossing).withColumn("value", F.trim("value", F.lit(BLANK))).filter("value <> ''")


def write_arrays(rows: DataFrame, path: str, value: str = "value") -> None:
    """JSON texts of a column as arrays, one file for each partition that has rows; nulls become ``null``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for b in batches:
            lines = []
            for text in b[value].to_pylist():
                lines.append(lead + ("null" if text is None else text))
                lead = ","
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if lead == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], ["value"])

    rows.select(value).mapInArrow(run, "value string").write.text(path)
