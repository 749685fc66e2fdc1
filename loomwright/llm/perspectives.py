"""Perspective rotation of multi-party dialogues (operator 8).

For every participant, the dialogue is rendered with that participant as the
assistant and the others as named users; masks cover what the assistant says.
A dialogue is rendered in blocks of ``BLOCK`` turns; ``start`` says where a
block begins in the rendering of the whole.

A dialogue of at most ``LONG`` turns is handled in one task, after one shuffle
by dialogue. No task holds a whole longer one: its turns are cut into ranges
of their global order and get their places from the sizes of the ranges
before; the blocks, not the turns, meet the participants; and starts come from
sums of lengths in two steps, within and over runs of ``RUN`` blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK, RUN = 64, 4096
LONG = 4096
#: Long dialogues up to which their ids are broadcast (8 bytes each).
BROADCAST = 100_000
SYSTEM, NOBODY, END = "system", "unknown", "<|end|>\n"


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("text")]


def _blocks(placed: DataFrame) -> DataFrame:
    """(conv_id, block, xs): the turns of each block, in order."""
    turn = F.struct("place", "speaker", "text")
    return placed.withColumn("block", F.expr(f"place div {BLOCK}")).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(turn)).alias("xs"))


def _short(clean: DataFrame) -> DataFrame:
    """Blocks with their perspectives and starts, of dialogues that fit a task each."""
    rows = clean.repartition("conv_id").distinct()
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*_order())).cast("long") - 1
    blocks = _blocks(rows.withColumn("place", place))
    speakers = F.filter(F.transform("xs", lambda x: x["speaker"]), lambda s: s != SYSTEM)
    people = F.array_distinct(F.flatten(F.collect_list(F.array_distinct(speakers)).over(Window.partitionBy("conv_id"))))
    shown = blocks.withColumn("people", people).select("conv_id", "block", "xs", F.explode("people").alias("perspective"))
    return shown.withColumn("start", _before(["conv_id", "perspective"], "block", _size()))


def _long(clean: DataFrame) -> DataFrame:
    """The same of dialogues of any length."""
    order = [F.col("conv_id"), *_order()]
    # Equal turns lie in one range. Written, so that ranges and row numbers stay as they are when a task is lost.
    ranged = cut(clean.repartitionByRange(*order).distinct().sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    base = sizes.select("conv_id", "range", (_before(["conv_id"], "range", F.col("n")) - F.col("first")).alias("base"))
    blocks = cut(_blocks(ranged.join(base, ["conv_id", "range"]).select("conv_id", "speaker", "text", (F.col("at") + F.col("base")).alias("place"))))
    people = cut(ranged.filter(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct())
    shown = blocks.join(people, "conv_id").withColumn("run", F.expr(f"block div {RUN}"))
    keys = ["conv_id", "perspective"]
    lengths = shown.select(*keys, "run", "block", _size().alias("size"))
    runs = lengths.groupBy(*keys, "run").agg(F.sum("size").alias("size")).select(*keys, "run", _before(keys, "run", F.col("size")).alias("base"))
    inside = lengths.withColumn("inside", _before([*keys, "run"], "block", F.col("size")))
    starts = inside.join(runs, [*keys, "run"]).select(*keys, "block", (F.col("inside") + F.col("base")).alias("start"))
    return shown.join(starts, [*keys, "block"]).select("conv_id", "block", "xs", "perspective", "start")


def _before(keys: list[str], by: str, value: Column) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def _head(x: Column) -> Column:
    return F.when(x["speaker"] == F.col("perspective"), F.lit("<|assistant|>\n")).when(x["speaker"] == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user|>"), x["speaker"], F.lit("\n")))


def _size() -> Column:
    """Code points of a block's rendering."""
    return F.aggregate("xs", F.lit(0).cast("long"), lambda n, x: n + F.length(_head(x)) + F.length(x["text"]) + len(END))


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, block, n_turns, start, rendered, masks.

    ``masks`` lists begin-end of the assistant's words and end marks in
    ``rendered`` (code points, end exclusive). Turns go by number, then
    speaker, then text, and ``BLOCK`` of them make a block, whatever their
    numbers are; a null number comes last; a null or empty role is
    ``unknown``; a null text is empty. A repeated row is one turn. System turns
    are shown to everyone and take no perspective, so a dialogue of system
    turns only has no rows. Rows without conv_id take no part. An empty table
    gives no rows.
    """
    role = F.coalesce(F.nullif(F.col("role").cast("string"), F.lit("")), F.lit(NOBODY))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("speaker"), text.alias("text"))
    long = cut(clean.groupBy("conv_id").count().filter(F.col("count") > LONG).select("conv_id"))
    n = long.count()
    if n:
        ids = F.broadcast(long) if n <= BROADCAST else long
        shown = _short(clean.join(ids, "conv_id", "left_anti")).select("conv_id", "block", "xs", "perspective", "start").unionByName(_long(clean.join(ids, "conv_id", "left_semi")))
    else:
        shown = _short(clean)

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(_head(x))
        end = begin + F.length(x["text"]) + len(END)
        return F.struct(end.alias("at"), F.when(x["speaker"] == F.col("perspective"), F.concat(acc["out"], F.array(F.concat_ws("-", begin, end)))).otherwise(acc["out"]).alias("out"))

    rendered = F.array_join(F.transform("xs", lambda x: F.concat(_head(x), x["text"], F.lit(END))), "")
    masks = F.array_join(F.aggregate("xs", empty, add, lambda acc: acc["out"]), ",")
    return shown.select("conv_id", "perspective", "block", F.size("xs").cast("long").alias("n_turns"), "start", rendered.alias("rendered"), masks.alias("masks"))


ORACLE = f"""WITH clean AS (SELECT DISTINCT conv_id, turn, coalesce(nullif(role, ''), '{NOBODY}') AS speaker, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, text) - 1 AS place FROM clean),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM clean WHERE speaker <> '{SYSTEM}'),
shown AS (SELECT conv_id, perspective, place, place // {BLOCK} AS block, speaker = perspective AS own,
  CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = '{SYSTEM}' THEN '<|system|>' ELSE '<|user|>' || speaker END || chr(10) AS head, text || '<|end|>' || chr(10) AS said FROM placed JOIN people USING (conv_id)),
summed AS (SELECT *, sum(length(head) + length(said)) OVER (PARTITION BY conv_id, perspective, block ORDER BY place) AS ends FROM shown),
blocks AS (SELECT conv_id, perspective, block, count(*) AS n_turns, string_agg(head || said, '' ORDER BY place) AS rendered,
  coalesce(string_agg(concat(ends - length(said), '-', ends), ',' ORDER BY place) FILTER (own), '') AS masks FROM summed GROUP BY ALL)
SELECT conv_id, perspective, block, n_turns, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, rendered, masks FROM blocks"""
