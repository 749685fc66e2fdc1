"""Data-shaped parts of training: batches, schedules, folds and running statistics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

ROUND, MOST_ROWS = 64, 128
#: Rows that one task numbers, about.
CHUNK = 1_000_000


def _ranged(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``part__``: runs of the order by group and key of about CHUNK rows, so a large group is cut by its own keys.

    Rows with equal group and key are in one run; nulls are groups and keys
    like others and come first. Runs are found by sampling, so they are
    written once for all who read them.
    """
    ranges = 1 + rows.count() // CHUNK
    if ranges == 1:
        return rows.withColumn("part__", F.lit(0))
    return checkpointed(rows.repartitionByRange(ranges, group, key).withColumn("part__", F.spark_partition_id()))


def _with_earlier(rows: DataFrame, group: str, each: Column, over: Callable, name: str) -> DataFrame:
    """``name``: ``over`` of ``each``, an aggregate of every earlier run of a row's group; NULL in its first."""
    earlier = Window.partitionBy("group__").orderBy("run__").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col(group).alias("group__"), F.col("part__").alias("run__")).agg(each.alias("t__")).select("group__", "run__", over("t__").over(earlier).alias(name))
    return rows.join(totals, F.col(group).eqNullSafe(F.col("group__")) & (F.col("part__") == F.col("run__"))).drop("group__", "run__")


def numbered(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``rank__``: place of each row in its group by ``key``, from 0; null groups and keys too.

    No task numbers more than a run of a group; runs are counted first and
    their sizes added up.
    """
    r = _with_earlier(_ranged(rows, group, key), group, F.count("*"), F.sum, "before__")
    inner = Window.partitionBy(group, "part__").orderBy(key)
    return r.withColumn("rank__", F.coalesce("before__", F.lit(0)) + F.row_number().over(inner) - 1).drop("part__", "before__")


def running(rows: DataFrame, group: str, key: str, value: Column, how: Callable, own: bool) -> DataFrame:
    """``earlier__`` and ``inside__``: ``how`` (a sum or minimum) of the values in earlier runs of the group, and in the row's own run up to the row, with it if ``own``."""
    r = _with_earlier(_ranged(rows.withColumn("value__", value), group, key), group, how("value__"), how, "earlier__")
    inside = how("value__").over(Window.partitionBy(group, "part__").orderBy(key).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    return r.withColumn("inside__", inside).drop("part__", "value__")


def batch_runs(counts: dict[int, int], length: int, budget: int) -> np.ndarray:
    """(first place, first batch, batch size) of runs of equal batches, for rows sorted by real length: a batch closes where one more row would exceed the token budget, or at 128 rows.

    Batches of one real length are taken all at once, so there are a few runs
    for each length, however many rows.
    """
    runs, held, widest, at, batch = [], 0, 0, 0, 0
    for real in sorted(counts):
        padded, left = min(length, -(-real // ROUND) * ROUND), counts[real]
        if held and left:
            room = min(MOST_ROWS, budget // max(widest, padded)) - held
            take = max(0, min(left, room))
            if take:
                runs.append((at, batch, MOST_ROWS))
                held, widest, at, left = held + take, max(widest, padded), at + take, left - take
            if left:
                batch, held, widest = batch + 1, 0, 0
        if left:
            size = max(1, min(MOST_ROWS, budget // max(1, padded)))
            runs.append((at, batch, size))
            full, held = divmod(left, size)
            at, batch, widest = at + left, batch + full, padded
    return np.array(runs or [(0, 0, 1)], np.int64)


def token_budget_batches(rows: DataFrame, key: str, real: str, length: int, budget: int) -> DataFrame:
    """``batch`` and place in the sorted order of every row; only the number of rows per length (at most ``length``) is collected. A null length counts as 0."""
    own = F.coalesce(F.col(real), F.lit(0))
    counts = {r["real__"]: r["n"] for r in rows.groupBy(own.alias("real__")).agg(F.count("*").alias("n")).collect()}
    starts, first, sizes = batch_runs(counts, length, budget).T
    lengths = sorted(counts)
    begin = dict(zip(lengths, np.concatenate(([0], np.cumsum([counts[s] for s in lengths])))[:-1].tolist(), strict=True)) if lengths else {}
    base = F.create_map(*[F.lit(x) for kv in begin.items() for x in kv])[own] if begin else F.lit(0)
    placed = numbered(rows.withColumn("real__", own), "real__", key).withColumn("place", (base + F.col("rank__")).cast("long")).drop("rank__", "real__")

    def batch_of(s: pd.Series) -> pd.Series:
        run = np.searchsorted(starts, s.to_numpy(), "right") - 1
        return pd.Series(first[run] + (s.to_numpy() - starts[run]) // sizes[run])

    return placed.withColumn("batch", F.pandas_udf(batch_of, "long")("place"))


def rate_factor(step: Column, total: int, warmup: int | None = None) -> Column:
    """Learning-rate factor: linear warm-up, flat until four fifths, then linear down to a floor of 0.05."""
    warm = max(10, total // 20) if warmup is None else warmup
    done = step / F.lit(total)
    return F.least(F.lit(1.0), (step + 1) / F.lit(warm)) * F.when(done < 0.8, 1.0).otherwise(F.greatest(F.lit(0.05), (1 - done) / 0.2))


def moving_average(rows: DataFrame, series: str, step: str, value: str, beta: float = 0.999) -> DataFrame:
    """Exponential moving average of each series after its last step; it starts at the first value.

    As a sum of values times the weight that their place leaves them, so no
    task holds a series.
    """
    sizes = rows.groupBy(F.col(series).alias("series__")).agg(F.count("*").alias("size__"))
    placed = numbered(rows, series, step).join(sizes, F.col(series).eqNullSafe(F.col("series__"))).drop("series__")
    later = F.pow(F.lit(beta), F.col("size__") - 1 - F.col("rank__"))
    weight = F.when(F.col("rank__") == 0, later).otherwise((1 - beta) * later)
    return placed.groupBy(series).agg(F.sum(F.col(value) * weight).alias("ema"))


def moving_averages(rows: DataFrame, series: str, step: str, value: str, beta: float = 0.999) -> DataFrame:
    """``ema``: the moving average of a row's series after its step; it starts at the first value.

    A run of steps turns the average before it into one after it by a factor
    and a summand, so runs are looked at by themselves, their maps are put
    together in order (one row for each run of a series), and each run then
    starts from its own average. Null and NaN values leave the average as it is;
    null series and steps are like others, null steps first. Steps that occur
    twice are taken in the order of their values.
    """
    runs = checkpointed(_ranged(rows, series, step))
    names = [f"{c}__at" for c in runs.columns]
    kept = runs.toDF(*names)
    group, part, at, v = f"{series}__at", "part____at", f"{step}__at", f"{value}__at"

    def ordered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows in order, and their values, NaN for null."""
        places = pc.sort_indices(t, sort_keys=[(at, "ascending"), (v, "ascending")], null_placement="at_start").to_numpy()
        return places, t[v].cast(pa.float64()).to_numpy()[places]

    def whole(t: pa.Table) -> pa.Table:
        x = ordered(t)[1]
        x = x[~np.isnan(x)]
        weight = (1 - beta) * beta ** np.arange(len(x) - 1, -1, -1.0)
        numbers = {"factor__": float(beta ** len(x)), "add__": float(x @ weight), "first__": float(x[0]) if len(x) else None}
        return pa.table({"group__": t[group].slice(0, 1), "run__": t[part].slice(0, 1), **{k: pa.array([n], pa.float64()) for k, n in numbers.items()}})

    kind = rows.schema[series].dataType.simpleString()
    maps = kept.groupBy(group, part).applyInArrow(whole, f"group__ {kind}, run__ int, factor__ double, add__ double, first__ double")

    def starts(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("run__")
        known = b["first__"].dropna()
        average, out = (known.iloc[0] if len(known) else None), []
        for factor, add in zip(b["factor__"], b["add__"], strict=True):
            out.append(average)
            average = None if average is None else factor * average + add
        return pd.DataFrame({"group__": b["group__"], "run__": b["run__"], "start__": pd.Series(out, b.index, "float64")})

    begun = maps.groupBy("group__").applyInPandas(starts, f"group__ {kind}, run__ int, start__ double")

    def along(t: pa.Table) -> pa.Table:
        places, x = ordered(t)
        average, seen = t["start__"][0].as_py(), t["seen__"][0].as_py()
        out: list[float | None] = [None] * len(x)
        for place, value in zip(places.tolist(), x.tolist(), strict=True):
            if value == value:
                average, seen = beta * average + (1 - beta) * value, True
            out[place] = average if seen else None
        return t.select(names).append_column("ema", pa.array(out, pa.float64()))

    # Before the first value of a series there is no average yet.
    order = Window.partitionBy("group__").orderBy("run__").rowsBetween(Window.unboundedPreceding, -1)
    seen = maps.select("group__", "run__", F.coalesce(F.max(F.col("first__").isNotNull()).over(order), F.lit(False)).alias("seen__"))
    begun = begun.join(seen.withColumnRenamed("group__", "g__"), F.col("group__").eqNullSafe(F.col("g__")) & (begun["run__"] == seen["run__"])).select("group__", begun["run__"], "start__", "seen__")
    both = kept.join(begun, F.col(group).eqNullSafe(F.col("group__")) & (F.col(part) == F.col("run__")))
    out = both.groupBy(group, part).applyInArrow(along, kept.withColumn("ema", F.lit(None).cast("double")).schema)
    return out.drop(part).toDF(*rows.columns, "ema")


def best_so_far(rows: DataFrame, series: str, step: str, loss: str) -> DataFrame:
    """Whether a loss is below all earlier ones of its series."""
    before = F.least("earlier__", "inside__")
    return running(rows, series, step, F.col(loss), F.min, False).withColumn("new_best", before.isNull() | (F.col(loss) < before)).drop("earlier__", "inside__")


def best_candidate(rows: DataFrame, name: str, loss: str) -> DataFrame:
    """The candidate with the least loss; of equal ones the first by name."""
    return rows.agg(F.min(F.struct(loss, name)).alias("x")).select(F.col(f"x.{name}").alias(name), F.col(f"x.{loss}").alias(loss))


def soup(rows: DataFrame, weights: str) -> DataFrame:
    """Mean of several weight vectors, place by place; no rows for fewer than two."""
    n = rows.agg(F.count("*").alias("n__"))
    each = rows.select(F.posexplode(weights).alias("place", "w")).groupBy("place").agg(F.avg("w").alias("w"))
    return each.crossJoin(F.broadcast(n)).filter("n__ > 1").drop("n__")


def weighted_loss(rows: DataFrame, by: str, loss: Column, weight: Column) -> DataFrame:
    """Sum of loss times weight over the sum of weights, which counts as 1 at least."""
    return rows.groupBy(by).agg((F.sum(loss * weight) / F.greatest(F.lit(1.0), F.sum(weight))).alias("loss"))


# Dollars per prompt and completion token.
PROMPT_PRICE, COMPLETION_PRICE = 0.14e-6, 0.28e-6


def spending(rows: DataFrame, account: str, order: str, prompt: str, completion: str, cap: float) -> DataFrame:
    """Running cost per account, and whether it is above the cap (work stops there)."""
    each = F.col(prompt) * PROMPT_PRICE + F.col(completion) * COMPLETION_PRICE
    cost = F.coalesce("earlier__", F.lit(0.0)) + F.coalesce("inside__", F.lit(0.0))
    return running(rows, account, order, each, F.sum, True).withColumn("cost", cost).withColumn("over", F.col("cost") > cap).drop("earlier__", "inside__")
