"""Corpus building: decontamination, duplicates, mixing, sampling and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, let, ngrams, order_key, squash, uniform, words
from ..session import checkpointed, free

GRAM = 8
TOLERATED = 0.05
#: Distinct grams up to which the evaluation side is broadcast (about 100 bytes each); beyond, both sides are shuffled.
BROADCAST_GRAMS = 200_000


def eval_grams(items: DataFrame, text: str = "text", n: int = GRAM) -> DataFrame:
    return items.select(F.explode(ngrams(words(F.col(text)), n)).alias("gram")).distinct()


def _small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` to be broadcast if it is proven small; counting stops at the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _runs(hashes: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words, of which there is one at least: those of one word are put together to two, four and so on, so that a run costs a few steps however long it is."""
    pairs = lambda k: lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - (k + 1)), lambda i: F.xxhash64(F.get(x, i), F.get(x, i + k)))
    width = 1
    while width < n:
        step = min(width, n - width)
        hashes, width = let(hashes, pairs(step)), width + step
    return hashes


def _marks(text: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words, or of the whole of a shorter text; none for a null text."""
    marks = let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= n, _runs(h, n)).otherwise(F.array(F.xxhash64(h))))
    return F.when(text.isNotNull(), marks)


def overlapping(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", n: int = GRAM) -> DataFrame:
    """Keys of the rows that share a run of ``n`` words with any item, or, having fewer words, equal a short item.

    One pass over the rows finds those that share a 64-bit mark; runs of words
    are only spelled out for them, in a second one. While they are few, their
    keys are broadcast and no text is shuffled.
    """
    wanted = items.select(F.explode(_marks(F.col(text), n)).alias("mark")).distinct()
    maybe = checkpointed(docs.select(key, F.explode(_marks(F.col(text), n)).alias("mark")).join(_small(wanted, BROADCAST_GRAMS), "mark", "left_semi").select(key).distinct())
    # An inner explode would have a filter on its array, which Spark moves below the join, so that all rows' runs would be spelled out.
    short = F.size("w") < n
    spelled = lambda rows, *keys: rows.select(*keys, short.alias("short"), F.explode_outer(F.when(short, F.array(F.array_join("w", " "))).otherwise(ngrams(F.col("w"), n))).alias("gram"))
    grams = spelled(items.filter(F.col(text).isNotNull()).select(words(F.col(text)).alias("w"))).distinct()
    w = docs.select(key, text).join(_small(maybe, BROADCAST_GRAMS), key, "left_semi").select(key, words(F.col(text)).alias("w"))
    return spelled(w, key).join(_small(grams, BROADCAST_GRAMS), ["short", "gram"], "left_semi").select(key).distinct()


def exact_firewall(docs: DataFrame, banned: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose squashed text is not in ``banned``; an empty list keeps all rows."""
    lines = banned.select(squash(F.col(text)).alias("line__")).distinct()
    return docs.withColumn("line__", squash(F.col(text))).join(lines, "line__", "left_anti").drop("line__")


def quarantine(docs: DataFrame, bad: DataFrame, key: str = "doc_id", source: str = "source", tolerated: float = TOLERATED, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Per source: rows, contaminated rows, their share, and whether the source is dropped (share above, not at, the limit)."""
    marked = docs.select(key, source).join(bad.select(key, F.lit(1).alias("hit")), key, "left")
    share = F.col("n_bad") / F.greatest(F.lit(1), "n")
    return marked.groupBy(source).agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_bad")).withColumn("share", share).withColumn("quarantined", (F.col("share") > tolerated) & ~F.col(source).isin(*exempt))


def first_wins(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the given order. One shuffle on the key; text is not part of the sort."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rn__", F.row_number().over(w)).filter("rn__ = 1").drop("rn__")


def unseen(rows: DataFrame, history: DataFrame, text: str = "text", *order: Column) -> DataFrame:
    """Rows whose collapsed text does not occur in ``history``; given an order, only the first of those with equal texts."""
    key = F.md5(collapse(F.col(text)))  # digests are shuffled, not texts
    seen = history.select(key.alias("k__")).distinct()
    new = rows.withColumn("k__", key).join(seen, "k__", "left_anti")
    return (first_wins(new, F.col("k__"), *order) if order else new).drop("k__")


def capped(rows: DataFrame, caps: dict[str, int], source: str, *order: Column) -> DataFrame:
    """At most caps[source] rows of a source, the first in order; sources without a cap keep all."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col(source)] if caps else F.lit(None)
    limited = rows.withColumn("cap__", cap)
    w = Window.partitionBy(source).orderBy(*order)
    # The largest cap is a literal, so that every task cuts its rows before the shuffle.
    some = limited.filter("cap__ IS NOT NULL").withColumn("rn__", F.row_number().over(w)).filter(F.col("rn__") <= max(caps.values(), default=0)).filter("rn__ <= cap__").drop("rn__")
    return limited.filter("cap__ IS NULL").unionByName(some).drop("cap__")


def mixed(rows: DataFrame, weights: dict[str, int], source: str = "source") -> DataFrame:
    """Every row as often as its source's weight says, with the number of the copy in ``copy`` (or ``copy_``, if there is such a column); sources without a weight are left out."""
    times = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(source)]
    return rows.withColumn("n__", times).filter("n__ > 0").withColumn(free(rows, "copy"), F.explode(F.sequence(F.lit(1), "n__"))).drop("n__")


def sampled(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows, uniform and reproducible: those first in the seeded order."""
    return rows.withColumn("o__", order_key(seed, F.col(key))).orderBy("o__", key).limit(n).drop("o__")


def weighted_sample(rows: DataFrame, n: int, key: str, weight: Column, seed: int) -> DataFrame:
    """``n`` rows without replacement, each draw in proportion to ``weight``: those whose seeded exponential times come first.

    Rows whose weight is null or not above 0 are never drawn. Each task hands
    on its first ``n`` rows only.
    """
    u = uniform(seed, F.col(key)) + 2.0**-29  # never 0
    timed = rows.withColumn("w__", weight.cast("double")).filter("w__ > 0").withColumn("o__", -F.ln(u) / F.col("w__"))
    return timed.orderBy("o__", key).limit(n).drop("o__", "w__")


def weighted_choice(seed: int, key: Column, weights: dict[str, float]) -> Column:
    """One of the names, with replacement, in proportion to its weight, by an alias table: a place and a coin from one seeded digest, whatever the number of names.

    The first 28 bits of the digest choose a place, the next 28 whether it
    keeps its own name or gives that of its alias.
    """
    names, keep, alias = alias_table(weights)
    part = lambda at: F.conv(F.substring(order_key(seed, key), at, 7), 16, 10).cast("double") / float(1 << 28)
    values = lambda xs: F.array(*[F.lit(x) for x in xs])
    place = F.floor(part(1) * len(names)).cast("int") + 1
    return let(place, lambda p: F.when(part(8) < F.element_at(values(keep), p), F.element_at(values(names), p)).otherwise(F.element_at(values(alias), p)))


def alias_table(weights: dict[str, float]) -> tuple[list[str], list[float], list[str]]:
    """(names, share of its place that a name keeps, the name that takes the rest): places of equal size whose shares add up to the weights."""
    names = [n for n, w in weights.items() if w > 0]
    if not names:
        raise ValueError("no name has a weight above 0")
    mean = sum(weights[n] for n in names) / len(names)
    left = {n: weights[n] / mean for n in names}
    keep, alias = dict.fromkeys(names, 1.0), {n: n for n in names}
    small, large = [n for n in names if left[n] < 1], [n for n in names if left[n] >= 1]
    while small and large:
        s, rich = small.pop(), large[-1]
        keep[s], alias[s] = left[s], rich
        left[rich] -= 1 - left[s]
        if left[rich] < 1:
            small.append(large.pop())
    return names, [keep[n] for n in names], [alias[n] for n in names]


def stratified(rows: DataFrame, stratum: Column, sizes: dict, key: str, seed: int) -> DataFrame:
    """``sizes[s]`` rows of each stratum ``s``, first in the seeded order; the stratum is in ``stratum`` (or ``stratum_``, if there is such a column)."""
    name = free(rows, "stratum")
    cap = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col(name)]
    w = Window.partitionBy(name).orderBy(order_key(seed, F.col(key)), key)
    return rows.withColumn(name, stratum).withColumn("rn__", F.row_number().over(w)).filter(F.col("rn__") <= max(sizes.values(), default=0)).filter(F.col("rn__") <= cap).drop("rn__")


def holdout(rows: DataFrame, n: int, key: str) -> DataFrame:
    """All rows, marked ``dev`` if among the last ``n`` by key, else ``train``. The limit value is found by a top-n, not a global sort."""
    least = rows.select(key).orderBy(F.desc(key)).limit(n).agg(F.min(key).alias("least__"))
    return rows.crossJoin(F.broadcast(least)).withColumn(free(rows, "part"), F.when(F.col(key) >= F.col("least__"), "dev").otherwise("train")).drop("least__")


def split_by_share(rows: DataFrame, key: str, seed: int, dev: float) -> DataFrame:
    """Rows marked ``dev`` or ``train`` by a seeded share, without any shuffle."""
    return rows.withColumn(free(rows, "part"), F.when(uniform(seed, F.col(key)) < dev, "dev").otherwise("train"))
