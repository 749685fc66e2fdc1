"""Scores and diagnostics of predicted calls.

Inputs hold call lists (see ``functions.calls``): ``gold`` and ``pred``, or a
pool of samples with ``row_id, sample_id, calls``, where sample 0 is the
greedy one. Everything is one aggregation, or one grouping by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions.text import let, normalized_example

# Above these shares search, assembly from a pool, and unconstrained drafts are worth building.
SEARCH_HEADROOM, COMPOSITION, PROJECTION_TAX = 0.10, 0.05, 0.02


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 for an empty bucket."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def judged(rows: DataFrame) -> DataFrame:
    """Rows with hit, name_hit, formed, filled and the number of gold calls."""
    return rows.withColumns(
        {
            "hit": C.strict_equal(F.col("pred"), F.col("gold")),
            "name_hit": C.name_equal(F.col("pred"), F.col("gold")),
            "formed": F.col("pred").isNotNull(),
            "filled": F.coalesce(F.size("pred") > 0, F.lit(False)) & F.col("pred").isNotNull(),
            "n_gold": F.size("gold"),
        }
    )


def score_table(rows: DataFrame, *by: str) -> DataFrame:
    """Accuracy, name accuracy, well-formed and non-empty shares, and accuracy of one-call, longer and refusal rows; no row for an empty input."""
    j = judged(rows)
    hit, one, more, none = F.col("hit"), F.col("n_gold") == 1, F.col("n_gold") > 1, F.col("n_gold") == 0
    n = F.count("*")
    part = lambda c: ratio(F.count_if(hit & c), F.count_if(c))
    return (
        j.groupBy(*by)
        .agg(
            n.alias("n"),
            ratio(F.count_if(hit), n).alias("accuracy"),
            ratio(F.count_if(F.col("name_hit")), n).alias("name_acc"),
            ratio(F.count_if(F.col("formed")), n).alias("well_formed"),
            ratio(F.count_if(F.col("filled")), n).alias("non_empty"),
            part(one).alias("one_call"),
            part(more).alias("two_plus"),
            part(none).alias("refuse"),
            F.count_if(one).alias("n_one"),
            F.count_if(more).alias("n_two_plus"),
            F.count_if(none).alias("n_refuse"),
        )
        .filter("n > 0")
    )


def parse_and_score(rows: DataFrame, *by: str, text: str = "pred_text") -> DataFrame:
    """Scores of rows that hold the prediction as text; text that can't be read is malformed."""
    return score_table(rows.withColumn("pred", C.loads(F.col(text))), *by)


def score_predictor(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], *by: str) -> DataFrame:
    """Scores of a predictor: ``predict`` adds ``pred`` (a call list, null if malformed) to rows with ``query``, ``tools`` and ``answers``.

    Query and answers (JSON text) are normalised first, as for training.
    """
    clean = normalized_example(rows)
    return score_table(predict(clean).withColumn("gold", C.loads(F.col("answers"))), *by)


def category_accuracy(rows: DataFrame, category: str, hit: Column, over: Column) -> DataFrame:
    """Per category: n, rows over the context, and percent right; a row over the context is a miss and stays in n."""
    ok = F.coalesce(hit, F.lit(False)) & ~F.coalesce(over, F.lit(False))
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.count_if(over).alias("over"), (100.0 * F.count_if(ok) / F.greatest(F.lit(1), F.count("*"))).alias("accuracy"))


def macro_mean(per: DataFrame, value: str) -> DataFrame:
    """Unweighted mean over categories; null ones don't count; 0 without any."""
    return per.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("macro_mean"))


def with_names_of(calls: Column, gold: Column) -> Column:
    """Calls with the gold calls' names, position by position: what is left when names are picked perfectly."""
    return F.when(F.size(calls) == F.size(gold), F.zip_with(calls, gold, lambda c, g: F.struct(g["name"].alias("name"), c["arguments"].alias("arguments")))).otherwise(calls)


def failure_table(rows: DataFrame, oracle: Column | None = None) -> DataFrame:
    """Per number of gold calls: exact, right count, right names in any order, right names in order (values compared loosely), and exact for calls made with the gold names.

    ``oracle`` holds the calls made with the gold names; by default the
    predicted ones are given these names.
    """
    gold, pred = F.col("gold"), F.col("pred")
    named = with_names_of(pred, gold) if oracle is None else oracle
    return rows.groupBy(F.size(gold).alias("n_gold")).agg(
        F.count("*").alias("n"),
        F.count_if(C.loose_equal(pred, gold)).alias("exact"),
        F.count_if(F.coalesce(F.size(pred) == F.size(gold), F.lit(False)) & pred.isNotNull()).alias("count_ok"),
        F.count_if(F.coalesce(F.array_sort(C.names(pred)) == F.array_sort(C.names(gold)), F.lit(False))).alias("multiset_ok"),
        F.count_if(C.name_equal(pred, gold)).alias("seq_ok"),
        F.count_if(C.loose_equal(named, gold)).alias("oracle_exact"),
    )


def argument_errors(rows: DataFrame, oracle: Column | None = None) -> DataFrame:
    """Calls under the gold names, paired by position, that differ from the gold ones, by kind.

    ``key_set``: other keys, and the same again by how many are missing and
    extra; ``values_only``: the same keys; ``bad_value``: the number of values
    that differ in the latter. A wrong name alone is no argument error.
    ``oracle`` holds the calls made with the gold names; by default the
    predicted ones are given these names.
    """
    gold = F.col("gold")
    named = with_names_of(F.col("pred"), gold) if oracle is None else oracle
    pairs = rows.select(F.explode(F.arrays_zip(C.loose(gold).alias("g"), C.loose(named).alias("p"))).alias("x")).select("x.*").filter("g IS NOT NULL AND p IS NOT NULL AND g <> p")
    keys = lambda c: F.transform(F.col(c)["entries"], lambda e: e["k"])
    missing, extra = F.size(F.array_except(keys("g"), keys("p"))), F.size(F.array_except(keys("p"), keys("g")))
    bad = F.size(F.filter(F.zip_with(F.col("g")["entries"], F.col("p")["entries"], lambda a, b: a != b), lambda x: x))
    kind = lambda name, n: F.struct(name.alias("kind"), n.cast("long").alias("n"))
    one = F.lit(1)
    sets = F.array(kind(F.lit("key_set"), one), kind(F.concat(F.lit("missing="), missing, F.lit(" extra="), extra), one))
    values = F.array(kind(F.lit("values_only"), one), kind(F.lit("bad_value"), bad))
    # With names that differ, too (where the numbers of calls do), equal arguments count nowhere.
    kinds = F.when(keys("g") != keys("p"), sets).when(F.col("g")["entries"] != F.col("p")["entries"], values)
    return pairs.select(F.explode(kinds).alias("x")).groupBy("x.kind").agg(F.sum("x.n").alias("n"))


def pass_at_k(pool: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """For j up to ``k``: rows right within samples 0..j, their share, the headroom over the greedy sample, and whether that is enough for search to pay (``search_helps``)."""
    # Both sides are reduced once, before the join, in which gold meets every sample.
    right = gold.select("row_id", C.loose(F.col("gold")).alias("right__"))
    given = pool.select("row_id", "sample_id", C.loose(F.col("calls")).alias("given__"))
    hits = given.join(right, "row_id").groupBy("row_id").agg(F.min(F.when(F.col("given__") == F.col("right__"), F.col("sample_id"))).alias("first"))
    per = hits.agg(F.count("*").alias("n"), *[F.count_if(F.col("first") <= j).alias(f"j{j}") for j in range(k + 1)])
    curve = per.select("n", "j0", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"j{j}").alias("hits")) for j in range(k + 1)])).alias("x"))
    share = ratio(F.col("hits"), F.col("n"))
    headroom = share - ratio(F.col("j0"), F.col("n"))
    return curve.select(F.col("x.j").alias("j"), F.col("x.hits").alias("hits"), "n", "j0").select("j", "hits", share.alias("share"), headroom.alias("headroom"), (headroom > SEARCH_HEADROOM).alias("search_helps"))


def agreement(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Two decoders on the same rows: both, either, only one right; what ``a`` fixes and breaks of ``b``; change of accuracy, and whether ``b`` costs enough for ``a`` to be worth building (``drafts_pay``)."""
    delta = ratio(F.count_if(a) - F.count_if(b), F.count("*"))
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(a & b).alias("both"),
        F.count_if(a | b).alias("either"),
        F.count_if(a & ~b).alias("fixed"),
        F.count_if(~a & b).alias("broke"),
        delta.alias("delta"),
        (delta > PROJECTION_TAX).alias("drafts_pay"),
    )


def _calls_of(pool: DataFrame, calls: str, *keep: str) -> DataFrame:
    return pool.select(*keep, F.posexplode(C.loose(F.col(calls))).alias("pos", "call")).select(*keep, "pos", F.col("call.name").alias("name"), F.col("call.entries").alias("entries"))


def field_oracle(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """Per gold call: greedy right; and name, key set, every field available anywhere in the pool at its position; assembled if all three are.

    Only samples with the right name supply keys and fields.
    """
    want = _calls_of(gold, "gold", "row_id").select("row_id", "pos", F.struct("name", "entries").alias("g"))
    have = _calls_of(pool, "calls", "row_id", "sample_id").select("row_id", "pos", "sample_id", F.col("name"), "entries")
    keys = lambda c: F.transform(c, lambda e: e["k"])
    both = want.join(have, ["row_id", "pos"], "left")
    named = F.coalesce(F.col("name") == F.col("g.name"), F.lit(False))
    got = both.groupBy("row_id", "pos").agg(
        F.first("g").alias("g"),
        F.coalesce(F.bool_or((F.col("sample_id") == 0) & named & (F.col("entries") == F.col("g.entries"))), F.lit(False)).alias("greedy"),
        F.bool_or(named).alias("name_avail"),
        F.bool_or(named & (keys(F.col("entries")) == keys(F.col("g.entries")))).alias("keyset_avail"),
        F.flatten(F.collect_set(F.when(named, F.col("entries")))).alias("fields"),
    )
    fields = F.size(F.array_except(F.col("g.entries"), F.col("fields"))) == 0
    out = got.select("row_id", "pos", "greedy", "name_avail", F.coalesce("keyset_avail", F.lit(False)).alias("keyset_avail"), fields.alias("fields_avail"))
    return out.withColumn("assembled", F.expr("name_avail AND keyset_avail AND fields_avail"))


def field_summary(per_call: DataFrame) -> DataFrame:
    """Counts over calls, and rows (with calls) that could be assembled whole."""
    rows = per_call.groupBy("row_id").agg(F.bool_and("assembled").alias("assembled_row"), F.count("*").alias("calls"), *[F.count_if(F.col(c)).alias(c) for c in ("greedy", "name_avail", "keyset_avail", "fields_avail", "assembled")])
    return rows.agg(F.count("*").alias("n_rows"), F.sum("calls").alias("n_calls"), *[F.sum(c).alias(c) for c in ("greedy", "name_avail", "keyset_avail", "fields_avail", "assembled")], F.count_if(F.col("assembled_row")).alias("assembled_rows"))


def composes(summary: DataFrame, whole: str) -> DataFrame:
    """A ``field_summary`` with the gain of rows assembled from a pool over rows some sample has whole (``whole``), and whether re-ranking pays."""
    gain = ratio(F.col("assembled_rows") - F.col(whole), F.col("n_rows"))
    return summary.withColumn("gain", gain).withColumn("rerank_pays", gain > COMPOSITION)


def _modal(values: Column) -> Column:
    """(value, n) of the commonest value; the first seen of equally common ones."""

    def of(vs: Column) -> Column:
        counted = F.transform(F.array_distinct(vs), lambda v, i: F.struct((-F.size(F.filter(vs, lambda x: x == v))).alias("n"), i.alias("i"), v.alias("v")))
        return F.try_element_at(F.array_sort(counted), F.lit(1))

    return let(values, of)


def rerank(pool: DataFrame) -> DataFrame:
    """row_id, pos, name and entries of the greedy calls after re-ranking by the pool.

    Candidates are the samples with the same name at the same position. The
    greedy key set gives way only to one that a strict majority of them has;
    greedy values stay, new keys take the commonest value. Ties go to the
    sample seen first.
    """
    calls = pool.select("row_id", "sample_id", F.posexplode(C.canonical(F.col("calls"))).alias("pos", "call")).select("row_id", "pos", "sample_id", F.col("call.name").alias("name"), F.col("call.entries").alias("entries"))
    grouped = calls.groupBy("row_id", "pos", "name").agg(F.array_sort(F.collect_list(F.struct("sample_id", "entries"))).alias("xs")).filter(F.col("xs")[0]["sample_id"] == 0)
    both = grouped.select("row_id", "pos", "name", F.col("xs")[0]["entries"].alias("greedy"), F.transform("xs", lambda x: x["entries"]).alias("cands"))
    keys = lambda c: F.transform(c, lambda e: e["k"])
    both = both.withColumn("top", _modal(F.transform("cands", keys)))
    chosen = F.when((F.col("top.v") != keys(F.col("greedy"))) & (-2 * F.col("top.n") > F.size("cands")), F.col("top.v")).otherwise(keys(F.col("greedy")))
    both = both.withColumn("chosen", chosen)
    own = lambda k: F.filter("greedy", lambda e: e["k"] == k)
    offered = lambda k: F.flatten(F.transform("cands", lambda c: F.filter(c, lambda e: e["k"] == k)))
    value = lambda k: let(own(k), lambda o: F.when(F.size(o) > 0, F.try_element_at(o, F.lit(1))).otherwise(_modal(offered(k))["v"]))
    return both.select("row_id", "pos", "name", F.transform("chosen", value).alias("entries"))


def reward(pred: Column, gold: Column) -> Column:
    """Share of gold calls matched by position, less 0.1 for each call too many; 1 or 0 where nothing should be called."""
    both = F.struct(C.loose(gold).alias("g"), C.loose(pred).alias("p"))
    return let(both, lambda x: loose_reward(x["p"], x["g"]))


def loose_reward(pred: Column, gold: Column) -> Column:
    """``reward`` of calls in loose form, which are named often here and so should be columns."""
    g, p = gold, F.coalesce(pred, F.array())
    pairs = F.zip_with(g, p, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    matched = F.aggregate(F.slice(pairs, F.lit(1), F.size(g)), F.lit(0), lambda acc, x: acc + x)
    over = F.greatest(F.lit(0), F.size(p) - F.size(g))
    return F.when(F.size(g) == 0, F.when(F.size(p) == 0, 1.0).otherwise(0.0)).otherwise(matched / F.size(g) - 0.1 * over)


def leave_one_out(rewards: DataFrame, row: str = "row_id", value: str = "reward") -> DataFrame:
    """Each sample's advantage over the mean of the others; rows whose rewards hardly differ, or with one sample, are left out."""
    w = Window.partitionBy(row)
    n, total = F.count("*").over(w), F.sum(value).over(w)
    spread = F.max(value).over(w) - F.min(value).over(w)
    out = rewards.withColumns({"n__": n, "total__": total, "spread__": spread}).filter("n__ > 1 AND spread__ >= 1e-6")
    return out.withColumn("advantage", F.col(value) - (F.col("total__") - F.col(value)) / (F.col("n__") - 1)).drop("n__", "total__", "spread__")


NO_CALL = ("irrelevance", "live_irrelevance")
ANY_CALL = ("live_relevance",)
# The benchmark's single-turn categories.
CATEGORIES = (
    "simple_python", "simple_java", "simple_javascript", "multiple", "parallel", "parallel_multiple", "irrelevance",
    "live_simple", "live_multiple", "live_parallel", "live_parallel_multiple", "live_relevance", "live_irrelevance",
)


def accepted(truth: Column) -> Column:
    """Ground truth ``[{function: {parameter: [acceptable, ...]}}]`` as an array of (name, parameters: k -> loose values)."""
    calls = F.from_json(truth, "array<map<string,string>>")
    value = lambda t: F.when(t.rlike(r"^\s*\["), t).otherwise(F.concat(F.lit("["), t, F.lit("]")))
    # Wrapped as an object with number keys, so that each value goes through the same tagging as arguments do.
    listed = lambda t: C.entries(F.concat(F.lit("{"), F.array_join(F.transform(F.from_json(value(t), "array<variant>"), lambda v, i: F.concat(F.lit('"'), F.lpad(i.cast("string"), 6, "0"), F.lit('":'), F.coalesce(F.to_json(v), F.lit("null")))), ","), F.lit("}")))
    options = lambda t: F.transform(listed(t), lambda e: F.struct(C.loose_value(e).alias("v"), F.when(e["tag"] == "STRING", F.trim(e["text"])).alias("s")))
    params = lambda text: F.transform(F.map_entries(F.coalesce(C.texts(text), F.create_map().cast("map<string,string>"))), lambda kv: F.struct(kv["key"].alias("k"), options(kv["value"]).alias("options")))
    return F.transform(calls, lambda m: F.struct(F.try_element_at(F.map_keys(m), F.lit(1)).alias("name"), params(F.try_element_at(F.map_values(m), F.lit(1))).alias("params")))


def call_accepted(call: Column, truth: Column) -> Column:
    """Same name, every parameter acceptable or optional and absent, no other argument."""
    read = lambda e: F.struct(e["k"].alias("k"), C.loose_value(e).alias("v"), F.when(e["tag"] == "STRING", F.trim(e["text"])).alias("s"))
    args = F.transform(F.coalesce(C.listed(call["arguments"]), F.array().cast(C.ENTRIES)), read)
    return let(args, lambda given: _given_accepted(call["name"], given, truth))


def _given_accepted(name: Column, args: Column, truth: Column) -> Column:
    optional = lambda p: F.exists(p["options"], lambda o: F.coalesce(o["s"] == "", F.lit(False)) & (o["v"] == "s:"))
    right = lambda e, p: F.exists(p["options"], lambda o: (e["v"] == o["v"]) | F.coalesce(e["s"] == o["s"], F.lit(False)))
    given = lambda p: F.filter(args, lambda e: e["k"] == p["k"])
    each = F.forall(truth["params"], lambda p: let(given(p), lambda own: F.when(F.size(own) == 0, optional(p)).otherwise(F.exists(own, lambda e: right(e, p)))))
    known = F.forall(args, lambda e: F.exists(truth["params"], lambda p: p["k"] == e["k"]))
    return F.coalesce((name == truth["name"]) & each & known, F.lit(False))


def row_accepted(category: Column, pred: Column, truth: Column) -> Column:
    """Refusals and any-call categories by emptiness; others need as many calls as the truth, acceptable in order. Malformed text is an empty list here."""
    p = F.coalesce(pred, F.array().cast(C.CALLS))
    each = lambda x: F.forall(F.zip_with(x["p"], x["t"], lambda a, b: call_accepted(a, b)), lambda ok: ok)
    ordered = let(F.struct(p.alias("p"), accepted(truth).alias("t")), lambda x: (F.size(x["p"]) == F.size(x["t"])) & each(x))
    return F.when(category.isin(*NO_CALL), F.size(p) == 0).when(category.isin(*ANY_CALL), F.size(p) > 0).otherwise(F.coalesce(ordered, F.lit(False)))


def representative(truth: Column) -> Column:
    """A gold call list: each parameter's first acceptable value, left out where that is "" and others exist."""
    calls = F.from_json(truth, "array<map<string,string>>")
    first = lambda t: F.when(t.rlike(r"^\s*\["), F.get_json_object(t, "$[0]")).otherwise(t)
    skip = lambda t: F.coalesce((F.get_json_object(t, "$[0]") == "") & F.get_json_object(t, "$[1]").isNotNull(), F.lit(False))
    def params(text: Column) -> Column:
        return F.map_from_entries(F.transform(F.filter(F.map_entries(C.texts(text)), lambda kv: ~skip(kv["value"])), lambda kv: F.struct(kv["key"], first(kv["value"]))))
    return F.transform(calls, lambda m: F.struct(F.map_keys(m)[0].alias("name"), params(F.map_values(m)[0]).alias("arguments")))
