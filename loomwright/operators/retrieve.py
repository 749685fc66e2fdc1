"""Lexical tool retrieval, its prior and the gates that use it. In-row over a catalog of a few tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions import tools as T
from ..functions.text import let, lexical_tokens

# Fixed values of the gates.
GATE_STRONG, GATE_WEAK, GATE_MARGIN = 0.25, 0.08, 0.35
PRIOR_SHARPNESS, PRIOR_MOST = 4.0, 0.85


def bag(query: Column, emitted: Column) -> Column:
    """Tokens of the query and of the argument values of calls made so far (not of their names)."""
    values = F.flatten(F.transform(emitted, lambda c: F.coalesce(F.flatten(F.transform(F.map_values(C.texts(c["arguments"])), lambda v: lexical_tokens(F.coalesce(v, F.lit(""))))), F.array().cast("array<string>"))))
    return F.array_union(lexical_tokens(query), F.coalesce(values, F.array().cast("array<string>")))


def _used(emitted: Column, name: Column) -> Column:
    return F.array_contains(F.transform(emitted, lambda c: c["name"]), name)


def ranked(query: Column, tools: Column, emitted: Column) -> Column:
    """(neg, i, name) of every tool, best first: token overlap, a quarter for a name among the tokens, 1.5 less if already called; ties by place."""
    words = bag(query, emitted)

    def one(t: Column, i: Column) -> Column:
        score = F.size(F.array_intersect(words, lexical_tokens(T.text_of(t)))) + F.when(F.array_contains(words, t["name"]), 0.25).otherwise(0.0) - F.when(_used(emitted, t["name"]), 1.5).otherwise(0.0)
        return F.struct((-score).alias("neg"), i.alias("i"), t["name"].alias("name"))

    return F.array_sort(F.transform(tools, one))


def retrieve(query: Column, tools: Column, emitted: Column, k: int = 5) -> Column:
    """Names of the ``k`` best tools."""
    return F.transform(F.slice(ranked(query, tools, emitted), 1, k), lambda x: x["name"])


def prior(query: Column, tools: Column, emitted: Column) -> Column:
    """(name, score) of each tool, summing to 1: overlap, name overlap twice, less 1 if called, at least 0; uniform without any."""
    words = bag(query, emitted)

    def raw(t: Column) -> Column:
        score = F.size(F.array_intersect(words, lexical_tokens(T.text_of(t)))) + 2.0 * F.size(F.array_intersect(words, lexical_tokens(t["name"]))) - F.when(_used(emitted, t["name"]), 1.0).otherwise(0.0)
        return F.greatest(F.lit(0.0), score)

    scores = F.transform(tools, raw)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    share = lambda x: F.when(total > 0, x / total).otherwise(1.0 / F.greatest(F.lit(1), F.size(tools)))
    return F.zip_with(tools, scores, lambda t, x: F.struct(t["name"].alias("name"), share(x).alias("score")))


def first_choices(query: Column, tools: Column, n: Column) -> Column:
    """The training-free baseline's names for ``n`` calls: the best of three, then again from the five best once the called one is demoted."""
    none = F.array().cast(C.CALLS)
    plain = F.transform(ranked(query, tools, none), lambda x: F.struct(x["i"].alias("i"), x["neg"].alias("neg"), x["name"].alias("name")))
    plain = F.array_sort(plain)

    def step(picked: Column, _: Column) -> Column:
        demoted = F.array_sort(F.transform(plain, lambda x: F.struct((x["neg"] + F.when(F.array_contains(picked, x["name"]), 1.5).otherwise(0.0)).alias("key"), x["i"].alias("i"), x["neg"].alias("neg"), x["name"].alias("name"))))
        left = F.when(F.size(picked) == 0, F.transform(plain, lambda x: F.struct(x["neg"].alias("neg"), x["i"].alias("i"), x["name"].alias("name")))).otherwise(F.transform(F.slice(demoted, 1, 5), lambda x, i: F.struct(x["neg"].alias("neg"), i.alias("i"), x["name"].alias("name"))))
        best = F.try_element_at(F.array_sort(left), F.lit(1))["name"]
        return F.when(best.isNull(), picked).otherwise(F.concat(picked, F.array(best)))

    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array().cast("array<string>"), step)


def peak(scores: Column) -> Column:
    """How far the best score is from a uniform prior; at least two candidates are assumed."""
    return F.array_max(scores) - 1.0 / F.greatest(F.lit(2), F.size(scores))


def keeps_refusal(scores: Column, margin: Column) -> Column:
    """Whether a refusal stands: not against strong lexical evidence, nor, if marginal, against weak evidence. One tool is no evidence."""
    p = peak(scores)
    return ~((F.size(scores) > 1) & ((p > GATE_STRONG) | ((margin < GATE_MARGIN) & (p > GATE_WEAK))))


def prior_weight(scores: Column, confidence: Column) -> Column:
    p = F.array_max(scores) - 1.0 / F.size(scores)
    return F.least(F.lit(PRIOR_MOST), F.greatest(F.lit(0.0), PRIOR_SHARPNESS * p)) * (1.0 - confidence)


def blended(probabilities: Column, scores: Column) -> Column:
    """Probabilities mixed with the prior, which weighs more the sharper it is and the less sure the model."""
    ordered = F.sort_array(probabilities, asc=False)
    w = prior_weight(scores, ordered[0] - ordered[1])
    return F.zip_with(probabilities, scores, lambda p, s: (1.0 - w) * p + w * s)


def numeric_repair(text: Column, kind: Column) -> Column:
    """The longest prefix that is a JSON number, else 0; cut to a whole number where one is declared."""
    prefix = F.regexp_extract(text, r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", 0)
    value = F.coalesce(prefix.try_cast("double"), F.lit(0.0))
    return F.when(kind == "integer", F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("double")).otherwise(value)


def spans(query: Column, hint: Column, longest: int = 8, k: int = 24) -> Column:
    """Candidate value spans: distinct runs of up to eight words without outer punctuation, the best ``k`` by overlap with the hint and shortness; none for over 120 words."""
    w = F.filter(F.split(query, r"\s+"), lambda x: x != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(w) - i + 1)), lambda n: F.btrim(F.array_join(F.slice(w, i, n), " "), F.lit(".,;:!?\"'()[]")))))
    distinct = F.array_distinct(F.filter(runs, lambda s: s != ""))
    about = lexical_tokens(F.coalesce(hint, F.lit("")))
    score = lambda s: F.size(F.array_intersect(lexical_tokens(s), about)) * 2.0 - F.size(F.split(s, " ")) * 0.15
    best = F.transform(F.slice(F.array_sort(F.transform(distinct, lambda s, i: F.struct((-score(s)).alias("neg"), i.alias("i"), s.alias("s")))), 1, k), lambda x: x["s"])
    return F.when((F.size(w) == 0) | (F.size(w) > 120), F.lit(None).cast("array<string>")).otherwise(F.when(F.size(distinct) > k, best).otherwise(distinct))


def find_sub(hay: Column, needle: Column) -> Column:
    """First place (from 0) of a contiguous sub-array, or -1."""

    def first(x: Column) -> Column:
        n = F.size(x["needle"])
        places = F.filter(F.sequence(F.lit(1), F.size(x["hay"]) - n + 1), lambda i: F.slice(x["hay"], i, n) == x["needle"])
        return F.when((n > 0) & (F.size(x["hay"]) >= n), F.try_element_at(places, F.lit(1)) - 1)

    return F.coalesce(let(F.struct(hay.alias("hay"), needle.alias("needle")), first), F.lit(-1))


def loops(ids: Column) -> Column:
    """Whether the last k tokens equal the k before and the k before those, for k of 2 to 4."""
    n = F.size(ids)
    block = lambda k, j: F.slice(ids, n - j * k + 1, k)
    return F.exists(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda k: F.when(n >= 3 * k, (block(k, 1) == block(k, 2)) & (block(k, 2) == block(k, 3))).otherwise(F.lit(False)))
