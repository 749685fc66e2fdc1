"""Examples generated for the rows of a table, and augmented ones; the SQL draws from the same digests on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generate as G
from ..registry import query
from .corpus import table

SEED, GIVEN = 3, {"handle": "c_name", "title": "c_mktsegment"}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]"


def _drawn(salt: int, key: str = "k", seed: int = SEED) -> str:
    """A number in [0, 1)."""
    return f"(CAST('0x' || substr(md5(concat('{seed + salt}|', {key})), 1, 7) AS BIGINT) / 268435456.0)"


def _one(some: str, salt: int, seed: int = SEED) -> str:
    return f"({some})[CAST(floor({_drawn(salt, seed=seed)} * len({some})) AS INTEGER) + 1]"


def _filled(template: str, salt: int, arguments: bool) -> str:
    for i, (slot, values) in enumerate(G.SLOTS.items()):
        value = GIVEN.get(slot) or _one(_list(values), salt + 3 + i)
        if slot in GIVEN and arguments:
            value = f"trim(CAST(to_json({value}) AS VARCHAR), '\"')"
        template = f"replace({template}, '{{{slot}}}', {value})"
    return template


def examples_sql(ood: bool) -> str:
    """A chain of common tables that ends with ``examples``: k, row, query, kind, answers and tools (lists of texts)."""
    form = lambda t, qs, a: f"{{'tool': {_text(t)}, 'queries': {_list(qs)}, 'arguments': {_text(a)}}}"
    makers = "[" + ", ".join("[" + ", ".join(form(*f) for f in m) + "]" for m in (G.OOD_MAKERS if ood else []) + G.MAKERS) + "]"
    tools = "[" + ", ".join(f"{{'name': {_text(t[0])}, 'text': {_text(G.schema_text(i))}}}" for i, t in enumerate(G.TOOLS)) + "]"
    calls = (("a", 100), ("b", 200), ("c", 300))
    alias = lambda t: f"CASE WHEN renames AND {_drawn(3, f'''k, '|', {t}''')} < {G.RENAME_EACH} THEN {t} || '_v2' ELSE {t} END"
    call = lambda x: f"""concat('{{"name":"', {alias(f't_{x}')}, '","arguments":', g_{x}, '}}')"""
    ranked = lambda salt, some: f"list_sort(list_transform({some}, lambda x: {{'o': md5(concat('{SEED + salt}|', k, '|', x.name)), 'name': x.name, 'text': x.text}}))"
    return f"""lib AS (SELECT {makers} AS makers, {tools} AS tools),
keyed AS (SELECT c_custkey AS row, CAST(c_custkey AS VARCHAR) AS k, c_name, c_mktsegment, {_drawn(0, "CAST(c_custkey AS VARCHAR)")} AS roll FROM customer),
made AS (SELECT keyed.*, tools AS all_tools, {", ".join(f"{_one('makers', s)} AS m_{x}" for x, s in calls)} FROM keyed, lib),
formed AS (SELECT *, {", ".join(f"{_one(f'm_{x}', s + 1)} AS f_{x}" for x, s in calls)} FROM made),
spoken AS (SELECT *, {", ".join(f"f_{x}.tool AS t_{x}, {_filled(_one(f'f_{x}.queries', s + 2), s, False)} AS q_{x}, {_filled(f'f_{x}.arguments', s, True)} AS g_{x}" for x, s in calls)} FROM formed),
second AS (SELECT * REPLACE (CASE WHEN t_a = t_b THEN t_c ELSE t_b END AS t_b, CASE WHEN t_a = t_b THEN q_c ELSE q_b END AS q_b, CASE WHEN t_a = t_b THEN g_c ELSE g_b END AS g_b),
CASE WHEN roll < {G.REFUSE_BELOW} THEN 'refuse' WHEN roll < {G.TWO_BELOW} THEN 'two' ELSE 'one' END AS kind FROM spoken),
asked AS (SELECT *, {_drawn(2)} < {G.RENAME} AND kind <> 'refuse' AS renames, CASE kind WHEN 'refuse' THEN {_one(_list(G.REFUSED), 1)} WHEN 'two' THEN concat({_one(_list(G.PREFIXES), 8)}, q_a, {_one(_list(G.JOINS), 7)}, q_b) ELSE concat({_one(_list(G.PREFIXES), 8)}, q_a) END AS query,
CASE kind WHEN 'refuse' THEN CAST([] AS VARCHAR[]) WHEN 'two' THEN [t_a, t_b] ELSE [t_a] END AS called FROM second),
catalog AS (SELECT *, list_transform(list_filter(all_tools, lambda x: list_contains(called, x.name)), lambda x: {{'name': x.name, 'text': replace(x.text, concat('{{"name":"', x.name, '"'), concat('{{"name":"', {alias("x.name")}, '"'))}}) AS used,
({ranked(5, f"list_filter(all_tools[1:{len(G.TOOLS) if ood else G.N_TRAIN}], lambda y: NOT list_contains(called, y.name))")})[1:3 + CAST(floor({_drawn(4)} * 4) AS INTEGER)] AS others FROM asked),
examples AS (SELECT k, row, query, kind, CASE kind WHEN 'refuse' THEN '[]' WHEN 'two' THEN concat('[', {call("a")}, ',', {call("b")}, ']') ELSE concat('[', {call("a")}, ']') END AS answers,
list_transform({ranked(6, "list_concat(used, list_transform(others, lambda y: {'name': y.name, 'text': y.text}))")}, lambda z: z.text) AS tools FROM catalog)"""


TOOLS = "concat('[', array_to_string(tools, ','), ']')"


def _examples(spark: SparkSession, d: str, ood: bool) -> DataFrame:
    return G.generate_for(table(spark, d, "customer"), "c_custkey", SEED, ood, GIVEN)


def _generated_sql(ood: bool) -> str:
    return f"WITH {examples_sql(ood)} SELECT row, query, kind, answers, {TOOLS} AS tools, '{'ood' if ood else 'train'}' AS split FROM examples"


@query("generated_examples", _generated_sql(False))
def generated_examples(spark: SparkSession, d: str) -> DataFrame:
    """An example for each customer, whose name and segment fill slots."""
    return _examples(spark, d, False)


@query("generated_unseen", _generated_sql(True))
def generated_unseen(spark: SparkSession, d: str) -> DataFrame:
    """The same with the tools that training does not see."""
    return _examples(spark, d, True)


AUGMENTED = 11


def _augmented_sql() -> str:
    u = lambda salt: _drawn(salt, seed=AUGMENTED)
    part = lambda salt, n: f"CAST(floor({u(salt)} * {n}) AS INTEGER)"
    stamp = f"format('2026-{{:02d}}-{{:02d}}T{{:02d}}:{{:02d}}:{{:02d}}', {part(4, 12)} + 1, {part(5, 28)} + 1, {part(6, 24)}, {part(7, 60)}, {part(8, 60)})"
    digest = lambda salt, x: f"md5(concat('{AUGMENTED + salt}|', k, '|', {x}))"
    name = lambda x: f"json_extract_string({x}, '$.name')"
    return f"""WITH {examples_sql(False)},
more AS (SELECT examples.*, (list_sort(list_transform(list_filter(lib.tools, lambda x: NOT list_contains(list_transform(examples.tools, lambda y: {name("y")}), x.name)), lambda x: {{'o': {digest(2, "x.name")}, 'text': x.text}})))[1:greatest(0, 10 + {part(1, 7)} - len(examples.tools))] AS new FROM examples, lib)
SELECT row, CASE WHEN {u(10)} < {G.DATED} THEN concat('{G.PREAMBLE}', {stamp}, ' Day of week is ', {_list(G.DAYS)}[{part(9, 7)} + 1], chr(10), query) ELSE query END AS query, kind, answers,
concat('[', array_to_string(CASE WHEN {u(0)} < {G.TOP_UP} THEN list_transform(list_sort(list_transform(list_concat(tools, list_transform(new, lambda x: x.text)), lambda y: {{'o': {digest(3, "y")}, 't': y}})), lambda z: z.t) ELSE tools END, ','), ']') AS tools FROM more"""


@query("augmented_examples", _augmented_sql())
def augmented_examples(spark: SparkSession, d: str) -> DataFrame:
    """Customers' examples with larger catalogs and date preambles."""
    out = G.augment(_examples(spark, d, False).withColumn("tools", F.from_json("tools", "array<string>")), "row", AUGMENTED)
    return out.select("row", "query", "kind", "answers", F.concat(F.lit("["), F.array_join("tools", ","), F.lit("]")).alias("tools"))
