"""Operators on small texts, over rows made from whole tables; the SQL works out what each row should give."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions import tools as T
from ..functions.text import MONTHS, iso_date_evidenced
from ..operators import retrieve as R
from ..operators import scoring as S
from ..operators import tokenizer as K
from ..operators import validate as V
from ..operators.catalog import retrieve_global as retrieve_all
from ..registry import query
from ..session import dealt, ship
from ..sources import adapters, jsonl
from .corpus import table
from .validation import LIGHTS

EVENTS = "e AS (SELECT event_id, event_type AS t, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n, props FROM events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    """Number, type ``t`` and value ``k`` (as text) of every event."""
    return dealt(spark.read.parquet(f"{d}/events.parquet")).select("event_id", F.col("event_type").alias("t"), F.get_json_object("props", "$.k").alias("k"), "props")


def text(template: str) -> Column:
    """A template with ``{column}`` slots; other braces stand for themselves."""
    parts, rest = [], template
    while rest:
        slots = [(rest.find("{" + c + "}"), c) for c in ("t", "k", "id") if "{" + c + "}" in rest]
        if not slots:
            parts.append(F.lit(rest))
            break
        at, c = min(slots)
        parts += [F.lit(rest[:at]), F.col("event_id").cast("string") if c == "id" else F.col(c)]
        rest = rest[at + len(c) + 2 :]
    return F.concat(*parts)


def one_of(n: Column, templates: list[str]) -> Column:
    """The template whose number is the event's number modulo their count."""
    out = F.when(n % len(templates) == 0, text(templates[0]))
    for r, template in enumerate(templates[1:], 1):
        out = out.when(n % len(templates) == r, text(template))
    return out


@query("json_lines_over_events", f"WITH {EVENTS} SELECT event_id, event_id % 4 <> 1 AS ok FROM e WHERE event_id % 4 <> 2")
def json_lines_over_events(spark: SparkSession, d: str) -> DataFrame:
    value = one_of(F.col("event_id"), ['{"k":{k}}', '{"k":', "  \t", '[{"t":"{t}"}]'])
    return jsonl.mark_lines(events(spark, d).select("event_id", value.alias("value"))).select("event_id", "ok")


@query("calls_equal_over_events", f"WITH {EVENTS} SELECT event_id, event_id % 6 = 0 AS strict, event_id % 6 < 2 AS loose, event_id % 6 IN (0, 1, 2, 4) AS name FROM e")
def calls_equal_over_events(spark: SparkSession, d: str) -> DataFrame:
    """The same call with other key order, a float, a text, torn, with one more key, under another name."""
    a = text('[{"name":"{t}","arguments":{"k":{k},"z":"x"}}]')
    other = ['{"name":"{t}","arguments":{"z":"x","k":{k}}}', '[{"name":"{t}","arguments":{"z":"x","k":{k}.0}}]', '[{"name":"{t}","arguments":{"k":"{k}","z":"x"}}]', '[{"name":"{t}","arg', '[{"name":"{t}","arguments":{"k":{k},"z":"x","y":null}}]', '[{"name":"{t}_","arguments":{"k":{k},"z":"x"}}]']
    b = one_of(F.col("event_id"), other)
    # Each form is a column that several others name, so it is worked out once.
    rows = events(spark, d).select("event_id", C.loads(a).alias("a"), C.loads(b).alias("b"))
    rows = rows.withColumns({"x": C.canonical(F.col("a")), "y": C.canonical(F.col("b"))})
    equal = lambda x, y: F.coalesce(x == y, F.lit(False))
    return rows.select("event_id", equal(F.col("x"), F.col("y")).alias("strict"), equal(C.loosened(F.col("x")), C.loosened(F.col("y"))).alias("loose"), C.name_equal(F.col("a"), F.col("b")).alias("name"))


@query("dumps_over_events", f"""WITH {EVENTS} SELECT event_id, '[{{"name":"' || t || '","arguments":{{"a":{{"y":[1,2.5],"b":null}},"k":' || k || ',"z":true}}}}]' AS dumped FROM e""")
def dumps_over_events(spark: SparkSession, d: str) -> DataFrame:
    calls = C.loads(text('{"arguments": {"z": true, "k": {k}, "a": {"y": [1, 2.5], "b": null}}, "name": "{t}"}'))
    return events(spark, d).select("event_id", C.dumps(calls).alias("dumped"))


# Ten predictions against one truth, in which ``opt`` may be left out and two values are acceptable.
PREDICTED = ['{"k":{k}}', '{"k":{k}.0}', '{"k":-5,"opt":1}', '{"k":-6}', '{"k":"{k}"}', '{"k":{k},"opt":"no"}', '{"k":{k},"more":1}', "{}", '{"k":{k},"opt":""}', '{"k":true}']


@query("accepted_over_events", f"WITH {EVENTS} SELECT event_id, event_id % 10 IN (0, 1, 2, 8) OR event_id % 10 = 9 AND n = 1 AS ok, event_id % 3 = 0 AS refused, t || ' k=' || k AS gold FROM e")
def accepted_over_events(spark: SparkSession, d: str) -> DataFrame:
    """Whether a call is acceptable, whether an empty list passes where nothing may be called, and the truth as one call."""
    truth = text('[{"{t}":{"k":[{k},-5],"opt":["",1]}}]')
    rows = events(spark, d).withColumns({"arguments": one_of(F.col("event_id"), PREDICTED), "truth": truth})
    pred = C.loads(F.concat(F.lit('[{"name":"'), "t", F.lit('","arguments":'), "arguments", F.lit("}]")))
    rows = rows.withColumns({"pred": pred, "none": F.when(F.col("event_id") % 3 == 0, F.array().cast(C.CALLS)).otherwise(pred)})
    line = lambda c: F.concat_ws(" ", c["name"], F.array_join(F.transform(F.map_entries(c["arguments"]), lambda kv: F.concat_ws("=", kv["key"], kv["value"])), " "))
    ok, refused = (S.row_accepted(F.lit(kind), F.col(c), F.col("truth")) for kind, c in (("simple_python", "pred"), ("irrelevance", "none")))
    return rows.select("event_id", ok.alias("ok"), refused.alias("refused"), F.array_join(F.transform(S.representative(F.col("truth")), line), ";").alias("gold"))


# (query, template, call, arguments) of eight kinds of examples, one for each of the first rules that can break.
MADE = [
    ("dim the {t} to {k}", "one", "set_lights", '{"room":"{t}","brightness":{k}}'),
    ("dim the {t}", "one", "set_lights", '{"room":"{t}","brightness":{k}}'),
    ("dim the {t}", "two", "set_lights", '{"room":"{t}"}'),
    ("dim to {k}", "one", "set_lights", '{"brightness":{k}}'),
    ("call {t}", "one", "{t}", '{"who":"{t}"}'),
    ("lights in {t}", "refuse", "set_lights", '{"room":"{t}"}'),
    ("dim the {t}", "one", "set_lights", '{"room":"zz{k}"}'),
    ("lights in {t}", "one", "set_lights", '{"room":"{t}","level":{k}}'),
]


def made(spark: SparkSession, d: str) -> DataFrame:
    e, n = events(spark, d), F.col("event_id")
    columns = [one_of(n, [m[i] for m in MADE]) for i in range(4)]
    call = F.concat(F.lit('[{"name":"'), columns[2], F.lit('","arguments":'), columns[3], F.lit("}]"))
    return e.select("event_id", columns[0].alias("query"), columns[1].alias("template"), C.loads(call).alias("answers"), T.parse(F.lit(LIGHTS)).alias("tools"))


ERROR = """CASE event_id % 8 WHEN 1 THEN CASE WHEN n > 1 THEN 'number ' || k || ' for brightness not evidenced in query' END WHEN 2 THEN 'template two needs 2 calls, got 1'
WHEN 3 THEN 'set_lights missing required [''room'']' WHEN 4 THEN 'unknown tool ' || t WHEN 5 THEN 'refuse template must have answers=[]'
WHEN 6 THEN 'value ''zz' || k || ''' for room not evidenced in query' WHEN 7 THEN 'set_lights has no parameter level' END"""
REPAIRED = """CASE event_id % 8 WHEN 0 THEN 'brightness=' || k || ',room=' || t WHEN 1 THEN CASE WHEN n > 1 THEN '' ELSE 'brightness=' || k || ',' END || 'room=' || t WHEN 3 THEN 'brightness=' || k
WHEN 4 THEN 'who=' || t WHEN 6 THEN 'room=zz' || k WHEN 7 THEN CASE WHEN n > 1 THEN '' ELSE 'level=' || k || ',' END || 'room=' || t ELSE 'room=' || t END"""


@query("validate_over_events", f"WITH {EVENTS} SELECT event_id, {ERROR} AS error, event_id % 8 NOT IN (1, 6, 7) AS grounded, event_id % 8 IN (0, 1, 3) AS omits, {REPAIRED} AS repaired FROM e")
def validate_over_events(spark: SparkSession, d: str) -> DataFrame:
    q, tools, answers = F.col("query"), F.col("tools"), F.col("answers")
    repaired = F.array_join(F.transform(V.repaired(q, tools, answers)[0]["entries"], lambda e: F.concat_ws("=", e["k"], e["text"])), ",")
    return made(spark, d).select("event_id", V.error(q, tools, answers, F.col("template")).alias("error"), V.grounded(q, answers).alias("grounded"), V.omits_option(tools, answers).alias("omits"), repaired.alias("repaired"))


@query("rejections_over_events", f"WITH {EVENTS}, x AS (SELECT {ERROR} AS error FROM e) SELECT substr(error, 1, 25) AS reason, count(*) AS n FROM x WHERE error IS NOT NULL GROUP BY reason")
def rejections_over_events(spark: SparkSession, d: str) -> DataFrame:
    # Rows without an error go by their count: a filter on errors would be moved before the steps that errors come from, with all of them put into it.
    reasons = validate_over_events(spark, d).select(F.substring("error", 1, 25).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("reason").alias("n")).filter("n > 0")


# (name, python, bfcl, lowered, annotation), dealt to parts; the part's own type is a name that no source knows.
NAMES = [
    ("str", "string", "str", "str", "string"),
    ("int, optional", "integer", "int, optional", "int, optional", "string"),
    ("float", "number", "number", "float", "number"),
    ("OBJECT", "object", "OBJECT", "object", "string"),
    ("List[int]", "string", "List[int]", "list[int]", "array"),
    ("Optional[float]", "string", "Optional[float]", "optional[float]", "number"),
]


def _named(i: int, other: str) -> str:
    return "CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN '{n[i]}'" for k, n in enumerate(NAMES)) + f" ELSE {other} END"


@query("types_over_parts", f"SELECT p_partkey, {_named(1, repr('string'))} AS python, {_named(2, 'p_type')} AS bfcl, {_named(3, 'lower(p_type)')} AS lowered, {_named(4, repr('string'))} AS annotation FROM part")
def types_over_parts(spark: SparkSession, d: str) -> DataFrame:
    n = F.expr(_named(0, "p_type"))
    return table(spark, d, "part").select("p_partkey", T.python_type(n).alias("python"), T.bfcl_type(n).alias("bfcl"), T.lower_type(n).alias("lowered"), T.annotation_type(n).alias("annotation"))


CATALOG = ['[{"name":"{t}","parameters":{"properties":{"k":{"type":"integer"}}}},{"name":"b{k}"}]', '[{"name":"{t}"}]', '[{"name":"{t}"},{"name":" {t} "}]', '[{"name":"{t}"},{"name":"b","parameters":{"properties":{"k":{"type":"{t}"}}}}]', '[{"name":{k}},{"name":"b"}]', '{"name":"{t}"}', "{t}"]


@query("catalogs_over_events", f"WITH {EVENTS} SELECT event_id, event_id % 7 = 0 AS sound FROM e")
def catalogs_over_events(spark: SparkSession, d: str) -> DataFrame:
    """A sound catalog, one tool, two of one name, an unknown type, a name that is no text, an object, no JSON."""
    return events(spark, d).select("event_id", V.sound_catalog(one_of(F.col("event_id"), CATALOG)).alias("sound"))


ORDER_DATE = "1990 + o_orderkey % 30 AS y, 1 + o_orderkey % 12 AS m, 1 + o_orderkey % 28 AS d"


@query("dates_over_orders", "SELECT o_orderkey, o_orderkey % 5 < 2 AS told FROM orders")
def dates_over_orders(spark: SparkSession, d: str) -> DataFrame:
    """Dates told by month name, told by numbers, without a day, without a year, with another day."""
    o = table(spark, d, "orders").selectExpr("o_orderkey", *ORDER_DATE.split(", "))
    name = F.initcap(F.element_at(F.array(*map(F.lit, MONTHS)), F.col("m").cast("int")))
    told = F.format_string("on %s %d, %d", name, "d", "y")
    numbers = F.format_string("on %d/%02d of %d", "m", "d", "y")
    r = F.col("o_orderkey") % 5
    said = F.when(r == 0, told).when(r == 1, numbers).when(r == 2, F.format_string("in %s %d", name, "y")).when(r == 3, F.format_string("on %s %d", name, "d")).otherwise(F.format_string("on %s %d, %d", name, F.col("d") % 28 + 1, "y"))
    return o.select("o_orderkey", iso_date_evidenced(F.format_string("%04d-%02d-%02d", "y", "m", "d"), said).alias("told"))


@query(
    "prompts_over_events",
    f"""WITH {EVENTS} SELECT event_id, '<tools>' || chr(10) || '- ' || t || ' (b=bool k=int! m=enum(x|' || k || ')) Does ' || t || chr(10) || '- next () ' || chr(10) || '</tools>' || chr(10) || '<query>' || chr(10) || 'run ' || k || chr(10) || '</query>' || chr(10) || '<call>' || chr(10) AS prompt, t AS called FROM e""",
)
def prompts_over_events(spark: SparkSession, d: str) -> DataFrame:
    tools = T.parse(text('[{"name":"{t}","description":" Does {t}","parameters":{"properties":{"k":{"type":"integer"},"b":{"type":"boolean"},"m":{"enum":["x","{k}"]},"gone":null},"required":["k","gone"]}},{"name":"next"}]'))
    return events(spark, d).withColumn("tools", tools).select("event_id", T.prompt(text("run {k}"), F.col("tools")).alias("prompt"), T.named(F.col("tools"), F.col("t"))["name"].alias("called"))


# Keys: name, arguments, k; the rest of the text is structure but for the name, the value and the last bracket.
@query("tags_over_events", f"WITH {EVENTS} SELECT event_id, 14 AS n_key, length(t) AS n_name, length(k) AS n_value, 1 AS n_stop, 17 AS n_struct FROM e")
def tags_over_events(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    of = lambda t: F.size(F.filter("tags", lambda x: x == t)).cast("long")
    rows = events(spark, d).select("event_id", K.tag_column(text('[{"name":"{t}","arguments":{"k":{k}}}]')).alias("tags"))
    return rows.select("event_id", of(K.KEY).cast("int").alias("n_key"), of(K.NAME).alias("n_name"), of(K.VALUE).alias("n_value"), of(K.STOP).cast("int").alias("n_stop"), of(K.STRUCT).cast("int").alias("n_struct"))


@query(
    "numbers_over_events",
    f"""WITH {EVENTS} SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN n + 0.75 WHEN 1 THEN -n WHEN 2 THEN n * 100 WHEN 3 THEN 0 WHEN 4 THEN CASE WHEN n < 10 THEN 0 ELSE n END ELSE n END AS DOUBLE) AS value FROM e""",
)
def numbers_over_events(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with a tail, cut to whole ones, with an exponent, none, with a zero in front, twice dotted."""
    k = F.when((F.col("event_id") % 6 == 4) & (F.length("k") == 1), F.concat(F.lit("0"), "k")).otherwise(F.col("k"))
    said = one_of(F.col("event_id"), ["{k}.75x", "-{k}.5", "{k}e2", "x{k}", "{k}", "{k}.0.5"])
    kind = F.when(F.col("event_id") % 2 == 1, "integer").otherwise("number")
    return events(spark, d).withColumn("k", k).select("event_id", R.numeric_repair(said, kind).alias("value"))


WORDS = r"list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '')"


@query(
    "subarrays_over_documents",
    f"""WITH w AS (SELECT doc_id, {WORDS} AS h FROM documents), x AS (SELECT doc_id, h, list_slice(h, 1 + doc_id % 5, 3 + doc_id % 5) AS q, len(h) AS n FROM w)
SELECT doc_id, CAST(coalesce(CASE WHEN len(q) > 0 THEN list_filter(range(0, greatest(0, n - len(q) + 1)), lambda i: list_slice(h, i + 1, i + len(q)) = q)[1] END, -1) AS INTEGER) AS found,
n >= 6 AND list_slice(h, n - 1, n) = list_slice(h, n - 3, n - 2) AND list_slice(h, n - 1, n) = list_slice(h, n - 5, n - 4)
OR n >= 9 AND list_slice(h, n - 2, n) = list_slice(h, n - 5, n - 3) AND list_slice(h, n - 2, n) = list_slice(h, n - 8, n - 6)
OR n >= 12 AND list_slice(h, n - 3, n) = list_slice(h, n - 7, n - 4) AND list_slice(h, n - 3, n) = list_slice(h, n - 11, n - 8) AS looped FROM x""",
)
def subarrays_over_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first place of three words from near the beginning, and whether a document ends in a loop."""
    words = F.filter(F.split("text", r"[ \n\t\r]+"), lambda x: x != "")
    rows = table(spark, d, "documents").select("doc_id", words.alias("hay"))
    needle = F.slice("hay", 1 + (F.col("doc_id") % 5).cast("int"), F.lit(3))
    return rows.select("doc_id", R.find_sub(F.col("hay"), needle).alias("found"), R.loops(F.col("hay")).alias("looped"))


RAW = [
    '{"query":"run {t} with {k} ","tools":"[{\\"name\\":\\"{t}\\",\\"parameters\\":{\\"k\\":{\\"type\\":\\"int, optional\\"}}}]","answers":"[{\\"name\\":\\"{t}\\",\\"arguments\\":{\\"k\\":{k}}}]"}',
    '{"query":"run {t}","tools":"[{\\"name\\":\\"{t}\\"}]","answers":"[{\\"name\\":\\"other\\",\\"arguments\\":{}}]"}',
    '{"query":"run {t}","tools":"[{\\"name\\":\\"{t}\\"}]","answers":"[]"}',
    '{"query":"run {t}","tools"',
]


@query("convert_over_events", f"""WITH {EVENTS} SELECT event_id AS row_idx, 'run ' || t || ' with ' || k AS query, '[{{"name":"' || t || '","arguments":{{"k":' || k || '}}}}]' AS answers, t || '(k=int!)' AS tool FROM e WHERE event_id % 4 = 0""")
def convert_over_events(spark: SparkSession, d: str) -> DataFrame:
    """One raw line for each event; those with unknown tools, without calls or torn are dropped."""
    ship(spark)
    lines = events(spark, d).select(one_of(F.col("event_id"), RAW).alias("value"), F.col("event_id").alias("row_idx"))
    line = T.signature(T.parse(F.col("tools"))[0])
    return adapters.convert(lines, "apigen").select("row_idx", "query", "answers", F.concat(*(F.regexp_extract(line, r"^- (\w+) (\(.*\))", i) for i in (1, 2))).alias("tool"))


#: One amount in several notations; ``c`` is the price in cents.
NOTATIONS = {"plain": "{0}.{1}", "point": "{2}e-2", "large": "{2}E+20", "small": "{2}.0e-9", "many": "{2}000000.5", "whole": "{2}"}


def _notation(form: str, dialect: str) -> str:
    """A notation as SQL over ``c``; it reads the same in both engines."""
    kinds = {"{0}": "CAST(c {div} 100 AS {text})", "{1}": "lpad(CAST(c % 100 AS {text}), 2, '0')", "{2}": "CAST(c AS {text})"}
    parts = [kinds[x] if x in kinds else f"'{x}'" for x in re.split(r"(\{[012]\})", form) if x]
    div, text = ("div", "STRING") if dialect == "spark" else ("//", "VARCHAR")
    return "concat(" + ", ".join(parts).format(div=div, text=text) + ")"


_FLOAT = lambda form: f"CAST(CAST({_notation(form, 'duckdb')} AS DOUBLE) AS VARCHAR)"
_PRICES = ", ".join(f"""'"{k}":', {_FLOAT(f) if k != "whole" else _notation(f, "duckdb")}, '{"," if k != sorted(NOTATIONS)[-1] else "}"}'""" for k, f in sorted(NOTATIONS.items()))


@query("prices_canonical", f"SELECT o_orderkey, concat('{{\"again\":', {_FLOAT(NOTATIONS['plain'])}, ',', {_PRICES}) AS arguments, true AS stated FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)")
def prices_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Arguments whose numbers are written in several ways, one of them under a repeated key; the query states each as it is printed."""
    cents = dealt(spark.read.parquet(f"{d}/orders.parquet")).select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    forms = {k: F.expr(_notation(f, "spark")) for k, f in NOTATIONS.items()}
    pairs = [x for k, v in forms.items() for x in (F.lit(f', "{k}": '), v)]
    given = F.concat(F.lit('{"again": {"x": 1}'), *pairs, F.lit(', "again": '), forms["plain"], F.lit("}"))
    # Columns that several others name, so each text is put together and read once.
    rows = cents.select("o_orderkey", F.concat(F.lit('{"name": "pay", "arguments": '), given, F.lit("}")).alias("text"))
    rows = rows.select("o_orderkey", C.opened(C.loads(F.col("text"))).alias("opened"))
    printed = F.regexp_extract(C.dumped(C.ordered(F.col("opened"))), r'"arguments":(.*)\}\]$', 1)
    said = F.concat(F.lit("pay "), F.array_join(F.transform(F.col("opened")[0]["entries"], lambda e: e["text"]), " and "))
    return rows.select("o_orderkey", printed.alias("arguments"), V.told(said, F.col("opened")).alias("stated"))


_WORDS = "list_sort(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')))"


@query(
    "retrieve_global",
    f"""WITH q AS (SELECT item_id AS query_id, {_WORDS.format("concat_ws(' ', name, kind, size)")} AS w FROM items),
t AS (SELECT p_partkey AS tool_id, {_WORDS.format("concat_ws(' ', p_name, p_brand, p_size)")} AS w FROM part),
s AS (SELECT query_id, tool_id, len(list_intersect(q.w, t.w)) AS score FROM q JOIN t ON list_has_any(q.w, t.w))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tool_id) AS INTEGER) AS rank, tool_id, CAST(score AS INTEGER) AS score FROM s
QUALIFY rank <= 5""",
)
def retrieve_global(spark: SparkSession, d: str) -> DataFrame:
    """The five best parts of the whole catalog for each item of the shop."""
    items = table(spark, d, "items").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "name", "kind", "size").alias("text"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("tool_id"), F.concat_ws(" ", "p_name", "p_brand", "p_size").alias("text"))
    return retrieve_all(items, parts, 5)
