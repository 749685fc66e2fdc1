"""Grounding, validation, rendering and retrieval: fixed cases with results worked out by hand, and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions import tools as T
from ..functions.literals import Literal
from ..functions.text import iso_date_evidenced
from ..operators import retrieve as R
from ..operators import validate as V
from ..registry import fixture, query
from .corpus import table

LIGHTS = '[{"name":"set_lights","description":"Dim or color the lights","parameters":{"type":"object","properties":{"room":{"type":"string"},"brightness":{"type":"integer"},"mode":{"type":"string","enum":["warm","cool"]},"on":{"type":"boolean"}},"required":["room"]}},{"name":"setTimer","description":"Start a timer","parameters":{"type":"object","properties":{"minutes":{"type":"number"},"day":{"type":"string"}},"required":["minutes"]}}]'


def _call(name: str, args: str) -> str:
    return f'[{{"name":"{name}","arguments":{args}}}]'


EXAMPLES = Literal(
    "id long, query string, template string, answers string, error string, grounded boolean, omits boolean, repaired string",
    [
        (1, "dim the kitchen to 30", "one", _call("set_lights", '{"room":"kitchen","brightness":30}'), None, True, True, "brightness=30,room=kitchen"),
        (2, "dim the kitchen", "one", _call("set_lights", '{"room":"kitchen","brightness":30}'), "number 30 for brightness not evidenced in query", False, True, "room=kitchen"),
        (3, "dim the kitchen", "two", _call("set_lights", '{"room":"kitchen"}'), "template two needs 2 calls, got 1", True, False, "room=kitchen"),
        (4, "dim it", "one", _call("set_lights", '{"brightness":1}'), "set_lights missing required ['room']", False, True, "brightness=1"),
        (5, "tell a joke", "refuse", "[]", None, True, False, None),
        (6, "tell a joke", "one", "[]", "empty answers for non-refuse template", True, False, None),
        (7, "  ", "one", "[]", "missing query", True, False, None),
        (8, "tell a joke", "one", "no list", "answers must be a list", None, False, None),
        (9, "call mom", "one", _call("phone", '{"who":"mom"}'), "unknown tool phone", True, False, "who=mom"),
        (10, "timer for 5 on March 3rd 2024", "one", _call("setTimer", '{"minutes":5,"day":"2024-03-03"}'), None, False, False, "day=2024-03-03,minutes=5"),
        (11, "timer for 5", "one", _call("setTimer", '{"minutes":5,"day":"2024-03-03"}'), "value '2024-03-03' for day not evidenced in query", False, False, "minutes=5"),
        (12, "kitchen lights warm", "one", _call("set_lights", '{"room":"kitchen","mode":"hot"}'), "mode not in enum [warm, cool]", False, True, "room=kitchen"),
        (13, "kitchen lights at 2.5", "one", _call("set_lights", '{"room":"kitchen","brightness":2.5}'), "brightness must be integer", True, True, "brightness=2.5,room=kitchen"),
        (14, "kitchen lights on", "one", _call("set_lights", '{"room":"kitchen","on":"yes"}'), "on must be boolean", False, True, "room=kitchen"),
        (15, "kitchen lights", "one", _call("set_lights", '{"room":"kitchen","color":"red"}'), "set_lights has no parameter color", False, False, "room=kitchen"),
        (16, "dim the Kitchen-Room to 1.5", "one", _call("set_lights", '{"room":"kitchen room"}'), "value 'kitchen room' for room not evidenced in query", True, False, "room=kitchen room"),
        (17, "lights in 12", "refuse", _call("set_lights", '{"room":"12"}'), "refuse template must have answers=[]", True, False, "room=12"),
        (18, "kitchen lights", "one", _call("set_lights", '{"room":"kitchen","on":true,"brightness":0}'), None, False, True, "brightness=0,on=true,room=kitchen"),
        (19, "kitchen", "one", _call("set_lights", '{"room":7}'), "room must be string", False, False, "room=7"),
    ],
)


def examples(spark: SparkSession) -> DataFrame:
    return EXAMPLES.frame(spark).select("id", "query", "template", C.loads(F.col("answers")).alias("answers"), T.parse(F.lit(LIGHTS)).alias("tools"))


@fixture("validate_examples", f"SELECT id, error FROM {EXAMPLES.sql()}")
def validate_examples(spark: SparkSession, d: str) -> DataFrame:
    return examples(spark).select("id", V.error(F.col("query"), F.col("tools"), F.col("answers"), F.col("template")).alias("error"))


@fixture("grounded_examples", f"SELECT id, grounded FROM {EXAMPLES.sql()}")
def grounded_examples(spark: SparkSession, d: str) -> DataFrame:
    return examples(spark).select("id", V.grounded(F.col("query"), F.col("answers")).alias("grounded"))


@fixture("omission_exemplars", f"SELECT id, omits FROM {EXAMPLES.sql()}")
def omission_exemplars(spark: SparkSession, d: str) -> DataFrame:
    return examples(spark).select("id", V.omits_option(F.col("tools"), F.col("answers")).alias("omits"))


@fixture("strip_unevidenced", f"SELECT id, repaired FROM {EXAMPLES.sql()} WHERE repaired IS NOT NULL")
def strip_unevidenced(spark: SparkSession, d: str) -> DataFrame:
    fixed = V.repaired(F.col("query"), F.col("tools"), F.col("answers"))
    return examples(spark).filter("size(answers) > 0").select("id", F.array_join(F.transform(fixed[0]["entries"], lambda e: F.concat_ws("=", e["k"], e["text"])), ",").alias("repaired"))


@fixture("rejection_reasons", f"SELECT substr(error, 1, 60) AS reason, count(*) AS n FROM {EXAMPLES.sql()} WHERE error IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 8")
def rejection_reasons(spark: SparkSession, d: str) -> DataFrame:
    return validate_examples(spark, d).filter("error IS NOT NULL").groupBy(F.substring("error", 1, 60).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(8)


N = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"


@query(
    "evidence_grounded",
    f"""WITH a AS (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations QUALIFY role = 'assistant'),
w AS (SELECT conv_id, turn, coalesce(asked, '') AS asked, coalesce(regexp_extract(answer, '[A-Za-z]+'), '') AS word FROM a)
SELECT conv_id, turn, (length(word) <= 2 OR contains({N.format('asked')}, {N.format('word')})) AND contains({N.format('asked')}, CAST(turn AS VARCHAR)) AS grounded FROM w""",
)
def evidence_grounded(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").withColumn("asked", F.coalesce(F.lag("text").over(w), F.lit(""))).filter("role = 'assistant'")
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    call = F.struct(F.lit("f").alias("name"), F.to_json(F.struct(word.alias("word"), F.col("turn").alias("turn"))).alias("arguments"))
    return turns.select("conv_id", "turn", V.grounded(F.col("asked"), F.array(call)).alias("grounded"))


DATES = Literal(
    "id long, value string, query string, told boolean",
    [
        (1, "2024-03-03", "on March 3rd, 2024", True),
        (2, "2024-03-03", "on 3/03 of 2024", True),
        (3, "2024-03-03", "in March 2024", False),
        (4, "2024-13-03", "3 2024 13/", False),
        (5, "2024-12-01", "december 01 2024", True),
        (6, "2024-12-01", "december 11 2024", False),
        (7, "tomorrow", "tomorrow", False),
        (8, "2024-05-21", "May 21st 2023", False),
    ],
)


@fixture("iso_date_evidence", f"SELECT id, told FROM {DATES.sql()}")
def iso_date_evidence(spark: SparkSession, d: str) -> DataFrame:
    return DATES.frame(spark).select("id", iso_date_evidenced(F.col("value"), F.col("query")).alias("told"))


CATALOGS = Literal(
    "id long, catalog string, sound boolean",
    [
        (1, LIGHTS, True),
        (2, '[{"name":"a","parameters":{}}]', False),
        (3, '[{"name":"a","parameters":{}},{"name":" a"}]', False),
        (4, '[{"name":"a","parameters":{"properties":{"x":{"type":"str"}}}},{"name":"b"}]', False),
        (5, '[{"name":"a","parameters":{"properties":{"x":{}}}},{"name":"b"}]', True),
        (6, '[{"name":1},{"name":"b"}]', False),
        (7, '[{"name":"a","parameters":{"properties":{"x":"text"}}},{"name":"b"}]', False),
        (8, '{"name":"a"}', False),
        (9, "nothing", False),
    ],
)


@fixture("invented_catalogs", f"SELECT id, sound FROM {CATALOGS.sql()}")
def invented_catalogs(spark: SparkSession, d: str) -> DataFrame:
    return CATALOGS.frame(spark).select("id", V.sound_catalog(F.col("catalog")).alias("sound"))


PROMPT = "<tools>\n- set_lights (brightness=int mode=enum(warm|cool) on=bool room=str!) Dim or color the lights\n- setTimer (day=str minutes=num!) Start a timer\n</tools>\n<query>\ndim it\n</query>\n<call>\n"
RENDERED = Literal("id long, prompt string", [(1, PROMPT)])


@fixture("render_prompt", f"SELECT id, prompt FROM {RENDERED.sql()}")
def render_prompt(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 2).select("id", T.prompt(F.lit("dim it"), T.parse(F.lit(LIGHTS))).alias("prompt"))


TYPE_NAMES = Literal(
    "id long, name string, python string, bfcl string, lowered string, annotation string",
    [
        (1, "str", "string", "str", "str", "string"),
        (2, "int, optional", "integer", "int, optional", "int, optional", "string"),
        (3, "float", "number", "number", "float", "number"),
        (4, "dict", "object", "object", "dict", "object"),
        (5, "OBJECT", "object", "OBJECT", "object", "string"),
        (6, "List[int]", "string", "List[int]", "list[int]", "array"),
        (7, "Optional[float]", "string", "Optional[float]", "optional[float]", "number"),
        (8, "Dict[str, int]", "string", "Dict[str, int]", "dict[str, int]", "object"),
        (9, "tuple", "string", "array", "tuple", "string"),
        (10, "any", "string", "string", "any", "string"),
        (11, "Widget", "string", "Widget", "widget", "string"),
    ],
)


@fixture("type_names", f"SELECT id, python, bfcl, lowered, annotation FROM {TYPE_NAMES.sql()}")
def type_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return TYPE_NAMES.frame(spark).select("id", T.python_type(n).alias("python"), T.bfcl_type(n).alias("bfcl"), T.lower_type(n).alias("lowered"), T.annotation_type(n).alias("annotation"))


# A catalog, and questions over it: the benchmark's texts and a few of our own.
WEATHER = '[{"name":"get_weather","description":"Weather in a city","parameters":{"type":"object","properties":{"city":{"type":"string"}},"required":["city"]}},{"name":"send_message","description":"Text a person","parameters":{"type":"object","properties":{"to":{"type":"string"},"body":{"type":"string"}},"required":["to"]}},{"name":"setTimer","description":"Start a timer","parameters":{"type":"object","properties":{"minutes":{"type":"number"}},"required":["minutes"]}},{"name":"play","description":"Play the music and the radio","parameters":{"type":"object","properties":{"song":{"type":"string"}},"required":[]}}]'
TOKENS_OF = {"get_weather": ["get", "weather", "in", "a", "city"], "send_message": ["send", "message", "text", "a", "person", "to", "body"], "setTimer": ["set", "timer", "start", "a", "minutes"], "play": ["play", "the", "music", "and", "radio", "song"]}
NAME_TOKENS = {"get_weather": ["get", "weather"], "send_message": ["send", "message"], "setTimer": ["set", "timer"], "play": ["play"]}
ASKED = Literal("id long, query string, used string, city string", [(1, "weather in Oslo then text @maya it looks rainy", None, None), (2, "weather in Oslo then text @maya it looks rainy", "get_weather", "Oslo"), (3, "play something", None, None), (4, "", None, None), (5, "Set a timerFor ten minutes", "setTimer", "now")])


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the calls made so far: the fixed ones, and every benchmark text."""
    items = table(spark, d, "benchmark").select((F.col("item_id") + 1000).alias("id"), F.col("text").alias("query"), F.lit(None).cast("string").alias("used"), F.lit(None).cast("string").alias("city"))
    rows = ASKED.frame(spark).unionByName(items)
    call = F.array(F.struct(F.col("used").alias("name"), F.to_json(F.struct(F.col("city").alias("city"))).alias("arguments")))
    return rows.select("id", "query", F.when(F.col("used").isNull(), F.array().cast(C.CALLS)).otherwise(call).alias("emitted"), T.parse(F.lit(WEATHER)).alias("tools"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


TOKENS = r"list_distinct(regexp_extract_all(lower(regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[a-z0-9]+'))"
LEXICAL = f"""rows AS (SELECT id, query, used, city FROM {ASKED.sql()} UNION ALL SELECT item_id + 1000, text, NULL, NULL FROM benchmark),
bags AS (SELECT id, used, list_distinct(list_concat({TOKENS.format('query')}, {TOKENS.format("coalesce(city, '')")})) AS bag FROM rows),
tools(i, name, words, name_words) AS (VALUES {", ".join(f"({i}, '{n}', {_list(w)}, {_list(NAME_TOKENS[n])})" for i, (n, w) in enumerate(TOKENS_OF.items()))}),
scored AS (SELECT id, i, name, len(list_intersect(bag, words)) + CASE WHEN list_contains(bag, name) THEN 0.25 ELSE 0 END - CASE WHEN used = name THEN 1.5 ELSE 0 END AS score,
  greatest(0.0, len(list_intersect(bag, words)) + 2.0 * len(list_intersect(bag, name_words)) - CASE WHEN used = name THEN 1.0 ELSE 0.0 END) AS raw FROM bags, tools),
priors AS (SELECT id, i, name, CAST(CASE WHEN sum(raw) OVER (PARTITION BY id) > 0 THEN raw / sum(raw) OVER (PARTITION BY id) ELSE 0.25 END AS DOUBLE) AS p FROM scored)"""


@query("retrieve_topk", f"WITH {LEXICAL} SELECT id, string_agg(name, ',' ORDER BY score DESC, i) AS names FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, i) <= 2) GROUP BY id")
def retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("id", F.array_join(R.retrieve(F.col("query"), F.col("tools"), F.col("emitted"), 2), ",").alias("names"))


@query("lexical_prior", f"WITH {LEXICAL} SELECT id, name, round(p, 6) AS score FROM priors")
def lexical_prior(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("id", F.explode(R.prior(F.col("query"), F.col("tools"), F.col("emitted"))).alias("x")).select("id", "x.name", F.round("x.score", 6).alias("score"))


@query("refuse_gate", f"WITH {LEXICAL}, m AS (SELECT id, max(p) - 0.25 AS peak, (id % 8) / 10.0 AS margin FROM priors GROUP BY id) SELECT id, NOT (peak > 0.25 OR (margin < 0.35 AND peak > 0.08)) AS keeps, round(CAST(least(0.85, greatest(0.0, 4 * peak)) * (1 - margin) AS DOUBLE), 6) AS weight FROM m")
def refuse_gate(spark: SparkSession, d: str) -> DataFrame:
    scores = F.transform(R.prior(F.col("query"), F.col("tools"), F.col("emitted")), lambda x: x["score"])
    rows = asked(spark, d).select("id", scores.alias("s"), (F.col("id") % 8 / 10.0).alias("margin"))
    return rows.select("id", R.keeps_refusal(F.col("s"), F.col("margin")).alias("keeps"), F.round(R.prior_weight(F.col("s"), F.col("margin")), 6).alias("weight"))


@query("baseline_names", f"WITH {LEXICAL}, b AS (SELECT id, arg_min(name, (-score, i)) AS first FROM scored GROUP BY id) SELECT id, first || ',' || arg_min(name, (-score, name = first, i)) AS names FROM scored JOIN b USING (id) WHERE id NOT IN (2, 5) GROUP BY id, first")
def baseline_names(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).filter("size(emitted) = 0").select("id", F.array_join(R.first_choices(F.col("query"), F.col("tools"), F.lit(2)), ",").alias("names"))


NUMBERS = Literal("id long, text string, kind string, value double", [(1, "1-2", "integer", 1.0), (2, "3.4.5", "number", 3.4), (3, "-", "number", 0.0), (4, "-2.7", "integer", -2.0), (5, "007", "integer", 0.0), (6, "1e3x", "number", 1000.0), (7, "", "integer", 0.0), (8, "12", "integer", 12.0)])


@fixture("numeric_repair", f"SELECT id, value FROM {NUMBERS.sql()}")
def numeric_repair(spark: SparkSession, d: str) -> DataFrame:
    return NUMBERS.frame(spark).select("id", R.numeric_repair(F.col("text"), F.col("kind")).alias("value"))


ARRAYS = Literal("id long, hay string, needle string, found int, looped boolean", [(1, "1 2 3 4", "2 3", 1, False), (2, "1 2 1 2 1 2", "1 2", 0, True), (3, "1 2 3", "", -1, False), (4, "5", "5 5", -1, False), (5, "9 1 2 3 1 2 3 1 2 3", "3 1", 3, True), (6, "7 7 7", "8", -1, False)])


@fixture("subarray_search", f"SELECT id, found, looped FROM {ARRAYS.sql()}")
def subarray_search(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    return ARRAYS.frame(spark).select("id", R.find_sub(ids("hay"), ids("needle")).alias("found"), R.loops(ids("hay")).alias("looped"))


SPANS = Literal("id long, query string, hint string, spans string", [(1, "play 'Hey Jude' now", "song", "play|play 'Hey|play 'Hey Jude|play 'Hey Jude' now|Hey|Hey Jude|Hey Jude' now|Jude|Jude' now|now"), (2, "", "x", None)])


@fixture("span_candidates", f"SELECT id, spans FROM {SPANS.sql()}")
def span_candidates(spark: SparkSession, d: str) -> DataFrame:
    return SPANS.frame(spark).select("id", F.array_join(R.spans(F.col("query"), F.col("hint")), "|").alias("spans"))
