"""Tolerant ingest, converters, generated examples and streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions import tools as T
from ..functions.literals import Literal
from ..operators import generate as G
from ..operators import validate as V
from ..registry import fixture, query
from ..session import shared_folder, ship
from ..sources import adapters, arrays, growing, jsonl, publish
from ..streaming import ingest as S
from .corpus import COLLAPSE, table

LINES = Literal("id long, value string", [(1, '{"query":"a"}'), (2, ""), (3, "  "), (4, '{"query":"b"'), (5, "[1]"), (6, "nul")])


@fixture("json_tolerant_scan", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), true), (4, false), (5, true), (6, false)) t(id, ok)")
def json_tolerant_scan(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.mark_lines(LINES.frame(spark)).select("id", "ok")


@query("split_scan", "SELECT CASE WHEN source = 'src3' THEN 'eval' ELSE 'train' END AS part, lang, count(*) AS n FROM documents GROUP BY ALL")
def split_scan(spark: SparkSession, d: str) -> DataFrame:
    """One dataset read as two parts by a predicate on a column."""
    held, rest = jsonl.scan_split(spark, f"{d}/documents.parquet", "source", "src3")
    both = held.select("lang", F.lit("eval").alias("part")).unionByName(rest.select("lang", F.lit("train").alias("part")))
    return both.groupBy("part", "lang").agg(F.count("*").alias("n"))


PROPS = "concat('{\"k\":', json_extract_string(props, '$.k'), '}')"


@query("json_props_canonical", f"SELECT event_id, {PROPS} AS props FROM events")
def json_props_canonical(spark: SparkSession, d: str) -> DataFrame:
    call = F.array(F.struct(F.lit("f").alias("name"), F.col("props").alias("arguments")))
    return table(spark, d, "events").select("event_id", F.regexp_extract(C.dumps(call), r'"arguments":(.*)\}\]$', 1).alias("props"))


def _line(x) -> str:
    return json.dumps(x, ensure_ascii=False)


WEATHER = {"name": "get_weather", "description": "Weather", "parameters": {"type": "object", "properties": {"city": {"type": "str", "items": 1}}, "required": ["city", "gone"]}}
BLOCK = '<tool_call>\n{"name": "get_weather", "arguments": {"city": "Oslo"}}\n</tool_call>'
RAW = {
    "dria": [
        {"type": "single", "conversations": [{"role": "system", "content": "<|functions_schema|>\ndef get_weather(city: str, days: Optional[int] = 1):\n    '''Weather.\n\n    :param city: Where\n    '''\n<|end_functions_schema|>"}, {"role": "user", "content": '"weather in Oslo"'}, {"role": "assistant", "content": "```python\nget_weather(city='Oslo')\n```"}]},
        {"type": "single", "conversations": [{"role": "system", "content": "def f(a): pass"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "f(1)"}]},
    ],
    "hermes": [
        {"tools": _line([{"function": WEATHER}]), "conversations": [{"from": "human", "value": "weather in Oslo "}, {"from": "gpt", "value": BLOCK}], "category": "w"},
        {"tools": _line([WEATHER]), "conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": BLOCK.replace("get_weather", "other")}]},
    ],
    "bitagent": [
        {"tools": _line([{"name": "get_weather", "description": "", "arguments": {"city": {"type": "str", "required": True}}}]), "conversation": _line([{"role": "user", "content": "weather in Oslo"}, {"role": "tool call", "content": {"name": "get_weather", "arguments": {"city": "Oslo"}}}])},
        {"tools": "[", "conversation": "[]"},
    ],
    "dolci": [
        {"messages": [{"role": "system", "functions": _line([WEATHER])}, {"role": "user", "content": "weather in Oslo"}, {"role": "assistant", "function_calls": 'get_weather(city="Oslo")'}], "dataset_source": "x" * 50},
        {"messages": [{"role": "system", "functions": "def a_b(x):\n  pass"}, {"role": "user", "content": "q"}, {"role": "assistant", "function_calls": "a_b(x={1, 2})"}]},
    ],
    "apigen": [
        {"query": "weather in Oslo", "tools": _line([{"name": "get_weather", "parameters": {"city": {"type": "str, optional", "default": ""}, "day": {"type": "int"}}}]), "answers": _line([{"name": "get_weather", "arguments": {"city": "Oslo"}}])},
        {"query": "", "tools": "[]", "answers": "[]"},
    ],
    "glaive": [
        {"conversations": [{"from": "system", "value": "Use { these:\n" + _line(WEATHER) + "\n" + _line(WEATHER)}, {"from": "human", "value": "weather in Oslo"}, {"from": "gpt", "value": "<functioncall> {\"name\": \"get_weather\", \"arguments\": '{\"city\": \"Oslo\"}'} <|endoftext|>"}]},
        {"conversations": [{"from": "system", "value": _line(WEATHER)}, {"from": "human", "value": "tell a joke"}, {"from": "gpt", "value": "I can't."}]},
        {"conversations": [{"from": "system", "value": _line(WEATHER) * 3}, {"from": "human", "value": "tell a joke"}, {"from": "gpt", "value": "I can't."}]},
    ],
    "hermes_reason": [
        {"task": " weather in Oslo ", "tools": _line([{"name": "get_weather", "parameters": {"city": {"type": "string"}}}]), "conversations": [{"from": "gpt", "value": "no"}, {"from": "gpt", "value": "<tool_call>{'name': 'get_weather', 'arguments': {'city': 'Oslo'}}</tool_call>"}]},
        {"task": "", "tools": "[]", "conversations": []},
    ],
    "mobile_actions": [
        {"tools": [{"function": {"name": "get_weather", "parameters": {"type": "OBJECT", "properties": {"city": {"type": "STRING"}, "x": None}, "required": ["city", "x"]}}}], "messages": [{"role": "developer", "content": "Hello\nCurrent date: 2026\nDay of week is Monday"}, {"role": "user", "content": "weather in Oslo"}, {"role": "assistant", "tool_calls": [{"function": {"name": "get_weather", "arguments": '{"city": "Oslo", "x": null}'}}]}]},
    ],
    "seal_tools": [
        {"conversations": [{"from": "human", "value": "api_list = [{'api_name': 'get_weather', 'api_description': '', 'parameters': {'city': {'type': 'str'}}, 'required': ['city']}]\ntask_instruction = \"weather in Oslo\"\nOutput:"}, {"from": "gpt", "value": "[{'api': 'get_weather', 'parameters': {'city': 'Oslo'}}]"}]},
        {"conversations": [{"from": "human", "value": "none"}, {"from": "gpt", "value": "[]"}]},
    ],
}
EXPECTED = Literal(
    "kind string, row_idx long, query string, answers string, required string, split string",
    [
        ("dria", 0, "weather in Oslo", 'get_weather(city="Oslo")', "city", "single"),
        ("hermes", 0, "weather in Oslo", 'get_weather(city="Oslo")', "city", "w"),
        ("bitagent", 0, "weather in Oslo", 'get_weather(city="Oslo")', "city", ""),
        ("dolci", 0, "weather in Oslo", 'get_weather(city="Oslo")', "city", "x" * 40),
        ("apigen", 0, "weather in Oslo", 'get_weather(city="Oslo")', "day", ""),
        ("glaive", 0, "weather in Oslo", 'get_weather(city="Oslo")', "city", "call"),
        ("glaive", 1, "tell a joke", "", "city", "refuse"),
        ("hermes_reason", 0, "weather in Oslo", 'get_weather(city="Oslo")', "city", ""),
        ("mobile_actions", 0, "Current date: 2026 Day of week is Monday\nweather in Oslo", 'get_weather(city="Oslo")', "city", "mobile_actions"),
        ("seal_tools", 0, "weather in Oslo", 'get_weather(city="Oslo")', "city", "seal_tools"),
    ],
)


def converted(spark: SparkSession) -> DataFrame:
    ship(spark)
    out = None
    for source, rows in RAW.items():
        lines = Literal("row_idx long, value string", [(i, _line(r)) for i, r in enumerate(rows)] + [(99, '{"torn": ')]).frame(spark)
        some = adapters.convert(lines, source).withColumn("kind", F.lit(source))
        out = some if out is None else out.unionByName(some)
    return out


@fixture("convert_sources", f"SELECT * FROM {EXPECTED.sql()}")
def convert_sources(spark: SparkSession, d: str) -> DataFrame:
    entry = lambda e: F.concat(e["k"], F.lit("="), C.quoted(e["text"]))
    call = lambda c: F.concat(c["name"], F.lit("("), F.array_join(F.transform(C.entries(c["arguments"]), entry), ", "), F.lit(")"))
    answers = F.array_join(F.transform(C.loads(F.col("answers")), call), ";")
    required = F.array_join(T.parse(F.col("tools"))[0]["required"], ",")
    return converted(spark).select("kind", "row_idx", "query", answers.alias("answers"), required.alias("required"), "split")


@fixture("convert_grounded", f"SELECT kind, row_idx FROM {EXPECTED.sql()}")
def convert_grounded(spark: SparkSession, d: str) -> DataFrame:
    return converted(spark).filter(V.grounded(F.col("query"), C.loads(F.col("answers")))).select("kind", "row_idx")


BFCL_ANSWERS = Literal("row_idx long, id string, ground_truth string", [(0, "a", '[{"f":{"x":[1]}}]'), (1, "a", '[{"f":{"x":[2]}}]')])


@fixture("bfcl_join", """SELECT * FROM (VALUES ('a', 'one' || chr(10) || 'two', '[{"f":{"x":[2]}}]'), ('b', 'alone', '[]')) t(id, query, gt)""")
def bfcl_join(spark: SparkSession, d: str) -> DataFrame:
    text = Literal("id string, q string", [("a", '[[{"role":"user","content":"one"},{"role":"system","content":"no"},{"role":"user","content":"two"}]]'), ("b", '[[{"role":"user","content":"alone"}]]')])
    questions = text.frame(spark).select("id", F.from_json("q", "array<array<struct<role:string,content:string>>>").alias("question"), F.lit("[]").alias("function"))
    return adapters.bfcl(questions, BFCL_ANSWERS.frame(spark), "multiple").select("id", "query", "gt")


ROLL = "CAST('0x' || substr(md5(concat('3|', i)), 1, 7) AS BIGINT) / 268435456.0"


@fixture("generated_mix", f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN {ROLL} < 0.15 THEN 'refuse' WHEN {ROLL} < 0.4 THEN 'two' ELSE 'one' END AS kind FROM range(0, 2000) t(i)) GROUP BY kind")
def generated_mix(spark: SparkSession, d: str) -> DataFrame:
    return G.generate(spark, 2000, 3).groupBy("kind").agg(F.count("*").alias("n"))


U = lambda seed, key="i": f"(CAST('0x' || substr(md5(concat('{seed}|', {key})), 1, 7) AS BIGINT) / 268435456.0)"
MADE = lambda split, seed: f"""SELECT '{split}' AS split, count(*) AS n, CAST(sum(CASE WHEN {U(seed)} < 0.15 THEN 0 WHEN {U(seed)} < 0.4 THEN 2 ELSE 1 END) AS BIGINT) AS n_calls,
CAST(sum(3 + floor({U(seed + 4)} * 4)) AS BIGINT) AS n_distractors, CAST(0 AS BIGINT) AS unknown_calls, CAST(0 AS BIGINT) AS ungrounded FROM range(0, 300) t(i)"""  # noqa: E731


@fixture("generated_valid", f"{MADE('train', 5)} UNION ALL {MADE('ood', 6)}")
def generated_valid(spark: SparkSession, d: str) -> DataFrame:
    """Generated calls and distractors are as many as drawn; calls use their catalog, and the query states what they hold."""
    rows = G.generate(spark, 300, 5).unionByName(G.generate(spark, 300, 6, ood=True))
    tools, answers = T.parse(F.col("tools")), C.loads(F.col("answers"))
    others = F.size(tools) - F.size(F.array_distinct(C.names(answers)))
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), F.sum(F.size(answers)).alias("n_calls"), F.sum(others).alias("n_distractors"), F.count_if(~V.well_formed(tools, answers)).alias("unknown_calls"), F.count_if(~V.grounded(F.col("query"), answers)).alias("ungrounded")
    )


@fixture("augmented_shares", f"SELECT count(*) FILTER ({U(11)} < 0.4) AS topped_up, count(*) FILTER ({U(21)} < 0.35) AS dated, CAST(0 AS BIGINT) AS broken_calls FROM range(0, 2000) t(i)")
def augmented_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = G.generate(spark, 2000, 3).withColumn("tools", F.from_json("tools", "array<string>"))
    out = G.augment(rows, "row")
    text = F.concat(F.lit("["), F.array_join("tools", ","), F.lit("]"))
    return out.agg(F.count_if(F.size("tools") >= 10).alias("topped_up"), F.count_if(F.startswith("query", F.lit(G.PREAMBLE))).alias("dated"), F.count_if(~V.well_formed(T.parse(text), C.loads(F.col("answers")))).alias("broken_calls"))


@fixture("catalog_tools", "SELECT * FROM (VALUES ('train', CAST(17 AS BIGINT)), ('ood', 5)) t(split, n)")
def catalog_tools(spark: SparkSession, d: str) -> DataFrame:
    rows = Literal("i int, name string", [(i, t[0]) for i, t in enumerate(G.TOOLS)]).frame(spark)
    return rows.groupBy(F.when(F.col("i") < G.N_TRAIN, "train").otherwise("ood").alias("split")).agg(F.count("*").alias("n"))


@query("published_versions", "SELECT 1 AS version, source, doc_id, n_chars FROM documents UNION ALL SELECT 2, source, doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src1'")
def published_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents published twice: the first version whole, of the second the rows of one split."""
    docs = table(spark, d, "documents")
    top = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    jsonl.publish_packed(docs.select("source", "doc_id", "n_chars"), top, "source")
    jsonl.publish_packed(docs.filter("lang = 'en'").select("source", "doc_id", "n_chars"), top, "source")
    first = publish.read_published(spark, top, 1).select(F.lit(1).alias("version"), "source", "doc_id", "n_chars")
    second = jsonl.read_packed(spark, top, "src1", column="source").select(F.lit(2).alias("version"), F.lit("src1").alias("source"), "doc_id", "n_chars")
    return first.unionByName(second)


@query("array_elements", "SELECT doc_id, concat(lang, ',', source) AS tags, md5(text) AS digest, CAST(length(text) AS BIGINT) AS n FROM documents")
def array_elements(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON arrays, one array a file, and read back by blocks."""
    top = f"{shared_folder(spark)}/arrays-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    arrays.write_arrays(docs.select(F.to_json(F.struct("doc_id", F.array("lang", "source").alias("tags"), "text")).alias("value")), top)
    e = F.from_json("value", "doc_id long, tags array<string>, text string").alias("e")
    return arrays.read_array(spark, top).select(e).select("e.doc_id", F.array_join("e.tags", ",").alias("tags"), F.md5("e.text").alias("digest"), F.length("e.text").cast("long").alias("n"))


@query("stream_dedup", f"SELECT DISTINCT sha256({COLLAPSE.format('text')}) AS key FROM documents")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The documents table as a file stream, repeats left out; drained by one trigger."""
    from ..functions.text import collapse

    schema = table(spark, d, "documents").schema
    folder, name = (d, "documents.parquet")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_one_folder(spark, f"{folder}/{name}"))
    new = S.stream_new(stream).select(F.sha2(collapse(F.col("text")), 256).alias("key"))
    return S.drain(new, "loomwright_stream_dedup")


def _one_folder(spark: SparkSession, path: str) -> str:
    """A path that a file stream can watch: a glob that matches the table's file or folder."""
    return path[:-1] + "?"


@query("stream_growing", "SELECT event_id, 1 AS n, event_type AS kind FROM events")
def stream_growing(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines in files that grow between two starts of one stream: each arrives once."""
    ship(spark)
    top = f"{shared_folder(spark)}/growing-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(top).getFileSystem(spark._jsc.hadoopConfiguration())
    events = table(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("value"), (F.col("event_id") % 8).alias("file"))
    half = events.agg(F.max("event_id")).collect()[0][0] // 2
    folders = []
    for k, some in enumerate((events.filter(F.col("event_id") <= half), events)):
        # The second writing holds the same lines and more; its files take the place of the first.
        # Sorted by file first: the writer would sort by it anew and so undo an order by number alone.
        some.repartition(8, "file").sortWithinPartitions("file", "event_id").select("value", "file").write.partitionBy("file").text(f"{top}/{k}")
        for status in files.globStatus(hadoop(f"{top}/{k}/file=*/part-*")):
            own = hadoop(f"{top}/in/{status.getPath().getParent().getName()}.jsonl")
            files.mkdirs(own.getParent())
            files.delete(own, False)
            files.rename(status.getPath(), own)
        stream = growing.stream_growing(spark, f"{top}/in").select(F.from_json("value", "event_id long, event_type string").alias("e")).select("e.*")

        def write(batch: DataFrame, number: int, k: int = k) -> None:
            batch.write.mode("overwrite").parquet(f"{top}/out/{k}/{number}")

        running = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
        try:
            running.awaitTermination()
        finally:
            running.stop()
        folders.append(f"{top}/out/{k}")
    out = spark.read.schema("event_id long, event_type string").parquet(*[f"{f}/*" for f in folders])
    return out.groupBy("event_id").agg(F.count("*").alias("n"), F.min("event_type").alias("kind"))


@query("stream_spend", "SELECT event_type AS account, count(*) AS n, round(sum((event_id % 900) * 0.14e-6 + (event_id % 300) * 0.28e-6), 6) AS cost FROM events GROUP BY event_type")
def stream_spend(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(_one_folder(spark, f"{d}/events.parquet")).withColumns({"p": F.col("event_id") % 900, "c": F.col("event_id") % 300})
    out = S.drain(S.stream_spending(stream, "event_type", "p", "c", 0.1), "loomwright_stream_spend", "update")
    return out.groupBy("account").agg(F.sum("n").alias("n"), F.round(F.max("cost"), 6).alias("cost"))


COST = "(event_id % 900) * 14 + (event_id % 300) * 28"


@query("stream_to_cap", f"SELECT event_id, event_type FROM (SELECT event_id, event_type, sum({COST}) OVER (ORDER BY event_id) AS spent, sum({COST}) OVER () AS total FROM events) WHERE spent <= total * 5 // 8")
def stream_to_cap(spark: SparkSession, d: str) -> DataFrame:
    """Events in four deliveries, by number, through a query that is started again for each; the cap over all event types falls into the third. Costs are in hundred-millionths of a dollar."""
    events = table(spark, d, "events").select("event_id", "event_type")
    cost = F.expr(COST)
    known = events.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.sum(cost).alias("total")).collect()[0]
    lo, hi, cap = known["lo"] or 0, known["hi"] or 0, (known["total"] or 0) * 5 // 8
    top = f"{shared_folder(spark)}/to-cap-{uuid.uuid4().hex}"
    for k in range(4):
        part = F.floor((F.col("event_id") - lo) * 4 / (hi - lo + 1))
        events.filter(part == k).write.mode("append").parquet(f"{top}/in")
        S.run_to_cap(spark.readStream.schema(events.schema).parquet(f"{top}/in"), "event_id", cost, cap, f"{top}/out")
    return S.capped_rows(spark, f"{top}/out", events.schema)
