"""Eight raw corpora, a benchmark and packed sequences written from whole tables; the SQL derives each result from the tables' values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tools as T
from ..operators import tokenizer as K
from ..registry import query
from ..session import ship
from ..sources import adapters
from .corpus import table

#: What every raw row is made of; ``fn`` is the tool that should be called.
PARTS = "p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size AS size, p_type AS kind, CAST(p_retailprice AS INTEGER) AS price, concat('find_', lower(p_type)) AS fn FROM part)"
SHOWN = "array<struct<name:string,parameters:struct<properties:map<string,struct<type:string>>,required:array<string>>>>"


def parts(spark: SparkSession, d: str) -> DataFrame:
    columns = ["p_partkey AS id", "p_name AS name", "p_brand AS brand", "p_size AS size", "p_type AS kind", "CAST(round(p_retailprice) AS INT) AS price", "concat('find_', lower(p_type)) AS fn"]
    return table(spark, d, "part").selectExpr(*columns)


def fill(template: str) -> Column:
    """A text with ``<column>`` slots; JSON and Python braces stand for themselves."""
    out, rest = [], template
    while rest:
        before, _, after = rest.partition("<")
        name, closed, tail = after.partition(">")
        if closed and name in ("id", "name", "brand", "size", "kind", "price", "fn"):
            out += [F.lit(before), F.col(name).cast("string")]
            rest = tail
        else:
            kept = rest[: len(before) + 1]
            out.append(F.lit(kept))
            rest = rest[len(kept) :]
    return F.concat(*out)


def turns(by: str, what: str, *said: tuple[Column | str, Column]) -> Column:
    return F.array(*[F.struct((F.lit(who) if isinstance(who, str) else who).alias(by), text.alias(what)) for who, text in said])


def examples(spark: SparkSession, d: str, source: str, **fields: Column) -> DataFrame:
    """One raw JSON line of ``source`` for every part, converted; with the first tool's parameters, their types and which are required."""
    ship(spark)
    lines = parts(spark, d).select(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("value"), F.col("id").alias("row_idx"))
    first = F.from_json("tools", SHOWN)[0]
    types = F.array_join(F.transform(F.map_entries(first["parameters"]["properties"]), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["type"])), ",")
    shown = adapters.convert(lines, source)
    return shown.select("row_idx", "query", "answers", "split", first["name"].alias("tool"), types.alias("types"), F.array_join(first["parameters"]["required"], ",").alias("required"))


def expected(query: str, calls: str, split: str, types: str, required: str, where: str) -> str:
    return f"WITH {PARTS} SELECT id AS row_idx, {query} AS query, concat('[', {calls}, ']') AS answers, {split} AS split, fn AS tool, {types} AS types, {required} AS required FROM p WHERE {where}"


def call(arguments: str, name: str = "fn") -> str:
    """A compact call as SQL; ``arguments`` are SQL, too."""
    return f"""concat('{{"name":"', {name}, '","arguments":{{', {arguments}, '}}}}')"""


NAMED = """'"name":"', name, '"'"""
SIZED = f"""{NAMED}, ',"size":', size"""
TURNED = f"""'"size":', size, ',', {NAMED}"""
BUY = call("""'"price":', price""", "'buy'")
FENCED = "```python\n{}\n```"


@query("convert_dria", expected("concat('find ', name)", f"CASE WHEN size <= 5 THEN concat({call(NAMED)}, ',', {call(TURNED)}) ELSE {call(SIZED)} END", "kind", "'name:string,size:integer,tags:array,more:object,other:string'", "'name'", "size <= 40"))
def convert_dria(spark: SparkSession, d: str) -> DataFrame:
    """Python definitions and code; small parts have two calls, one inside a list; large ones a positional argument, which drops the row."""
    schema = fill("<|functions_schema|>\ndef <fn>(name: str, size: Optional[int] = <size>, tags: List[str] = [], more: Dict[str, int] = {}, other: set = None):\n    '''Find <name>.\n\n    :param name: Such as <name>\n    '''\n<|end_functions_schema|>")
    code = F.when(F.col("size") <= 5, fill(FENCED.format("x = [<fn>(name='<name>')]\n<fn>(size=<size>, name='<name>')"))).when(F.col("size") <= 40, fill("<fn>(name='<name>', size=<size>)")).otherwise(fill(FENCED.format("<fn>('<name>')")))
    return examples(spark, d, "dria", type=F.col("kind"), conversations=turns("role", "content", ("system", schema), ("user", fill('"find <name>"')), ("assistant", code)))


@query("convert_hermes", expected("name", f"CASE WHEN price > 1000 THEN concat({call(SIZED)}, ',', {BUY}) ELSE {call(SIZED)} END", "brand", "'name:string,size:integer'", "'name'", "size <= 40"))
def convert_hermes(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of calls; dear parts are bought, too; for large parts one block names an unknown tool."""
    tools = fill('[{"function":{"name":"<fn>","parameters":{"type":"object","properties":{"name":{"type":"string"},"size":{"type":"integer"}},"required":["name"]}}},{"name":"buy"}]')
    block = fill('I see.<tool_call>\n{"arguments": {"name": "<name>", "size": <size>}, "name": "<fn>"}\n</tool_call>')
    block = F.concat(block, F.when(F.col("price") > 1000, fill('<tool_call>{"name":"buy","arguments":{"price":<price>}}</tool_call>')).otherwise(F.lit("")))
    block = F.concat(block, F.when(F.col("size") > 40, fill('<tool_call>{"name":"<brand>","arguments":{}}</tool_call>')).otherwise(F.lit("")))
    return examples(spark, d, "hermes", tools=tools, category=F.col("brand"), conversations=turns("from", "value", ("human", fill(" <name> ")), ("gpt", block), ("gpt", F.lit("done"))))


@query("convert_bitagent", expected("concat(name, ' ', brand)", call(SIZED), "''", "'name:string,size:integer,note:string'", "CASE WHEN size > 20 THEN 'name,size' ELSE 'name' END", "size > 5"))
def convert_bitagent(spark: SparkSession, d: str) -> DataFrame:
    """Lists as JSON text with a flag on each required parameter; the call of small parts is no object."""
    tools = F.concat(fill('[{"name":"<fn>","arguments":{"name":{"type":"str","required":true},"size":{"type":"int","required":'), (F.col("size") > 20).cast("string"), F.lit('},"note":null}}]'))
    content = F.when(F.col("size") > 5, fill('{"name":"<fn>","arguments":{"name":"<name>","size":<size>}}')).otherwise(fill('"<fn>"'))
    conversation = F.concat(fill('[{"role":"user","content":"<name> <brand>"},{"role":"tool call","content":'), content, F.lit("}]"))
    return examples(spark, d, "bitagent", tools=tools, conversation=conversation)


@query("convert_dolci", expected("concat('get ', name)", f"CASE WHEN price > 1000 THEN concat({call(SIZED)}, ',', {call(NAMED)}) ELSE {call(SIZED)} END", "substr(repeat(concat(name, ' '), 12), 1, 40)", "'name:string,size:integer'", "CASE WHEN size <= 25 THEN 'size,name' ELSE 'name' END", "size <= 45"))
def convert_dolci(spark: SparkSession, d: str) -> DataFrame:
    """Tools as JSON for small parts, else as Python definitions; a call a line; a set as an argument drops the row."""
    listed = fill('[{"name":"<fn>","parameters":{"properties":{"name":{"type":"STR","items":{}},"size":{"type":"int"}},"required":["size","gone","name"]}}]')
    functions = F.when(F.col("size") <= 25, listed).otherwise(fill("def <fn>(name: str, size: int = 1):\n  pass"))
    lines = F.concat(fill('<fn>(name="<name>", size=<size>)'), F.when(F.col("price") > 1000, fill('\n\n  <fn>(name="<name>")\n')).otherwise(F.lit("")), F.when(F.col("size") > 45, fill("\n<fn>(name={<size>})")).otherwise(F.lit("")))
    said = F.array(
        F.struct(F.lit("system").alias("role"), functions.alias("functions"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("function_calls")),
        F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("functions"), fill("get <name>").alias("content"), F.lit(None).cast("string").alias("function_calls")),
        F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("functions"), F.lit(None).cast("string").alias("content"), lines.alias("function_calls")),
    )
    return examples(spark, d, "dolci", messages=said, dataset_source=F.repeat(fill("<name> "), 12))


@query(
    "convert_glaive",
    expected("concat('find ', name)", f"CASE WHEN size > 5 THEN {call(SIZED)} ELSE '' END", "CASE WHEN size > 5 THEN 'call' ELSE 'refuse' END", "'name:string,size:integer'", "'name'", "size <= 5 OR size > 10")
    + f" QUALIFY split = 'call' OR row_number() OVER (PARTITION BY split ORDER BY row_idx) <= {adapters.MOST_REFUSALS}",
)
def convert_glaive(spark: SparkSession, d: str) -> DataFrame:
    """Tools as objects in running text; small parts are refused, up to the cap in order; where three tools were offered a refusal is dropped."""
    one = '{"name":"<fn>","parameters":{"properties":{"name":{"type":"string","default":"x"},"size":{"type":"int"}},"required":["name"]}}'
    system = F.concat(fill("Use {these} for <name>: " + one), F.when(F.col("size").between(6, 10), fill(f" {one}\n{one}")).otherwise(F.lit("")))
    said = F.when(F.col("size") <= 10, fill("There is no <name>.")).otherwise(fill("""<functioncall> {"name": "<fn>", "arguments": '{"name": "<name>", "size": <size>}'} <|endoftext|>"""))
    return examples(spark, d, "glaive", conversations=turns("from", "value", ("system", system), ("human", fill("find <name>")), ("gpt", said)))


@query("convert_hermes_reason", expected("name", call(SIZED), "brand", "'name:string,size:integer'", "'name,size'", "size <= 40"))
def convert_hermes_reason(spark: SparkSession, d: str) -> DataFrame:
    """Flat parameters, all required; the last turn's call is JSON or a Python literal; large parts end without one."""
    tools = fill('[{"name":"<fn>","parameters":{"name":{"type":"str"},"size":{"type":"integer","items":1},"note":"text"}}]')
    made = F.when(F.col("size") % 2 == 0, fill('<tool_call>{"name":"<fn>","arguments":{"name":"<name>","size":<size>}}</tool_call>')).otherwise(fill("<tool_call>{'name': '<fn>', 'arguments': {'name': '<name>', 'size': <size>}}</tool_call>"))
    last = F.when(F.col("size") > 40, F.lit("nothing")).otherwise(made)
    return examples(spark, d, "hermes_reason", task=fill(" <name>\n"), tools=tools, category=F.col("brand"), conversations=turns("from", "value", ("gpt", F.lit('<tool_call>{"name":"no"}</tool_call>')), ("gpt", last)))


@query(
    "convert_mobile_actions",
    expected("CASE WHEN size > 25 THEN concat('Date: ', brand, ' Day of week: ', size, chr(10), name) ELSE name END", f"CASE WHEN price > 1000 THEN concat({call(SIZED)}, ',', {BUY}) ELSE {call(SIZED)} END", "'mobile_actions'", "'name:string,size:integer'", "'size,name'", "true"),
)
def convert_mobile_actions(spark: SparkSession, d: str) -> DataFrame:
    """The developer's lines on dates come before the last request; null specs and arguments go."""
    schema = fill('{"type":"OBJECT","properties":{"name":{"type":"STRING"},"size":{"type":"INTEGER"},"gone":null},"required":["size","gone","name"]}')
    tools = F.concat(fill('[{"function":{"name":"<fn>","parameters":'), schema, F.lit("}}]"))
    context = F.when(F.col("size") > 25, fill("Be brief.\\nDate: <brand>\\nDay of week: <size>\\nGo.")).otherwise(F.lit("Be brief."))
    calls = F.concat(fill('{"function":{"name":"<fn>","arguments":"{\\"name\\": \\"<name>\\", \\"size\\": <size>, \\"gone\\": null}"}}'), F.when(F.col("price") > 1000, fill(',{"function":{"name":"buy","arguments":{"price":<price>}}}')).otherwise(F.lit("")))
    messages = F.concat(F.lit('[{"role":"developer","content":"'), context, fill('"},{"role":"user","content":"earlier"},{"role":"user","content":"<name>"},{"role":"assistant","tool_calls":['), calls, F.lit("]}]"))
    return examples(spark, d, "mobile_actions", tools=tools, messages=messages)


@query("convert_seal_tools", expected("""concat('Find "', name, '" now')""", call(SIZED), "'seal_tools'", "'name:string,size:integer,rows:string'", "'name'", "size <= 40"))
def convert_seal_tools(spark: SparkSession, d: str) -> DataFrame:
    """A catalog and a request as Python literals in one prompt; without a quoted request the row is dropped."""
    catalog = "api_list = [{'api_name': '<fn>', 'api_description': 'of <brand>', 'parameters': {'name': {'type': 'str'}, 'size': {'type': 'int'}, 'rows': {'type': 'list'}}, 'required': ['name', 'gone']}]\n"
    asked = F.when(F.col("size") <= 40, fill('task_instruction = "Find "<name>" now"\nOutput:')).otherwise(fill("task_instruction = <name>\nOutput:"))
    human = F.concat(fill("Format:\n" + catalog), asked)
    return examples(spark, d, "seal_tools", conversations=turns("from", "value", ("human", human), ("gpt", fill("[{'api': '<fn>', 'parameters': {'name': '<name>', 'size': <size>}, 'responses': []}]"))))


@query(
    "bfcl_over_conversations",
    """SELECT CAST(conv_id AS VARCHAR) AS id, trim(coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text) FILTER (role = 'user'), '')) AS query,
CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN concat('[{"reply":{"turn":[', max(turn) FILTER (role = 'assistant'), ']}}]') ELSE '[]' END AS gt FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id""",
)
def bfcl_over_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a question; its truth is the last of those listed for it, if any."""
    rows = table(spark, d, "conversations").filter("conv_id IS NOT NULL").withColumn("id", F.col("conv_id").cast("string"))
    said = F.array_sort(F.collect_list(F.struct("turn", "text", "role")))
    questions = rows.groupBy("id").agg(F.array(F.transform(said, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("question")).withColumn("function", F.lit("[]"))
    answers = rows.filter("role = 'assistant'").select("id", F.col("turn").alias("row_idx"), F.format_string('[{"reply":{"turn":[%d]}}]', "turn").alias("ground_truth"))
    return adapters.bfcl(questions, answers, "multiple").select("id", "query", "gt")


@query(
    "pack_parts",
    f"""WITH {PARTS} SELECT id, CAST(512 AS INTEGER) AS length, concat('buy ', name, ' or find ', brand) AS asked, {call(SIZED)} AS called, fn AS chosen, true AS padded, true AS tagged, true AS spanned FROM p WHERE size <= 40""",
)
def pack_parts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts and calls packed and read back out of the ids; texts with a character that the vocabulary lacks are left out."""
    ship(spark)
    tools = T.parse(fill('[{"name":"buy","parameters":{"type":"object","properties":{"price":{"type":"integer"}},"required":[]}},{"name":"<fn>","parameters":{"type":"object","properties":{"name":{"type":"string"},"size":{"type":"integer"}},"required":["name"]}}]'))
    asked = F.concat(fill("buy <name> or find <brand>"), F.when(F.col("size") > 40, F.lit(" 中")).otherwise(F.lit("")))
    rows = parts(spark, d).select("id", "size", T.prompt(asked, tools).alias("prompt"), fill('[{"name":"<fn>","arguments":{"name":"<name>","size":<size>}}]').alias("call"), F.array(F.lit("buy"), "fn").alias("names"))
    v = K.train(rows.filter("size <= 40").select(F.explode(F.array("prompt", "call")).alias("text")), 500)
    p = K.pack(rows.drop("size"), v, 512)
    text, one = K.decoder(v, p)("ids"), F.col("decisions")[0]
    cand = F.element_at("cands", one["gold"] + 1)
    p = p.withColumns({"text": text, "spanned_text": K.decoder(v, p)(F.slice("ids", cand["s"] + 1, cand["e"] - cand["s"]))})
    begin = F.length("prompt")
    tail = F.slice("ids", F.col("real_len") + 1, 512 - F.col("real_len"))
    tagged = (F.element_at("tags", one["pos"] + 2) == K.NAME) & (F.element_at("tags", one["pos"] + 1) != K.NAME) & (F.size("tags") == 512)
    return p.select(
        "id",
        F.size("ids").alias("length"),
        F.regexp_extract("text", r"(buy [^\n]* or find [^\n<]*)", 1).alias("asked"),
        F.expr("substring(text, length(prompt) + 2, length(text) - length(prompt) - 2)").alias("called"),
        F.element_at("cands", one["gold"] + 1)["name"].alias("chosen"),
        (F.forall(tail, lambda x: x == K.PAD) & (F.element_at("ids", F.col("real_len")) == K.EOS) & (F.substring("text", F.lit(1), begin) == F.col("prompt"))).alias("padded"),
        tagged.alias("tagged"),
        F.contains("spanned_text", F.element_at("cands", one["gold"] + 1)["name"]).alias("spanned"),
    )
