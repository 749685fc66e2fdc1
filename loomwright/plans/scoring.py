"""Scores and diagnostics over predictions derived from ``events``, and over small fixed cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions.literals import Literal
from ..operators import scoring as op
from ..registry import fixture, query
from ..session import dealt
from .corpus import table

SAMPLES = 5


def pool_and_gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Gold calls from events (every tenth row refuses, every next has two calls), and five samples of each, altered by a hash."""
    e = dealt(spark.read.parquet(f"{d}/events.parquet")).select(F.col("event_id").alias("row_id"), F.col("event_type").alias("suite"), F.get_json_object("props", "$.k").alias("k"))
    digit = F.conv(F.substring(F.md5(F.concat("sample_id", F.lit("|"), "row_id")), 1, 1), 16, 10).cast("int")
    variant = F.when(digit < 6, "ok").when(digit < 8, "name").when(digit < 11, "value").when(digit < 13, "extra").otherwise("empty")
    call = lambda name, args: F.concat(F.lit('{"name":"'), name, F.lit('","arguments":'), args, F.lit("}"))
    times = lambda one: F.when(F.col("row_id") % 10 == 1, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]"))).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    kept = F.concat(F.lit('{"k":'), "k", F.lit("}"))
    gold = e.withColumn("gold", C.loads(F.when(F.col("row_id") % 10 == 0, "[]").otherwise(times(call(F.col("suite"), kept)))))
    s = e.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1)))).withColumn("v", variant)
    name = F.when(F.col("v") == "name", F.concat("suite", F.lit("_x"))).otherwise(F.col("suite"))
    args = F.when(F.col("v") == "value", '{"k":-1}').when(F.col("v") == "extra", F.concat(F.lit('{"z":1,"k":'), "k", F.lit("}"))).when(F.col("v") == "empty", "{}").otherwise(kept)
    made = F.when((F.col("row_id") % 10 == 0) & (F.col("v") == "ok"), "[]").when((F.col("row_id") % 10 == 2) & (F.col("v") == "empty"), "not json").otherwise(times(call(name, args)))
    return s.select("row_id", "suite", "sample_id", C.loads(made).alias("calls")), gold.select("row_id", "gold")


VARIANTS = f"""p AS (SELECT event_id AS row_id, event_type AS suite, unnest(range(0, {SAMPLES})) AS sample_id, event_id % 10 AS m, json_extract_string(props, '$.k') AS k FROM events),
d AS (SELECT *, CAST('0x' || substr(md5(concat(sample_id, '|', row_id)), 1, 1) AS INTEGER) AS digit FROM p),
v AS (SELECT row_id, suite, sample_id, m, k, CASE WHEN digit < 6 THEN 'ok' WHEN digit < 8 THEN 'name' WHEN digit < 11 THEN 'value' WHEN digit < 13 THEN 'extra' ELSE 'empty' END AS v FROM d),
j AS (SELECT *, v = 'ok' AS hit, m = 2 AND v = 'empty' AS torn, CASE m WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS n_gold FROM v)"""


def greedy(spark: SparkSession, d: str) -> DataFrame:
    pool, gold = pool_and_gold(spark, d)
    return pool.filter("sample_id = 0").withColumnRenamed("calls", "pred").join(gold, "row_id")


SCORES = """count(*) AS n, count(*) FILTER (hit) / count(*) AS accuracy,
count(*) FILTER (CASE WHEN m = 0 THEN v = 'ok' ELSE v <> 'name' AND NOT torn END) / count(*) AS name_acc,
count(*) FILTER (NOT torn) / count(*) AS well_formed, count(*) FILTER (NOT torn AND NOT (m = 0 AND v = 'ok')) / count(*) AS non_empty,
coalesce(count(*) FILTER (hit AND n_gold = 1) / nullif(count(*) FILTER (n_gold = 1), 0), 0) AS one_call,
coalesce(count(*) FILTER (hit AND n_gold = 2) / nullif(count(*) FILTER (n_gold = 2), 0), 0) AS two_plus,
coalesce(count(*) FILTER (hit AND n_gold = 0) / nullif(count(*) FILTER (n_gold = 0), 0), 0) AS refuse,
count(*) FILTER (n_gold = 1) AS n_one, count(*) FILTER (n_gold = 2) AS n_two_plus, count(*) FILTER (n_gold = 0) AS n_refuse"""


@query("score_strict", f"WITH {VARIANTS} SELECT suite, {SCORES} FROM j WHERE sample_id = 0 GROUP BY suite")
def score_strict(spark: SparkSession, d: str) -> DataFrame:
    return op.score_table(greedy(spark, d), "suite")


@query("score_overall", f"WITH {VARIANTS} SELECT {SCORES} FROM j WHERE sample_id = 0")
def score_overall(spark: SparkSession, d: str) -> DataFrame:
    return op.score_table(greedy(spark, d))


def _categories(spark: SparkSession, d: str) -> DataFrame:
    rows = greedy(spark, d)
    return op.category_accuracy(rows, "suite", C.strict_equal(F.col("pred"), F.col("gold")), F.col("row_id") % 7 == 3)


CATEGORY = f"WITH {VARIANTS}, c AS (SELECT suite, count(*) AS n, count(*) FILTER (row_id % 7 = 3) AS over, 100.0 * count(*) FILTER (hit AND row_id % 7 <> 3) / count(*) AS accuracy FROM j WHERE sample_id = 0 GROUP BY suite)"


@query("category_accuracy", f"{CATEGORY} SELECT suite, n, over, accuracy FROM c")
def category_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _categories(spark, d)


@query("score_macro_mean", f"{CATEGORY} SELECT round(avg(accuracy), 6) AS macro_mean FROM c")
def score_macro_mean(spark: SparkSession, d: str) -> DataFrame:
    return op.macro_mean(_categories(spark, d), "accuracy").select(F.round("macro_mean", 6).alias("macro_mean"))


@query(
    "failure_buckets",
    f"""WITH {VARIANTS} SELECT CAST(n_gold AS INTEGER) AS n_gold, count(*) AS n, count(*) FILTER (hit) AS exact, count(*) FILTER (CASE WHEN m = 0 THEN hit ELSE NOT torn END) AS count_ok,
count(*) FILTER (CASE WHEN m = 0 THEN hit ELSE v <> 'name' AND NOT torn END) AS multiset_ok, count(*) FILTER (CASE WHEN m = 0 THEN hit ELSE v <> 'name' AND NOT torn END) AS seq_ok,
count(*) FILTER (hit OR v = 'name' AND m <> 0) AS oracle_exact FROM j WHERE sample_id = 0 GROUP BY n_gold""",
)
def failure_buckets(spark: SparkSession, d: str) -> DataFrame:
    return op.failure_table(greedy(spark, d))


@query(
    "argument_errors",
    f"""WITH {VARIANTS}, k AS (SELECT n_gold, unnest(CASE v WHEN 'extra' THEN ['key_set', 'missing=0 extra=1'] WHEN 'empty' THEN ['key_set', 'missing=1 extra=0'] WHEN 'value' THEN ['values_only'] END) AS kind
FROM j WHERE sample_id = 0 AND n_gold > 0 AND NOT torn)
SELECT kind, CAST(sum(n_gold) AS BIGINT) AS n FROM k GROUP BY kind
UNION ALL SELECT 'bad_value', CAST(sum(n_gold) AS BIGINT) FROM j WHERE sample_id = 0 AND n_gold > 0 AND v = 'value' HAVING sum(n_gold) > 0""",
)
def argument_errors(spark: SparkSession, d: str) -> DataFrame:
    return op.argument_errors(greedy(spark, d))


@query(
    "passk_curve",
    f"""WITH {VARIANTS}, f AS (SELECT row_id, min(sample_id) FILTER (hit) AS first FROM j GROUP BY row_id), c AS (SELECT CAST(k AS INTEGER) AS j, count(*) FILTER (first <= k) AS hits, count(*) AS n FROM f, range(0, {SAMPLES}) t(k) GROUP BY k)
SELECT j, hits, hits / n AS share, hits / n - first_value(hits / n) OVER (ORDER BY j) AS headroom, hits / n - first_value(hits / n) OVER (ORDER BY j) > 0.1 AS search_helps FROM c""",
)
def passk_curve(spark: SparkSession, d: str) -> DataFrame:
    return op.pass_at_k(*pool_and_gold(spark, d), SAMPLES - 1)


@query("decoder_agreement", f"WITH {VARIANTS}, h AS (SELECT row_id, bool_or(hit) FILTER (sample_id = 0) AS a, bool_or(hit) FILTER (sample_id = 1) AS b FROM j GROUP BY row_id) SELECT count(*) AS n, count(*) FILTER (a AND b) AS both, count(*) FILTER (a OR b) AS either, count(*) FILTER (a AND NOT b) AS fixed, count(*) FILTER (b AND NOT a) AS broke, (count(*) FILTER (a) - count(*) FILTER (b)) / count(*) AS delta, (count(*) FILTER (a) - count(*) FILTER (b)) / count(*) > 0.02 AS drafts_pay FROM h")
def decoder_agreement(spark: SparkSession, d: str) -> DataFrame:
    pool, gold = pool_and_gold(spark, d)
    given = pool.filter("sample_id < 2").select("row_id", "sample_id", C.loose(F.col("calls")).alias("given"))
    hit = F.coalesce(F.col("given") == F.col("right"), F.lit(False))
    rows = given.join(gold.select("row_id", C.loose(F.col("gold")).alias("right")), "row_id").groupBy("row_id").agg(F.bool_or(hit & (F.col("sample_id") == 0)).alias("a"), F.bool_or(hit & (F.col("sample_id") == 1)).alias("b"))
    return op.agreement(rows, F.col("a"), F.col("b"))


FIELDS = f"""WITH {VARIANTS}, r AS (SELECT row_id, n_gold, coalesce(bool_or(hit) FILTER (sample_id = 0), false) AS greedy, bool_or(v <> 'name' AND NOT torn) AS name_avail, bool_or(v IN ('ok', 'value')) AS keyset_avail, bool_or(v IN ('ok', 'extra')) AS fields_avail FROM j WHERE n_gold > 0 GROUP BY row_id, n_gold),
a AS (SELECT *, name_avail AND keyset_avail AND fields_avail AS assembled FROM r)"""


@query("field_oracle", f"{FIELDS} SELECT row_id, CAST(unnest(range(0, n_gold)) AS INTEGER) AS pos, greedy, name_avail, keyset_avail, fields_avail, assembled FROM a")
def field_oracle(spark: SparkSession, d: str) -> DataFrame:
    return op.field_oracle(*pool_and_gold(spark, d))


@query("field_oracle_summary", f"{FIELDS} SELECT count(*) AS n_rows, CAST(sum(n_gold) AS BIGINT) AS n_calls, " + ", ".join(f"CAST(coalesce(sum(n_gold) FILTER ({c}), 0) AS BIGINT) AS {c}" for c in ("greedy", "name_avail", "keyset_avail", "fields_avail", "assembled")) + ", count(*) FILTER (assembled) AS assembled_rows FROM a")
def field_oracle_summary(spark: SparkSession, d: str) -> DataFrame:
    return op.field_summary(op.field_oracle(*pool_and_gold(spark, d)))


@query(
    "rerank_keyset",
    f"""WITH {VARIANTS}, c AS (SELECT row_id, suite, m, sample_id, k, v, CASE WHEN m = 0 AND v = 'ok' OR torn THEN 0 WHEN m = 1 THEN 2 ELSE 1 END AS n_calls, v = 'name' AS off,
  CASE v WHEN 'extra' THEN 'k,z' WHEN 'empty' THEN '' ELSE 'k' END AS keys, CASE v WHEN 'value' THEN '-1' ELSE k END AS kv FROM j),
g AS (SELECT * FROM c WHERE sample_id = 0 AND n_calls > 0),
pairs AS (SELECT g.row_id, c.keys, c.kv, c.sample_id FROM g JOIN c ON g.row_id = c.row_id AND g.off = c.off AND c.n_calls > 0),
sets AS (SELECT row_id, keys, count(*) AS n, min(sample_id) AS s, sum(count(*)) OVER (PARTITION BY row_id) AS total FROM pairs GROUP BY row_id, keys),
top AS (SELECT row_id, keys, n, total FROM sets QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, s) = 1),
vals AS (SELECT row_id, kv FROM (SELECT row_id, kv, count(*) AS n, min(sample_id) AS s FROM pairs WHERE keys <> '' GROUP BY row_id, kv) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, s) = 1),
chosen AS (SELECT g.row_id, g.n_calls, g.suite || CASE WHEN g.off THEN '_x' ELSE '' END AS name, CASE WHEN top.keys <> g.keys AND 2 * top.n > total THEN top.keys ELSE g.keys END AS keys, CASE WHEN g.keys = '' THEN vals.kv ELSE g.kv END AS kv
  FROM g JOIN top USING (row_id) LEFT JOIN vals USING (row_id))
SELECT row_id, CAST(unnest(range(0, n_calls)) AS INTEGER) AS pos, name, CASE keys WHEN 'k' THEN 'k=' || kv WHEN 'k,z' THEN 'k=' || kv || ',z=1' ELSE '' END AS arguments FROM chosen""",
)
def rerank_keyset(spark: SparkSession, d: str) -> DataFrame:
    out = op.rerank(pool_and_gold(spark, d)[0])
    return out.select("row_id", "pos", "name", F.array_join(F.transform("entries", lambda e: F.concat_ws("=", e["k"], e["text"])), ",").alias("arguments"))


REWARDS = f"""{VARIANTS}, r AS (SELECT row_id, CAST(sample_id AS INTEGER) AS sample_id, CASE WHEN m = 0 THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END WHEN hit THEN 1.0 ELSE 0.0 END AS reward FROM j)"""


@query("sample_rewards", f"WITH {REWARDS} SELECT row_id, sample_id, CAST(reward AS DOUBLE) AS reward FROM r")
def sample_rewards(spark: SparkSession, d: str) -> DataFrame:
    pool, gold = pool_and_gold(spark, d)
    # Both sides are reduced once, before the join, in which gold meets every sample.
    given = pool.select("row_id", "sample_id", C.loose(F.col("calls")).alias("p"))
    right = gold.select("row_id", C.loose(F.col("gold")).alias("g"))
    return given.join(right, "row_id").select("row_id", "sample_id", op.loose_reward(F.col("p"), F.col("g")).alias("reward"))


@query("leave_one_out", f"WITH {REWARDS} SELECT row_id, sample_id, CAST(reward AS DOUBLE) AS reward, round(CAST(reward - (sum(reward) OVER w - reward) / ({SAMPLES} - 1) AS DOUBLE), 6) AS advantage FROM r WINDOW w AS (PARTITION BY row_id) QUALIFY max(reward) OVER w > min(reward) OVER w")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return op.leave_one_out(sample_rewards(spark, d)).withColumn("advantage", F.round("advantage", 6))


CASES = Literal(
    "id long, a string, b string, strict boolean, loose boolean",
    [
        (1, '[{"name":"f","arguments":{"z":1,"a":"x"}}]', '[{"name":"f","arguments":{"a":"x","z":1}}]', True, True),
        (2, '[{"name":"f","arguments":{"a":1}}]', '[{"name":"f","arguments":{"a":1.0}}]', False, True),
        (3, '[{"name":"f","arguments":{"a":1}}]', '[{"name":"f","arguments":{"a":"1"}}]', False, False),
        (4, '[{"name":"f","arguments":{"a":true}}]', '[{"name":"f","arguments":{"a":1}}]', False, True),
        (5, '[{"name":"f","arguments":{"n":{"z":1,"y":2}}}]', '[{"name":"f","arguments":{"n":{"y":2,"z":1}}}]', False, True),
        (6, '[{"name":"f","arguments":{}},{"name":"g","arguments":{}}]', '[{"name":"g","arguments":{}},{"name":"f","arguments":{}}]', False, False),
        (7, "[]", "[]", True, True),
        (8, "[]", "not json", False, False),
        (9, '{"name":"f","arguments":{"a":"é"}}', '[{"name":"f","arguments":"{\\"a\\": \\"é\\"}"}]', True, True),
        (10, '[{"name":"f"}]', '[{"name":"f","arguments":{}}]', True, True),
        (11, '[{"name":"f","arguments":null}]', '[{"name":"f","arguments":{}}]', False, False),
        (12, '[{"no_name":1}]', "[]", False, False),
        (13, '[{"name":"f","arguments":{"a":null}}]', '[{"name":"f","arguments":{"a":null}}]', True, True),
        (14, '[{"name":"f","arguments":{"a":[1,2]}}]', '[{"name":"f","arguments":{"a":[2,1]}}]', False, False),
    ],
)


@fixture("call_equality", f"SELECT id, strict, loose FROM {CASES.sql()}")
def call_equality(spark: SparkSession, d: str) -> DataFrame:
    a, b = C.loads(F.col("a")), C.loads(F.col("b"))
    return CASES.frame(spark).select("id", C.strict_equal(a, b).alias("strict"), C.loose_equal(a, b).alias("loose"))


DUMPS = Literal(
    "id long, text string, dumped string",
    [
        (1, '[{"name":"f","arguments":{"z":1.50,"a":"x \\"y\\"", "n": {"z":1,"y":2.0}}}]', '[{"name":"f","arguments":{"a":"x \\"y\\"","n":{"z":1,"y":2.0},"z":1.5}}]'),
        (2, '{"name":"é","arguments":{"b":[1, 2.0, "3"],"a":null,"c":false}}', '[{"name":"é","arguments":{"a":null,"b":[1,2.0,"3"],"c":false}}]'),
        (3, "[]", "[]"),
        (4, "[1]", None),
        (5, '"text"', None),
        (6, '[{"name":"f","arguments":"nope"}]', None),
        (7, '[{"name":"f","extra":1}]', '[{"name":"f","arguments":{}}]'),
    ],
)


@fixture("json_args_canonical", f"SELECT id, dumped FROM {DUMPS.sql()}")
def json_args_canonical(spark: SparkSession, d: str) -> DataFrame:
    return DUMPS.frame(spark).select("id", C.dumps(C.loads(F.col("text"))).alias("dumped"))


BFCL = Literal(
    "id long, category string, pred string, truth string, ok boolean, gold string",
    [
        (1, "simple_python", '[{"name":"f","arguments":{"a":1}}]', '[{"f":{"a":[1.0]}}]', True, "f a=1.0"),
        (2, "simple_python", '[{"name":"f","arguments":{"a":" x "}}]', '[{"f":{"a":["x","y"],"b":["",2]}}]', True, "f a=x"),
        (3, "multiple", '[{"name":"f","arguments":{"a":"x","c":1}}]', '[{"f":{"a":["x"]}}]', False, "f a=x"),
        (4, "multiple", '[{"name":"f","arguments":{}}]', '[{"f":{"a":["x"]}}]', False, "f a=x"),
        (5, "irrelevance", "[]", "[]", True, ""),
        (6, "live_relevance", '[{"name":"g","arguments":{}}]', "[]", True, ""),
        (7, "live_irrelevance", '[{"name":"g","arguments":{}}]', "[]", False, ""),
        (8, "parallel", '[{"name":"f","arguments":{"a":1}},{"name":"f","arguments":{"a":2}}]', '[{"f":{"a":[1]}},{"f":{"a":[2]}}]', True, "f a=1;f a=2"),
        (9, "parallel", '[{"name":"f","arguments":{"a":2}},{"name":"f","arguments":{"a":1}}]', '[{"f":{"a":[1]}},{"f":{"a":[2]}}]', False, "f a=1;f a=2"),
        (10, "simple_java", '[{"name":"f","arguments":{"a":true}}]', '[{"f":{"a":[true]}}]', True, "f a=true"),
        (11, "simple_java", '[{"name":"f","arguments":{"a":"1"}}]', '[{"f":{"a":[1]}}]', False, "f a=1"),
        (12, "live_simple", '[{"name":"f","arguments":{"a":{"x":1,"y":[2]}}}]', '[{"f":{"a":[{"y":[2],"x":1}]}}]', True, 'f a={"y":[2],"x":1}'),
    ],
)


@fixture("bfcl_score", f"SELECT id, ok FROM {BFCL.sql()}")
def bfcl_score(spark: SparkSession, d: str) -> DataFrame:
    return BFCL.frame(spark).select("id", op.row_accepted(F.col("category"), C.loads(F.col("pred")), F.col("truth")).alias("ok"))


@fixture("bfcl_representative", f"SELECT id, gold FROM {BFCL.sql()}")
def bfcl_representative(spark: SparkSession, d: str) -> DataFrame:
    line = lambda c: F.concat_ws(" ", c["name"], F.array_join(F.transform(F.map_entries(c["arguments"]), lambda kv: F.concat_ws("=", kv["key"], kv["value"])), " "))
    return BFCL.frame(spark).select("id", F.array_join(F.transform(op.representative(F.col("truth")), line), ";").alias("gold"))


@fixture("bfcl_category_mean", f"SELECT round(avg(a), 6) AS macro_mean FROM (SELECT category, 100.0 * count(*) FILTER (ok) / count(*) AS a FROM {BFCL.sql()} GROUP BY category)")
def bfcl_category_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = BFCL.frame(spark).withColumn("hit", op.row_accepted(F.col("category"), C.loads(F.col("pred")), F.col("truth")))
    return op.macro_mean(op.category_accuracy(rows, "category", F.col("hit"), F.lit(False)), "accuracy").select(F.round("macro_mean", 6).alias("macro_mean"))


SHIFTED = "SELECT event_type AS suite, event_id % 3 AS r, json_extract_string(props, '$.k') AS k FROM events"


@query(
    "score_predictor",
    f"""WITH p AS ({SHIFTED}) SELECT suite, count(*) AS n, count(*) FILTER (r = 0) / count(*) AS accuracy, count(*) FILTER (r < 2) / count(*) AS name_acc, count(*) FILTER (r < 2) / count(*) AS well_formed,
count(*) FILTER (r < 2) / count(*) AS non_empty, count(*) FILTER (r = 0) / count(*) AS one_call, CAST(0 AS DOUBLE) AS two_plus, CAST(0 AS DOUBLE) AS refuse, count(*) AS n_one, CAST(0 AS BIGINT) AS n_two_plus, CAST(0 AS BIGINT) AS n_refuse FROM p GROUP BY suite""",
)
def score_predictor(spark: SparkSession, d: str) -> DataFrame:
    """A predictor that reads the query of every event: right, with another value, or torn by the remainder of the event's number."""
    e = table(spark, d, "events").select(F.col("event_type").alias("suite"), (F.col("event_id") % 3).alias("r"), F.get_json_object("props", "$.k").alias("k"))
    rows = e.select("suite", "r", F.concat(F.lit("run "), "suite", F.lit(" with "), "k").alias("query"), F.lit("[]").alias("tools"), F.concat(F.lit('[{"name":"'), "suite", F.lit('","arguments":{"k":'), "k", F.lit("}}]")).alias("answers"))

    def predict(rows: DataFrame) -> DataFrame:
        said = F.split("query", " ")
        value = F.when(F.col("r") == 0, said[3]).otherwise(F.lit("-1"))
        text = F.concat(F.lit('[{"name":"'), said[1], F.lit('","arguments":{"k":'), value, F.lit("}}]"))
        return rows.withColumn("pred", C.loads(F.when(F.col("r") < 2, text).otherwise(F.substring(text, 1, 9))))

    return op.score_predictor(rows, predict, "suite")


@query("max_calls_ab", f"WITH {VARIANTS} SELECT cap, count(*) AS n, count(*) FILTER (hit AND (n_gold <= cap)) AS exact FROM j, (VALUES (1), (4)) t(cap) WHERE sample_id = 0 GROUP BY cap")
def max_calls_ab(spark: SparkSession, d: str) -> DataFrame:
    caps = F.explode(F.array(F.lit(1), F.lit(4)))
    rows = greedy(spark, d).withColumn("cap", caps).withColumn("pred", F.slice("pred", F.lit(1), F.col("cap")))
    return rows.groupBy("cap").agg(F.count("*").alias("n"), F.count_if(C.strict_equal(F.col("pred"), F.col("gold"))).alias("exact"))
