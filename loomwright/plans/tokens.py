"""Pre-tokens, BPE, tags, packing, batches and training statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions import tools as T
from ..functions.literals import Literal
from ..functions.text import nfkc
from ..operators import tokenizer as K
from ..operators import training as tr
from ..registry import fixture, query
from ..session import checkpointed, ship
from .corpus import table
from .scoring import pool_and_gold
from .validation import EXAMPLES, LIGHTS

PIECES = r"""[{}\[\],:"]|\n|[^\S\n]+|[^{}\[\],:"\s]+"""


@query("pretokenize_counts", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{PIECES}')) AS INTEGER) AS n, length(array_to_string(regexp_extract_all(text, '{PIECES}'), '')) = length(text) AS lossless FROM documents")
def pretokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    p = K.pieces(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(p).alias("n"), (F.array_join(p, "") == F.col("text")).alias("lossless"))


COUNTS = f"counts AS (SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{PIECES}')) AS piece FROM documents) GROUP BY piece)"


@query("pair_counts", rf"WITH {COUNTS}, pairs AS (SELECT unnest(list_transform(range(1, length(piece)), lambda i: substr(piece, i, 2))) AS pair, n FROM counts WHERE length(piece) > 1) SELECT pair, CAST(sum(n) AS BIGINT) AS n FROM pairs WHERE NOT regexp_matches(pair, '\p{{Nd}}') GROUP BY pair")
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.pair_counts(K.piece_counts(table(spark, d, "documents")))


def _vocabulary(spark: SparkSession, d: str) -> K.Vocabulary:
    ship(spark)
    return K.train(table(spark, d, "benchmark"), 600)


@query("bpe_encode")
def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document under a vocabulary trained on the benchmark texts."""
    docs = table(spark, d, "documents")
    ids = K.encoder(_vocabulary(spark, d), docs)("text")
    return docs.select("doc_id", ids.alias("ids"))


@query(
    "bpe_round_trip",
    r"""WITH known AS (SELECT list(DISTINCT c) AS cs FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM benchmark UNION ALL SELECT chr(CAST(i AS INTEGER)) FROM range(32, 127) t(i) UNION ALL SELECT chr(CAST(i AS INTEGER)) FROM range(9, 14) t(i)))
SELECT doc_id, list_has_all(cs, regexp_extract_all(text, '(?s).')) AS same FROM documents, known""",
)
def bpe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether encoding and decoding give a document back: exactly where all its characters are printable ASCII or occur in the benchmark texts."""
    docs = table(spark, d, "documents")
    v = _vocabulary(spark, d)
    return docs.select("doc_id", (K.decoder(v, docs)(K.encoder(v, docs)("text")) == F.col("text")).alias("same"))


STRUCTURE = r"""[{}\[\],:"]"""


@query("tokenizer_gate", rf"""WITH {COUNTS}, letters AS (SELECT DISTINCT c FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents UNION ALL SELECT chr(CAST(i AS INTEGER)) FROM range(32, 127) t(i) UNION ALL SELECT chr(CAST(i AS INTEGER)) FROM range(9, 14) t(i))),
prices AS (SELECT DISTINCT CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) || '.5' AS x FROM orders)
SELECT (SELECT count(*) FROM prices) AS n_values, (SELECT CAST(sum(length(x)) AS BIGINT) FROM prices) AS n_value_tokens,
(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM counts WHERE regexp_full_match(piece, '{STRUCTURE}')) AS n_structural_tokens,
count(*) AS n_words, count(*) AS n_back, count(*) AS n_same_after_space,
(SELECT count(*) FROM letters WHERE regexp_matches(c, '\p{{Nd}}')) AS n_digit_tokens, (SELECT count(*) FROM letters) AS n_letters, true AS unfragmented FROM counts WHERE regexp_matches(piece, '\S')""")
def tokenizer_gate(spark: SparkSession, d: str) -> DataFrame:
    """What a vocabulary must hold before packing, as counts over whole tables.

    A price takes a token for each character, a structural character one token;
    words decode to themselves and have the same tokens after a space; only
    single characters hold digits; a word has fewer than six tokens on average.
    """
    ship(spark)
    counts = checkpointed(K.piece_counts(table(spark, d, "documents")))
    v = K.train_counts(counts, 2000)
    encode, decode = K.encoder(v, counts), K.decoder(v, counts)
    price = F.concat(F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.lit(".5"))
    values = table(spark, d, "orders").select(price.alias("x")).distinct().agg(F.count("*").alias("n_values"), F.sum(F.size(encode("x"))).alias("n_value_tokens"))
    structural = counts.filter(F.col("piece").rlike(f"^{STRUCTURE}$")).agg(F.coalesce(F.sum(F.size(encode("piece")) * F.col("n")), F.lit(0)).alias("n_structural_tokens"))
    words = counts.filter(F.col("piece").rlike(r"\S")).select("piece", encode("piece").alias("a"), encode(F.concat(F.lit(" "), "piece")).alias("b"))
    checks = words.select("a", (decode("a") == F.col("piece")).alias("back"), (F.slice("b", F.lit(2), F.size("b")) == F.col("a")).alias("same"))
    checks = checks.agg(F.count("*").alias("n_words"), F.count_if("back").alias("n_back"), F.count_if("same").alias("n_same_after_space"), F.coalesce(F.avg(F.size("a")) < 6, F.lit(True)).alias("unfragmented"))
    tokens = [t for t in v.ids if t not in K.SPECIALS]
    known = {"n_digit_tokens": sum(any(c.isdigit() for c in t) for t in tokens), "n_letters": sum(len(t) == 1 for t in tokens)}
    return values.crossJoin(structural).crossJoin(checks).withColumns({k: F.lit(n).cast("long") for k, n in known.items()})


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe_encode(spark, d)


@query("fragmentation")
def fragmentation(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per word of each language's documents."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"))
    return _ids(spark, d).join(docs, "doc_id").groupBy("lang").agg(F.round(F.avg(F.size("ids") / F.greatest(F.lit(1), "words")), 4).alias("tokens_per_word"))


TAGGED = Literal(
    "id long, call string, tags string",
    [
        (1, "[]", "15"),
        (2, '[{"name":"b","arguments":{}}]', "112222113112222222221111" + "1" * 4 + "5"),
        (3, '[{"name":"a","arguments":{"x":1}},{"name":"b","arguments":{}}]', "112222113112222222221" + "1" + "1" + "1" + "2" + "1" + "1" + "4" + "1" + "1" + "5" + "12222113112222222221111115"),
    ],
)


@fixture("tag_chars", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 0, 0, 1, 1), (2, 13, 1, 0, 1, 14), (3, 27, 2, 1, 2, 30)) t(id, n_key, n_name, n_value, n_stop, n_struct)")
def tag_chars(spark: SparkSession, d: str) -> DataFrame:
    """How many characters of each kind the tagger finds; tests compare the tags themselves."""
    ship(spark)
    of = lambda t: F.size(F.filter("tags", lambda x: x == t))
    rows = TAGGED.frame(spark).select("id", K.tag_column(F.col("call")).alias("tags"))
    return rows.select("id", of(K.KEY).alias("n_key"), of(K.NAME).alias("n_name"), of(K.VALUE).alias("n_value"), of(K.STOP).alias("n_stop"), of(K.STRUCT).alias("n_struct"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    rows = EXAMPLES.frame(spark).filter("error IS NULL").select("id", "query", C.loads(F.col("answers")).alias("answers"), T.parse(F.lit(LIGHTS)).alias("tools"))
    rows = rows.select("id", T.prompt(F.col("query"), F.col("tools")).alias("prompt"), C.dumps(F.col("answers")).alias("call"), F.transform("tools", lambda t: t["name"]).alias("names"))
    v = K.train(rows.select(F.explode(F.array("prompt", "call")).alias("text")), 400)
    return K.pack(rows, v, 256)


@fixture("pack_fixed", f"SELECT id, CAST(256 AS INTEGER) AS length, 1 AS bos, true AS padded FROM {EXAMPLES.sql()} WHERE error IS NULL")
def pack_fixed(spark: SparkSession, d: str) -> DataFrame:
    p = _packed(spark, d)
    tail = F.slice("ids", F.col("real_len") + 1, 256 - F.col("real_len"))
    return p.select("id", F.size("ids").alias("length"), F.element_at("ids", 1).alias("bos"), (F.forall(tail, lambda x: x == K.PAD) & (F.element_at("ids", F.col("real_len")) == K.EOS) & (F.size("tags") == 256)).alias("padded"))


@fixture("name_decisions", f"SELECT id, CAST(CASE WHEN contains(answers, 'setTimer') THEN 1 ELSE 0 END AS INTEGER) AS gold, true AS inside FROM {EXAMPLES.sql()} WHERE error IS NULL AND answers <> '[]'")
def name_decisions(spark: SparkSession, d: str) -> DataFrame:
    p = _packed(spark, d).select("id", "real_len", "ids", "tags", F.explode("decisions").alias("x"))
    return p.select("id", F.col("x.gold").alias("gold"), ((F.element_at("tags", F.col("x.pos") + 2) == K.NAME) & (F.element_at("tags", F.col("x.pos") + 1) != K.NAME)).alias("inside"))


@fixture("pack_statistics")
def pack_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).agg(F.count("*").alias("kept"), F.avg("real_len").alias("mean_len"), F.sum(F.aggregate(K.weights(F.col("tags")), F.lit(0.0), lambda a, x: a + x)).alias("weight"))


BATCHES = """o AS (SELECT doc_id, real, row_number() OVER (ORDER BY real, doc_id) - 1 AS place, least(768, CAST(ceil(real / 64) * 64 AS BIGINT)) AS padded FROM rows),
b AS (SELECT place, doc_id, real, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS held FROM o WHERE place = 0
  UNION ALL SELECT o.place, o.doc_id, o.real, batch + CAST(full_ AS BIGINT), CASE WHEN full_ THEN 1 ELSE held + 1 END FROM (SELECT b.*, o.padded, (held + 1) * o.padded > 32 * 512 OR held >= 128 AS full_ FROM b JOIN o ON o.place = b.place + 1) b JOIN o ON o.place = b.place + 1)
SELECT doc_id, real, place, batch FROM b"""
LENGTHS = "rows AS (SELECT doc_id, CAST(1 + n_chars % 700 AS BIGINT) AS real FROM documents)"


@query("token_budget_batches", f"WITH RECURSIVE {LENGTHS}, {BATCHES}")
def token_budget_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of documents by a stand-in length; the SQL goes row by row."""
    ship(spark)
    rows = table(spark, d, "documents").select("doc_id", (1 + F.col("n_chars") % 700).alias("real"))
    return tr.token_budget_batches(rows, "doc_id", "real", 768, 32 * 512).select("doc_id", "real", "place", "batch")


@query("length_order", f"WITH {LENGTHS} SELECT doc_id, row_number() OVER (ORDER BY real, doc_id) - 1 AS place FROM rows")
def length_order(spark: SparkSession, d: str) -> DataFrame:
    return token_budget_batches(spark, d).select("doc_id", "place")


@query("nfkc_normalize")
def nfkc_normalize(spark: SparkSession, d: str) -> DataFrame:
    """All documents; DuckDB has no NFKC, so tests compare with Python."""
    ship(spark)
    return table(spark, d, "documents").select("doc_id", nfkc(F.col("text")).alias("text"))


@query(
    "rate_schedule",
    """WITH n AS (SELECT count(*) AS total, greatest(10, count(*) // 20) AS warm FROM events)
SELECT event_id AS step, round(least(1.0, (event_id + 1) / CAST(warm AS DOUBLE)) * CASE WHEN event_id / CAST(total AS DOUBLE) < 0.8 THEN 1.0 ELSE greatest(0.05, (1 - event_id / CAST(total AS DOUBLE)) / 0.2) END, 6) AS factor FROM events, n""",
)
def rate_schedule(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.select(F.col("event_id").alias("step"), F.round(tr.rate_factor(F.col("event_id"), events.count()), 6).alias("factor"))


@query(
    "loss_average",
    """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(sum(value * CASE WHEN i = 1 THEN power(0.9, n - 1) ELSE 0.1 * power(0.9, n - i) END), 6) AS ema FROM o GROUP BY event_type""",
)
def loss_average(spark: SparkSession, d: str) -> DataFrame:
    return tr.moving_average(table(spark, d, "events"), "event_type", "event_id", "value", 0.9).withColumn("ema", F.round("ema", 6))


@query(
    "loss_averages",
    """WITH o AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events)
SELECT a.event_id, round(sum(b.value * CASE WHEN b.i = 1 THEN power(0.9, a.i - 1) ELSE 0.1 * power(0.9, a.i - b.i) END), 6) AS ema FROM o a JOIN o b ON a.event_type = b.event_type AND b.i <= a.i AND (b.i > a.i - 400 OR b.i = 1) GROUP BY a.event_id""",
)
def loss_averages(spark: SparkSession, d: str) -> DataFrame:
    """The average after every step; the SQL sums up to the 400th step before, whose weight is below 1e-18."""
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    return tr.moving_averages(rows, "event_type", "event_id", "value", 0.9).select("event_id", F.round("ema", 6).alias("ema"))


@query("best_so_far", "SELECT event_id, coalesce(value < min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new_best FROM events")
def best_so_far(spark: SparkSession, d: str) -> DataFrame:
    return tr.best_so_far(table(spark, d, "events"), "event_type", "event_id", "value").select("event_id", "new_best")


@query("best_candidate", "SELECT event_type, avg_value FROM (SELECT event_type, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type) ORDER BY avg_value, event_type LIMIT 1")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("avg_value"))
    return tr.best_candidate(per, "event_type", "avg_value").select("event_type", "avg_value")


@query("weight_soup", "SELECT CAST(i - 1 AS INTEGER) AS place, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS w FROM embeddings, range(1, 65) t(i) GROUP BY i")
def weight_soup(spark: SparkSession, d: str) -> DataFrame:
    return tr.soup(table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v")), "v").select("place", F.round("w", 5).alias("w"))


@query("weighted_loss", "SELECT event_type, round(sum(value * (event_id % 5)) / greatest(1, sum(event_id % 5)), 6) AS loss FROM events GROUP BY event_type")
def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    return tr.weighted_loss(table(spark, d, "events"), "event_type", F.col("value"), (F.col("event_id") % 5).cast("double")).withColumn("loss", F.round("loss", 6))


@query("spend_cap", "SELECT event_id, round(sum((event_id % 900) * 0.14e-6 + (event_id % 300) * 0.28e-6) OVER w, 9) AS cost, sum((event_id % 900) * 0.14e-6 + (event_id % 300) * 0.28e-6) OVER w > 0.1 AS over FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)")
def spend_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumns({"p": F.col("event_id") % 900, "c": F.col("event_id") % 300})
    return tr.spending(rows, "event_type", "event_id", "p", "c", 0.1).select("event_id", F.round("cost", 9).alias("cost"), "over")


@query("pointer_spans")
def pointer_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where a call's name stands in the tokens of a query, for every gold call of ``events``."""
    from ..operators.retrieve import find_sub

    ship(spark)
    _, gold = pool_and_gold(spark, d)
    v = _vocabulary(spark, d)
    rows = gold.select("row_id", F.posexplode("gold").alias("pos", "call")).select("row_id", "pos", F.col("call.name").alias("name"))
    rows = rows.withColumn("prompt", F.concat(F.lit("please "), "name", F.lit(" now")))
    encode = K.encoder(v, rows)
    ids = rows.withColumns({"hay": encode("prompt"), "needle": encode("name")})
    return ids.select("row_id", "pos", find_sub(F.col("hay"), F.col("needle")).alias("start"), F.size("needle").alias("n"))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """For every document a call that takes over its language, a run of its words, its source in capitals and its length, and a prompt of the text and the language."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    arguments = F.struct(F.col("lang").alias("lang"), F.col("n_chars").alias("n"), F.array_join(F.slice(words, 4, 3), " ").alias("quote"), F.upper("source").alias("source"))
    call = F.to_json(F.array(F.struct(F.lit("cite").alias("name"), arguments.alias("arguments"))))
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), "lang").alias("prompt"), call.alias("call"))


@query("pointer_values")
def pointer_values(spark: SparkSession, d: str) -> DataFrame:
    """Which argument values are copied from the prompt, and where, for every document; tests compare with a plain search."""
    rows = quotes(spark, d)
    found = K.pointers(_vocabulary(spark, d), rows, "prompt", "call", 1 << 30)
    return rows.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")
