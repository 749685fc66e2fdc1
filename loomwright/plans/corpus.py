"""Decontamination, duplicates, mixing and sampling over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literals import Literal
from ..functions.text import collapse, lexical_tokens, squash
from ..operators import corpus as op
from ..registry import fixture, query
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


W = r"list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda x: x <> '')"
G = "unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' ')))"
HITS = f"""dw AS (SELECT doc_id, {W} AS w FROM documents), bw AS (SELECT {W} AS w FROM benchmark),
dg AS (SELECT doc_id, {G} AS g FROM dw WHERE len(w) >= 8), bg AS (SELECT DISTINCT {G} AS g FROM bw WHERE len(w) >= 8),
hits AS (SELECT DISTINCT doc_id FROM dg WHERE g IN (SELECT g FROM bg)
  UNION SELECT doc_id FROM dw WHERE len(w) < 8 AND array_to_string(w, ' ') IN (SELECT array_to_string(w, ' ') FROM bw WHERE len(w) < 8))"""
COLLAPSE = r"trim(regexp_replace(lower({}), '[\x09-\x0d\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g'))"
SQUASH = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@query("ngram_firewall", f"WITH {HITS} SELECT doc_id FROM hits")
def ngram_firewall(spark: SparkSession, d: str) -> DataFrame:
    return op.overlapping(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("firewall_sweep", f"WITH {HITS} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)")
def firewall_sweep(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source").join(op.overlapping(docs, table(spark, d, "benchmark")), "doc_id", "left_anti")


@query(
    "source_quarantine",
    f"""WITH {HITS} SELECT source, count(*) AS n, CAST(count(hits.doc_id) AS BIGINT) AS n_bad, count(hits.doc_id) / greatest(1, count(*)) AS share,
count(hits.doc_id) / greatest(1, count(*)) > 0.05 AND source <> 'src3' AS quarantined FROM documents LEFT JOIN hits USING (doc_id) GROUP BY source""",
)
def source_quarantine(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return op.quarantine(docs, op.overlapping(docs, table(spark, d, "benchmark")), exempt=("src3",))


SHORT = Literal("item_id long, text string", [(1, "Play the song!"), (2, "turn  it off"), (3, "dim the kitchen lights to thirty percent right now please")])
ASKED = Literal("doc_id long, text string", [(1, "play THE song"), (2, "turn it off, now"), (3, "Turn it off."), (4, "would you dim the kitchen lights to thirty percent right now"), (5, ""), (6, None)])


@fixture("short_query_firewall", f"WITH documents AS (SELECT * FROM {ASKED.sql()}), benchmark AS (SELECT * FROM {SHORT.sql()}), {HITS} SELECT doc_id FROM hits")
def short_query_firewall(spark: SparkSession, d: str) -> DataFrame:
    return op.overlapping(ASKED.frame(spark), SHORT.frame(spark))


@query("exact_firewall", f"SELECT doc_id FROM documents WHERE {SQUASH.format('text')} NOT IN (SELECT {SQUASH.format('text')} FROM benchmark)")
def exact_firewall(spark: SparkSession, d: str) -> DataFrame:
    """Documents, all of them, whose squashed text is no benchmark item's."""
    return op.exact_firewall(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark")).select("doc_id")


@query("dedup_first_wins", f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY {COLLAPSE.format('text')} ORDER BY source, doc_id) = 1")
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(collapse(F.col("text"))).alias("k"))
    return op.first_wins(docs, F.col("k"), F.col("source"), F.col("doc_id")).select("doc_id", "source")


HISTORY = f"SELECT {COLLAPSE.format('text')} FROM benchmark UNION ALL SELECT {COLLAPSE.format('text')} FROM conversations"


def _history(spark: SparkSession, d: str) -> DataFrame:
    """What earlier runs have: the texts of the benchmark and of all turns."""
    return table(spark, d, "benchmark").select("text").unionByName(table(spark, d, "conversations").select("text"))


@query("dedup_vs_history", f"SELECT conv_id, turn FROM conversations WHERE {COLLAPSE.format('text')} NOT IN (SELECT {COLLAPSE.format('text')} FROM documents)")
def dedup_vs_history(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations, all of them, whose text is no document's."""
    return op.unseen(table(spark, d, "conversations"), table(spark, d, "documents").select("text")).select("conv_id", "turn")


@query("dedup_vs_history_and_batch", f"SELECT doc_id FROM documents WHERE {COLLAPSE.format('text')} NOT IN ({HISTORY}) QUALIFY row_number() OVER (PARTITION BY {COLLAPSE.format('text')} ORDER BY doc_id) = 1")
def dedup_vs_history_and_batch(spark: SparkSession, d: str) -> DataFrame:
    """Documents, all of them, whose text is not in the history, and of equal ones only the first."""
    return op.unseen(table(spark, d, "documents").select("doc_id", "text"), _history(spark, d), "text", F.col("doc_id")).select("doc_id")


MIX = {"src0": 1, "src1": 3, "src2": 6, "src3": 2, "src4": 1}


def _weights(mix: dict[str, int]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in mix.items()) + ") AS m(source, times)"


@query("mix_weighted", f"SELECT doc_id, source, CAST(copy AS INTEGER) AS copy FROM (SELECT doc_id, d.source, unnest(range(1, times + 1)) AS copy FROM documents d JOIN {_weights(MIX)} ON d.source = m.source)")
def mix_weighted(spark: SparkSession, d: str) -> DataFrame:
    return op.mixed(table(spark, d, "documents").select("doc_id", "source"), MIX)


ANNEAL = {"src0": 3, "src5": 6, "src6": 2, "src7": 1}
CAPS = {"src7": 20, "src0": 10}


@query(
    "mix_anneal",
    f"""WITH few AS (SELECT doc_id, source FROM documents QUALIFY CASE source WHEN 'src7' THEN row_number() OVER (PARTITION BY source ORDER BY md5(concat('7|', doc_id)), doc_id) <= 20
  WHEN 'src0' THEN row_number() OVER (PARTITION BY source ORDER BY md5(concat('7|', doc_id)), doc_id) <= 10 ELSE true END)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy FROM (SELECT doc_id, s.source, unnest(range(1, times + 1)) AS copy FROM few s JOIN {_weights(ANNEAL)} ON s.source = m.source)""",
)
def mix_anneal(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return op.mixed(op.capped(docs, CAPS, "source", op.order_key(7, F.col("doc_id")), F.col("doc_id")), ANNEAL)


@query("sample_seeded", "SELECT doc_id, source FROM documents ORDER BY md5(concat('11|', doc_id)), doc_id LIMIT 100")
def sample_seeded(spark: SparkSession, d: str) -> DataFrame:
    return op.sampled(table(spark, d, "documents").select("doc_id", "source"), 100, "doc_id", 11)


WEIGHT = "(CAST('0x' || substr(md5(concat('13|', doc_id)), {0}, 7) AS BIGINT) / 268435456.0)"
CHOICES = {"one": 5, "two": 3, "refuse": 1.5, "three": 0.5}


@query("sample_weighted", f"SELECT doc_id FROM documents WHERE n_chars > 0 ORDER BY -ln({WEIGHT.format(1)} + pow(2.0, -29)) / n_chars, doc_id LIMIT 200")
def sample_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Documents drawn in proportion to their length."""
    return op.weighted_sample(table(spark, d, "documents").select("doc_id", "n_chars"), 200, "doc_id", F.col("n_chars"), 13).select("doc_id")


def _choices() -> str:
    rows = ", ".join(f"({i}, '{n}', {k!r}, '{a}')" for i, (n, k, a) in enumerate(zip(*op.alias_table(CHOICES), strict=True)))
    return f"(VALUES {rows}) c(i, own, share, other)"


@query("choice_weighted", f"SELECT doc_id, CASE WHEN {WEIGHT.format(8)} < share THEN own ELSE other END AS choice FROM documents JOIN {_choices()} ON i = CAST(floor({WEIGHT.format(1)} * {len(CHOICES)}) AS INTEGER)")
def choice_weighted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", op.weighted_choice(13, F.col("doc_id"), CHOICES).alias("choice"))


@query(
    "stratified_sample",
    """SELECT doc_id, CASE WHEN n_chars >= 2000 THEN 'long' ELSE 'short' END AS stratum FROM documents
QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('7|', doc_id)), doc_id) <= CASE stratum WHEN 'long' THEN 70 ELSE 30 END""",
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return op.stratified(docs, F.when(F.col("n_chars") >= 2000, "long").otherwise("short"), {"long": 70, "short": 30}, "doc_id", 7).select("doc_id", "stratum")


@query("tail_holdout", "SELECT doc_id, CASE WHEN doc_id >= (SELECT min(doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 50)) THEN 'dev' ELSE 'train' END AS part FROM documents")
def tail_holdout(spark: SparkSession, d: str) -> DataFrame:
    return op.holdout(table(spark, d, "documents").select("doc_id"), 50, "doc_id")


@query("head_cap", "SELECT doc_id, source FROM documents QUALIFY source <> 'src0' OR row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 40")
def head_cap(spark: SparkSession, d: str) -> DataFrame:
    return op.capped(table(spark, d, "documents").select("doc_id", "source"), {"src0": 40}, "source", F.col("doc_id"))


@query("share_split", "SELECT part, count(*) AS n FROM (SELECT CASE WHEN CAST('0x' || substr(md5(concat('3|', doc_id)), 1, 7) AS BIGINT) / 268435456.0 < 0.1 THEN 'dev' ELSE 'train' END AS part FROM documents) GROUP BY part")
def share_split(spark: SparkSession, d: str) -> DataFrame:
    return op.split_by_share(table(spark, d, "documents").select("doc_id"), "doc_id", 3, 0.1).groupBy("part").agg(F.count("*").alias("n"))


@query("source_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("rejection_tally", "SELECT concat(source, ': ', substr(lang || ' ' || CASE WHEN n_chars < 500 THEN 'too short' ELSE 'long enough' END, 1, 60)) AS reason, count(*) AS n FROM documents GROUP BY reason ORDER BY n DESC, reason LIMIT 8")
def rejection_tally(spark: SparkSession, d: str) -> DataFrame:
    reason = F.concat("source", F.lit(": "), F.substring(F.concat("lang", F.lit(" "), F.when(F.col("n_chars") < 500, "too short").otherwise("long enough")), 1, 60))
    return table(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(8)


@query(
    "first_user_last_assistant",
    """SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS query, arg_max(text, turn) FILTER (role = 'assistant') AS answer,
  arg_max(text, turn) FILTER (role = 'user') AS last_query FROM conversations GROUP BY conv_id""",
)
def first_user_last_assistant(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    of = lambda f, role: f(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return turns.groupBy("conv_id").agg(of(F.min_by, "user").alias("query"), of(F.max_by, "assistant").alias("answer"), of(F.max_by, "user").alias("last_query"))


@query("word_frequency", f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({W}) AS w FROM documents) GROUP BY w")
def word_frequency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(F.split(squash(F.col("text")), " ")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@query("lexical_token_counts", "SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[a-z0-9]+'))) AS INTEGER) AS n FROM documents")
def lexical_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(lexical_tokens(F.col("text"))).alias("n"))


@query("answer_context", "SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked, text AS answer FROM conversations QUALIFY role = 'assistant'")
def answer_context(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").withColumn("asked", F.lag("text").over(w)).filter("role = 'assistant'").select("conv_id", "turn", "asked", F.col("text").alias("answer"))
