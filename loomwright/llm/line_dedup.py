"""Lines that many documents share (operator 12).

Lines are exploded with their places and normalised; a 128-bit hash stands for
a key from there on. Counting the distinct documents of each hash combines on
the map side, so a line that a third of all documents holds is a few rows of
the shuffle. Only hashes, places and document ids are joined with the common
keys; a text is shuffled once, to meet the places that it loses, and put
together again from the runs of lines between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

LEAST_LENGTH, LEAST_DOCUMENTS = 20, 3
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """``line`` without blanks at its ends and with A-Z, and nothing else, in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _mark(c: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t1, t2): the hashes tell unlike texts under one id apart."""
    one, two = _mark(F.col("text"))
    whole = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return whole.withColumns({"t1": one, "t2": two})


def places(texts: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, t1, t2, at, k1, k2): each line whose key has at least ``least_length`` code points."""
    lines = texts.select("doc_id", "t1", "t2", F.posexplode(_split(F.col("text"))).alias("at", "line")).filter(F.char_length("line") >= least_length)
    keys = lines.select("doc_id", "t1", "t2", "at", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_length)
    one, two = _mark(F.col("key"))
    return keys.select("doc_id", "t1", "t2", "at", one.alias("k1"), two.alias("k2"))


def common_keys(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(k1, k2, keeper): keys found in at least ``least_documents`` documents, and the largest doc_id that holds each."""
    per = lines.groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    return per.filter(F.col("n") >= least_documents).drop("n")


def joined_without(lines: Column, drops: Column) -> Column:
    """The lines whose places (from 0) are not in the ascending ``drops``, joined by newlines; linear in both."""

    def runs(x: Column) -> Column:
        size = F.size(x["drops"])
        ends = F.transform(
            F.sequence(F.lit(0), size),
            lambda j: F.struct(F.when(j > 0, F.get(x["drops"], j - 1) + 1).otherwise(F.lit(0)).alias("first"), F.when(j < size, F.get(x["drops"], j)).otherwise(F.size(x["lines"])).alias("end")),
        )
        some = F.filter(ends, lambda e: e["end"] > e["first"])
        return F.array_join(F.transform(some, lambda e: F.array_join(F.slice(x["lines"], e["first"] + 1, e["end"] - e["first"]), "\n")), "\n")

    return let(F.struct(lines.alias("lines"), drops.alias("drops")), runs)


def without_common_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text), a row for each row of ``docs``: its text without common lines.

    A key in at least ``least_documents`` documents loses all its lines except
    those in the largest doc_id that holds it. A null or empty text is one
    empty line. Several rows with one doc_id are one document. A null doc_id
    counts as no document, and its rows lose every common line. An empty table
    gives no rows; other columns are ignored.
    """
    texts = _texts(docs)
    lines = places(texts, least_length)
    common = common_keys(lines, least_documents)
    lost = lines.join(common, ["k1", "k2"]).filter("doc_id IS NULL OR doc_id < keeper")
    drops = lost.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("at")).alias("drops")).withColumnsRenamed({"doc_id": "d_id", "t1": "d1", "t2": "d2"})
    both = texts.join(drops, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("t1") == F.col("d1")) & (F.col("t2") == F.col("d2")), "left")
    n_lines = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(joined_without(_split(F.col("text")), F.col("drops")))
    return both.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("text"))


def line_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines before dropping, n_dropped, kept_sha256 of the kept text; see ``without_common_lines``."""
    return without_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
lines AS (SELECT doc_id, r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM texts),
keys AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keys WHERE length(key) >= {LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}),
marked AS (SELECT k.*, c.key IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id < c.keeper) AS lost FROM keys k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
