"""Text normalisation and keys as column expressions.

Three normalisations exist and are not interchangeable: ``squash`` for
decontamination, ``glue`` for evidence, ``collapse`` for duplicates. Word
characters are Unicode letters, digits and underscore; Java's ``\\W`` would be
ASCII only.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import in_pieces

WORD, NON_WORD = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"
BLANKS = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]+"

# Punctuation that normalisation maps to ASCII after NFKC.
PUNCTUATION = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "\u00a0": " ", "…": "..."}

# Month names by number.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it (inside lambdas nothing else shares work)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squash(c: Column) -> Column:
    """Lower case, runs of non-word characters as one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), NON_WORD, " "))


def glue(c: Column) -> Column:
    """Lower case without non-word characters."""
    return F.regexp_replace(F.lower(c), NON_WORD, "")


def collapse(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), BLANKS, " "))


def words(c: Column) -> Column:
    """Runs of word characters, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def ngrams(w: Column, n: int) -> Column:
    """Distinct runs of ``n`` words joined by spaces; none for shorter arrays. The guard is in the expression: sequence() counts down."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))


def camel_split(c: Column) -> Column:
    """Spaces at case boundaries, in two passes so that engines without look-around can do the same."""
    return F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")


def lexical_tokens(c: Column) -> Column:
    """Distinct lower-case ASCII tokens, camel case split."""
    return F.array_distinct(F.regexp_extract_all(F.lower(camel_split(c)), F.lit("[a-z0-9]+"), F.lit(0)))


def order_key(seed: int, c: Column) -> Column:
    """A reproducible random order: the same in every engine and for every partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))


def uniform(seed: int, c: Column) -> Column:
    """A reproducible number in [0, 1) from 28 bits of the order key."""
    return F.conv(F.substring(order_key(seed, c), 1, 7), 16, 10).cast("double") / float(1 << 28)


def nfkc(c: Column) -> Column:
    """NFKC, then plain quotes, dashes, spaces and dots. Text that is ASCII already stays in the JVM."""
    table = str.maketrans(PUNCTUATION)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(lambda t: unicodedata.normalize("NFKC", t).translate(table), pa.string())(texts)

    return F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(run(F.when(~c.rlike(r"^[\x00-\x7f]*$"), c)))


def iso_date_evidenced(value: Column, query: Column) -> Column:
    """Whether a YYYY-MM-DD value is told by the query: its year, its month as a name or ``m/``, and its day as a number or ordinal."""
    part = lambda i: F.regexp_extract(value, r"^(\d{4})-(\d{2})-(\d{2})", i)
    q = F.lower(query)
    month, day = part(2).try_cast("int"), part(3).try_cast("int")
    valid = month.between(1, 12)
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.when(valid, month).otherwise(F.lit(1)))
    said = valid & (F.contains(q, name) | F.contains(q, F.concat(month.cast("string"), F.lit("/"))))
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.contains(q, part(1)) & said & F.regexp_like(q, F.concat(F.lit(r"\b0?"), day.cast("string"), F.lit(r"(st|nd|rd|th)?\b"))), F.lit(False))


def normalized_example(df, query: str = "query", answers: str = "answers"):
    """``df`` with NFKC on the query and on top-level text arguments of the calls; tools and nested values stay as they are.

    ``answers`` is JSON text of a call list; malformed text stays as it is.
    """
    import json

    table = str.maketrans(PUNCTUATION)
    fold = lambda t: unicodedata.normalize("NFKC", t).translate(table)

    def one(text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        try:
            calls = json.loads(text)
            for c in calls:
                c["arguments"] = {k: fold(v) if isinstance(v, str) else v for k, v in c["arguments"].items()}
        except (ValueError, TypeError, KeyError, AttributeError):
            return text
        return json.dumps(calls, ensure_ascii=False, separators=(",", ":"))

    run = F.pandas_udf(lambda s: s.map(one), "string")
    return df.withColumns({query: nfkc(F.col(query)), answers: run(answers)})
