"""Personal data in texts, with DataFrame functions only (operator 5).

For each kind a regular expression proposes spans, a checksum or range check
confirms them, and words shortly before a span raise its score. The kinds of
``BASE`` are fixed by contract and stay whatever their score; other kinds stay
from ``KEEP`` on.

Spans come from cutting the text at the matches: the lengths of the parts and
matches add up to code point positions. The patterns are written so that
Java's matcher neither recurses nor tries a run of characters again from each
of its characters; they match the same spans as the plain forms beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
KEEP = 0.5

#: Kind -> (cheap test, pattern). Plain forms:
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([\x20-]?[0-9])+   phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
#: Score of a confirmed span, and words that add to it if they stand in the 40 characters before.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8, "ssn": 0.3}
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|compte",
    "ssn": "ssn|social|security",
}
BEFORE, BONUS = 40, 0.2

SPAN = "struct<s:int,kind:int,e:int,v:string>"


def _found(text: Column, kind: str) -> Column:
    guard, pattern = PATTERNS[kind]
    number = KINDS.index(kind)
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), lambda p, m: F.struct(F.char_length(p).alias("gap"), m.alias("v")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.coalesce(F.char_length(x["v"]), F.lit(0))
        span = F.struct(s.alias("s"), F.lit(number).alias("kind"), e.alias("e"), x["v"].alias("v"))
        return F.struct(e.alias("at"), F.when(x["v"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).cast(f"array<{SPAN}>").alias("out"))

    spans = F.aggregate(parts, empty, add, lambda acc: acc["out"])
    passes = F.filter(spans, lambda x: CHECKS[kind](x["v"]))
    test = F.contains(text, F.lit(guard)) if kind == "email" else text.rlike(guard)
    return F.when(test, passes).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(v: Column) -> Column:
    """Whether an account number passes ISO 7064's mod 97-10 check."""
    plain = F.replace(v, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")

    def add(rest: Column, c: Column) -> Column:
        return F.when(c == "", rest).when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(turned, F.lit(0), add) == 1


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255),
    "card": lambda v: F.when(F.length(_digits(v)).between(12, 19), luhn(_digits(v))).otherwise(F.lit(False)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "iban": lambda v: F.when(F.length(F.replace(v, F.lit(" "), F.lit(""))).between(15, 34), mod97(v)).otherwise(F.lit(False)),
    "ssn": lambda v: ~v.rlike("^(000|666|9)|-00-|0000$"),
}


def _scored(text: Column, spans: Column, kind: str) -> Column:
    before = lambda x: F.lower(F.substring(text, F.greatest(F.lit(1), x["s"] - (BEFORE - 1)), F.least(F.lit(BEFORE), x["s"])))
    score = lambda x: F.when(before(x).rlike(WORDS[kind]), F.lit(SCORES[kind] + BONUS)).otherwise(F.lit(SCORES[kind]))
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), x["v"].alias("v"), F.round(score(x), 2).alias("score")))


def _listed(spans: Column, score: bool = False) -> Column:
    names = F.array(*map(F.lit, KINDS))
    line = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"], x["e"], *([F.format_number(x["score"], 2)] if score else []))
    return F.array_join(F.transform(F.array_sort(spans), line), ",")


def find(df: DataFrame, text: Column, out: str = "spans") -> DataFrame:
    """``df`` with an array of the spans of ``text``: start, kind (index in KINDS), end, value, score; sorted.

    Null and empty texts have none. Row by row, no shuffle.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    names = {k: f"{out}_{k}_" for k in KINDS}
    while clash := set(names.values()) & set(df.columns):
        names = {k: v + "_" if v in clash else v for k, v in names.items()}
    found = df.withColumns({names[k]: _found(t, k) for k in KINDS})
    kept = [_scored(t, F.col(f"`{names[k]}`"), k) for k in KINDS]
    kept = [x if k in BASE else F.filter(x, lambda s: s["score"] >= KEEP) for k, x in zip(KINDS, kept, strict=True)]
    return found.withColumn(out, F.array_sort(F.concat(*kept))).drop(*names.values())


def redact(text: Column, spans: Column) -> Column:
    """``text`` with ``[KIND]`` in place of each span; of overlapping spans the first names the place of all. Null stays null."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["kind"] + 1))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, empty, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and scores of each row's whole text.

    Null and empty texts have no spans; repeated rows give repeated results.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = find(plain, F.col("text")).drop("text")
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), _listed(F.col("spans"), score=True).alias("scores"))


def _duck_kind(kind: str) -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }.get(kind) or PATTERNS[kind][1]
    digits = r"regexp_replace(v, '[^0-9]', '', 'g')"
    luhn_ = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (2 * d(v, i)) % 10 + (2 * d(v, i)) // 10 ELSE d(v, i) END)) % 10 = 0".replace("d(v, i)", f"CAST(substr({digits}, CAST(length({digits}) - i + 1 AS BIGINT), 1) AS INTEGER)")
    turned = "substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4)"
    check = {
        "email": "true",
        "ip": r"list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(p AS INTEGER), 256) <= 255))",
        "card": f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn_} ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_concat([0], list_transform(string_split({turned}, ''), lambda c: ascii(c))), lambda r, a: CASE WHEN a < 65 THEN (r * 10 + a - 48) % 97 ELSE (r * 100 + a - 55) % 97 END) = 1",
        "ssn": "NOT regexp_matches(v, '^(000|666|9)|-00-|0000$')",
    }[kind]
    score = f"round({SCORES[kind]} + CASE WHEN regexp_matches(lower(substr(t, greatest(1, s - {BEFORE - 1}), least({BEFORE}, s))), '{WORDS[kind]}') THEN {BONUS} ELSE 0 END, 2)"
    keep = "true" if kind in BASE else f"score >= {KEEP}"
    return f"""SELECT doc_id, t, s, {KINDS.index(kind)} AS k, '{kind}' AS kind, e, score FROM (SELECT *, {score} AS score FROM (
      SELECT doc_id, t, v, s, s + length(v) AS e FROM (
        SELECT doc_id, t, ms[i] AS v, CAST(list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS BIGINT) AS s
        FROM (SELECT doc_id, t, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
          SELECT doc_id, t, regexp_extract_all(t, '{plain}') AS ms, string_split_regex(t, '{plain}') AS ps FROM src)))
      WHERE {check})) WHERE {keep}"""


ORACLE = f"""WITH src AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_duck_kind(k) for k in KINDS)}),
listed AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base,
  string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k) AS spans,
  string_agg(concat(kind, ':', s, ':', e, ':', printf('%.2f', score)), ',' ORDER BY s, k) AS scores FROM found GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id"""
