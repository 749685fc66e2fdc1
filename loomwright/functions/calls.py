"""Calls, arguments and their equalities as column expressions.

A call is ``struct<name: string, arguments: string>`` with raw JSON text; a
call list is an array of calls, empty for a refusal, NULL for malformed text.

Arguments are compared by sorted entries ``(k, tag, text)``. The tag tells
strings, integers, floats, booleans, nulls, objects and arrays apart; the text
keeps ``1.0`` and the order of nested keys. ``strict`` equality compares both.
``loose`` equality compares values: 1, 1.0 and true are equal, and nested keys
have no order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, MapType, StringType, StructField, StructType

from .text import let

CALL = "struct<name:string,arguments:string>"
CALLS = f"array<{CALL}>"
ENTRY = "struct<k:string,tag:string,text:string>"
ENTRIES = f"array<{ENTRY}>"


# JSON is read with every scalar turned into a marked string first, as Spark's reader would print numbers anew
# and take text that looks like an object for one. A string x becomes STRING x SCALAR, a literal becomes STRING
# SCALAR literal; so a marked text that ends with SCALAR is a string, whatever it holds.
STRING, SCALAR = "\x02", "\x01"
_BODY = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_LITERAL = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity"
_MARKED_LITERAL = r'"\\u0002\\u0001([^"\\]+)"'


def marked(text: Column) -> Column:
    return F.regexp_replace(text, f'"({_BODY})"|({_LITERAL})', r'"\\u0002$1\\u0001$2"')


#: Marked arguments by key, and items of a call list; a struct takes the last of repeated keys.
ARGUMENTS = MapType(StringType(), StringType())
ITEMS = ArrayType(StructType([StructField(STRING + k + SCALAR, StringType()) for k in ("name", "arguments")]))


def _parsed(text: Column, kind: DataType) -> Column:
    """JSON text read as ``kind`` with marked keys and values; NULL if it is malformed or goes on after its end. The key at the end can't come from the text, whose keys are marked."""
    whole = F.from_json(F.concat(F.lit('{"a":'), marked(text), F.lit(',"z":1}')), StructType([StructField("a", kind), StructField("z", IntegerType())]))
    return let(whole, lambda x: F.when(x["z"] == 1, x["a"]))


# Literals that Python prints as they are: integers, short decimals without needless digits, and words.
_AS_WRITTEN = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.(?:0|[0-9]*[1-9]))?|-?[A-Za-z]+)$"
_TINY = r"^-?0\.0000"


def python_number(literal: Column) -> Column:
    """The text that Python gives a JSON number (NaN, true and other words stay): integers as they are, floats with the fewest digits that tell them apart.

    Up to 15 digits are told apart as written; longer ones take the JVM's digits.
    """

    def shape(text: Column) -> Column:
        plain = F.ltrim(F.upper(text), F.lit("-"))
        power = F.when(F.contains(plain, F.lit("E")), F.substring_index(plain, "E", -1).try_cast("int")).otherwise(F.lit(0))
        split = F.struct(F.substring_index(plain, "E", 1).alias("digits"), power.alias("power"))
        whole = lambda x: F.struct(F.replace(x["digits"], F.lit("."), F.lit("")).alias("all"), (F.length(F.substring_index(x["digits"], ".", 1)) + x["power"]).alias("point"))
        bare = lambda x: F.struct(x["point"].alias("point"), F.length(x["all"]).alias("size"), F.ltrim(x["all"], F.lit("0")).alias("short"))
        return let(let(let(split, whole), bare), lambda x: F.struct(F.rtrim(x["short"], F.lit("0")).alias("digits"), (x["point"] - x["size"] + F.length(x["short"])).alias("point")))

    def printed(x: Column) -> Column:
        digits, point, n = x["digits"], x["point"], F.length(x["digits"])
        zeros = lambda k: F.repeat(F.lit("0"), k)
        plain = (
            F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits))
            .when(point >= n, F.concat(digits, zeros(point - n), F.lit(".0")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        )
        power = F.abs(point - 1).cast("string")
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit(""))
        spread = F.concat(F.substring(digits, 1, 1), tail, F.lit("e"), F.when(point < 1, "-").otherwise("+"), F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")))
        return F.when(n == 0, F.lit("0.0")).when(point.between(-3, 16), plain).otherwise(spread)

    def a_float(text: Column) -> Column:
        short = text.rlike(r"^-?[0-9.]{1,16}(?:[eE][+-]?[0-9]{1,2})?$")
        source = F.when(short, text).otherwise(text.try_cast("double").cast("string"))
        number = let(source, lambda t: F.when(F.endswith(t, F.lit("Infinity")), F.lit("Infinity")).otherwise(let(shape(t), printed)))
        return F.concat(F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit("")), number)

    written = literal.rlike(_AS_WRITTEN) & ((F.length(literal) <= 16) & ~literal.rlike(_TINY) | ~F.contains(literal, F.lit(".")))
    return F.when(literal == "-0", F.lit("0")).when(written, literal).otherwise(a_float(literal))


def _unmarked(text: Column) -> Column:
    """Nested JSON text as it was."""
    return F.regexp_replace(F.regexp_replace(text, _MARKED_LITERAL, "$1"), rf'"\\u0002({_BODY.replace("*+", "*?")})\\u0001"', '"$1"')


def _content(value: Column) -> Column:
    """The text of a marked string."""
    return F.substring(value, F.lit(2), F.length(value) - 2)


def _read(value: Column) -> Column:
    """(tag, text) of a marked value; the text of a null is NULL."""
    scalar = F.substring(value, F.lit(3), F.length(value))
    tag = (
        F.when(F.endswith(value, F.lit(SCALAR)), F.lit("STRING"))
        .when(F.startswith(value, F.lit("{")), F.lit("OBJECT"))
        .when(F.startswith(value, F.lit("[")), F.lit("ARRAY"))
        .when(scalar == "null", F.lit("VOID"))
        .when(scalar.isin("true", "false"), F.lit("BOOLEAN"))
        .when(scalar.rlike("^-?[0-9]+$"), F.lit("INT"))
        .otherwise(F.lit("FLOAT"))
    )
    # Numbers to print: the value itself, or those of a nested one; integers need no look, which are most.
    numbers = F.when(F.startswith(value, F.lit(STRING + SCALAR)), F.array(scalar)).when(value.rlike(r'\\u0001-?(?:0"|[0-9]+[.eE])'), F.regexp_extract_all(value, F.lit(_MARKED_LITERAL), F.lit(1)))

    def text(x: Column) -> Column:
        t, printed = x["tag"], x["numbers"]
        between = F.zip_with(F.split(value, _MARKED_LITERAL, -1), F.concat(printed, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
        nested = _unmarked(F.when(F.size(printed) > 0, F.array_join(between, "")).otherwise(value))
        return F.when(t == "STRING", _content(value)).when(t.isin("OBJECT", "ARRAY"), nested).when(t != "VOID", printed[0])

    return let(F.struct(tag.alias("tag"), F.transform(numbers, python_number).alias("numbers")), lambda x: F.struct(x["tag"].alias("tag"), text(x).alias("text")))


def listed(arguments: Column) -> Column:
    """(k, tag, text) of a JSON object by first occurrence of the keys, a repeated one with its last value; NULL if the text is no object."""

    def once(items: Column) -> Column:
        keys = F.array_distinct(F.transform(items, lambda e: e["key"]))
        last = lambda k: F.element_at(F.filter(items, lambda e: e["key"] == k), -1)
        return F.when(F.size(keys) == F.size(items), items).otherwise(F.transform(keys, last))

    one = lambda e: let(_read(e["value"]), lambda v: F.struct(_content(e["key"]).alias("k"), v["tag"].alias("tag"), v["text"].alias("text")))
    items = let(F.map_entries(_parsed(arguments, ARGUMENTS)), once)
    return F.when(arguments.rlike(r"^\s*\{"), F.transform(items, one))


def texts(arguments: Column) -> Column:
    """Key -> text of the value, as Python would print a number; NULL if the text is no JSON object."""
    return F.map_from_entries(F.transform(listed(arguments), lambda e: F.struct(e["k"], e["text"])))


def entries(arguments: Column) -> Column:
    """Sorted (k, tag, text) of a JSON object; NULL if the text is none."""
    return F.sort_array(listed(arguments))


def opened(calls: Column) -> Column:
    """Calls with the listed entries of their arguments instead of JSON text, NULL where they are no object; what several others name as a column, so that the text is read once."""
    return F.transform(calls, lambda c: F.struct(c["name"].alias("name"), listed(c["arguments"]).alias("entries")))


def ordered(opened: Column) -> Column:
    """``canonical`` of opened calls."""
    some = lambda c: F.coalesce(F.sort_array(c["entries"]), F.array().cast(ENTRIES))
    return F.transform(opened, lambda c: F.struct(c["name"].alias("name"), some(c).alias("entries")))


def canonical(calls: Column) -> Column:
    """Calls with sorted typed entries instead of JSON text; null or missing arguments are no entries."""
    return ordered(opened(calls))


def quoted(text: Column) -> Column:
    """A JSON string literal, non-ASCII characters kept. Plain ASCII needs no escapes, so no JSON is written for it."""
    return F.when(text.rlike(r"^[\x20\x21\x23-\x5b\x5d-\x7e]*\z"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(_escaped(text))


def _escaped(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def dumps(calls: Column) -> Column:
    """Compact JSON text of calls in canonical form: top-level argument keys sorted, nested order kept."""
    return dumped(canonical(calls))


def dumped(canonical: Column) -> Column:
    """``dumps`` of calls in canonical form."""
    value = lambda e: F.when(e["tag"] == "STRING", quoted(e["text"])).when(e["tag"] == "VOID", F.lit("null")).otherwise(e["text"])
    entry = lambda e: F.concat(quoted(e["k"]), F.lit(":"), value(e))
    call = lambda c: F.concat(F.lit('{"name":'), quoted(c["name"]), F.lit(',"arguments":{'), F.array_join(F.transform(c["entries"], entry), ","), F.lit("}}"))
    return F.concat(F.lit("["), F.array_join(F.transform(canonical, call), ","), F.lit("]"))


def loads(text: Column) -> Column:
    """Call list of JSON text; NULL where it is malformed.

    ``[]`` is a refusal; one object with a name is one call; text arguments are
    parsed again; missing arguments are ``{}``; null ones make the whole
    malformed, as does any item without a name or whose arguments are no object.
    """
    list_text = F.when(text.rlike(r"^\s*\["), text).when(text.rlike(r"^\s*\{"), F.concat(F.lit("["), text, F.lit("]")))
    spoken = lambda t: F.when(t == "null", F.lit("None")).when(t.isin("true", "false"), F.initcap(t)).otherwise(t)
    name = lambda v: F.when(F.endswith(v, F.lit(SCALAR)), _content(v)).when(F.startswith(v, F.lit(STRING)), spoken(F.substring(v, F.lit(3), F.length(v)))).otherwise(_unmarked(v))
    # Arguments as text, NULL unless they are an object or a string that holds one.
    arguments = lambda v: F.when(v.isNull(), F.lit("{}")).when(F.startswith(v, F.lit("{")), _unmarked(v)).when(F.endswith(v, F.lit(SCALAR)), let(_content(v), lambda a: F.when(a.rlike(r"^\s*\{") & _parsed(a, ARGUMENTS).isNotNull(), a)))
    own = lambda m, k: m[STRING + k + SCALAR]
    call = lambda m: F.when(own(m, "name").isNotNull(), F.struct(name(own(m, "name")).alias("name"), arguments(own(m, "arguments")).alias("arguments")))
    calls = F.transform(_parsed(list_text, ITEMS), call)
    return let(calls, lambda cs: F.when(F.forall(cs, lambda c: F.coalesce(c["arguments"].isNotNull(), F.lit(False))), cs))


def strict_equal(a: Column, b: Column) -> Column:
    """Ordered equality of canonical calls; false if either is malformed."""
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))


def names(calls: Column) -> Column:
    return F.transform(calls, lambda c: c["name"])


def name_equal(a: Column, b: Column) -> Column:
    return F.coalesce(names(a) == names(b), F.lit(False))


def _number(tag: Column, text: Column) -> Column:
    return F.when(tag == "BOOLEAN", F.when(text == "true", F.lit(1.0)).otherwise(F.lit(0.0))).when(tag.isin("INT", "FLOAT"), text.try_cast("double"))


def loose_value(e: Column) -> Column:
    """A text that is equal for equal values: numbers and booleans by value, objects with sorted keys."""
    number = _number(e["tag"], e["text"])
    nested = F.to_json(F.try_parse_json(e["text"]))
    return F.when(number.isNotNull(), F.concat(F.lit("n:"), number.cast("string"))).when(e["tag"] == "STRING", F.concat(F.lit("s:"), e["text"])).when(e["tag"] == "VOID", F.lit("null")).otherwise(F.concat(F.lit("j:"), nested))


def loose(calls: Column) -> Column:
    """Calls reduced to what value equality sees."""
    return loosened(canonical(calls))


def loosened(canonical: Column) -> Column:
    """``loose`` of calls in canonical form."""
    return F.transform(canonical, lambda c: F.struct(c["name"].alias("name"), F.transform(c["entries"], lambda e: F.struct(e["k"].alias("k"), loose_value(e).alias("v"))).alias("entries")))


def loose_equal(a: Column, b: Column) -> Column:
    return F.coalesce(loose(a) == loose(b), F.lit(False))


def drop_null_values(arguments: Column) -> Column:
    """Entries without null values."""
    return F.filter(entries(arguments), lambda e: e["tag"] != "VOID")
