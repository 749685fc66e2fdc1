"""Tool catalogs: parsing, cleaning, rendering, lookups.

A tool is ``struct<name, description, props: map<string, struct<type, description,
enum: array<string>>>, required: array<string>>``. Enum values keep their raw text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPEC = "struct<type:string,description:string,enum:array<string>>"
TOOL = f"struct<name:string,description:string,props:map<string,{SPEC}>,required:array<string>>"
TOOLS = f"array<{TOOL}>"
RAW = "array<struct<name:string,description:string,parameters:string>>"

# Type names and their abbreviations in prompts.
TYPES = ("string", "integer", "number", "boolean", "object", "array")
ABBREVIATIONS = {"string": "str", "integer": "int", "number": "num", "boolean": "bool", "object": "obj", "array": "arr"}
# Names that sources use for types.
PYTHON_TYPES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "list": "array", "dict": "object", "any": "string"}
BFCL_TYPES = {"dict": "object", "float": "number", "tuple": "array", "any": "string"}


def _mapped(c: Column, table: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), other)


def python_type(c: Column) -> Column:
    """JSON type of a Python or JSON type name, text after a comma ignored; unknown names are strings."""
    name = F.trim(F.lower(F.substring_index(c, ",", 1)))
    return F.when(name.isin(*TYPES), name).otherwise(_mapped(name, PYTHON_TYPES, F.lit("string")))


def bfcl_type(c: Column) -> Column:
    return _mapped(c, BFCL_TYPES, c)


def lower_type(c: Column) -> Column:
    """Upper-case type names in lower case; unknown ones too."""
    return F.lower(c)


def annotation_type(c: Column) -> Column:
    """JSON type of a Python annotation; capitalised generics by their outer name, Optional by what it holds, anything else is a string."""
    inner = F.regexp_replace(F.trim(c), r"^Optional\[(.*)\]$", "$1")
    outer = F.regexp_extract(inner, r"^([A-Za-z_]+)", 1)
    generic = F.when(outer.isin("List", "Sequence", "Tuple"), "array").when(outer.isin("Dict", "Mapping"), "object").otherwise("string")
    plain = F.when(inner.isin("str", "int", "float", "bool", "list", "dict", "Any"), python_type(inner)).otherwise("string")
    return F.coalesce(F.when(F.contains(inner, F.lit("[")), generic).otherwise(plain), F.lit("string"))


def parse(text: Column) -> Column:
    """Tools of JSON text, as ``[{name, description, parameters: {properties, required}}]``; NULL if malformed.

    Null property specs go; a bare string is a description; ``required`` that is
    no list is empty, and is cut to the properties that stay.
    """
    raw = F.from_json(text, RAW)

    def spec(t: Column) -> Column:
        return F.when(t.rlike(r"^\s*\{"), F.from_json(t, SPEC)).otherwise(F.struct(F.lit(None).cast("string").alias("type"), t.alias("description"), F.lit(None).cast("array<string>").alias("enum")))

    def tool(r: Column) -> Column:
        props = F.from_json(F.get_json_object(r["parameters"], "$.properties"), "map<string,string>")
        props = F.coalesce(F.map_filter(props, lambda k, v: v.isNotNull()), F.create_map().cast("map<string,string>"))
        required = F.from_json(F.get_json_object(r["parameters"], "$.required"), "array<string>")
        kept = F.filter(F.coalesce(required, F.array().cast("array<string>")), lambda x: x.isNotNull() & F.map_contains_key(props, x))
        return F.struct(r["name"].alias("name"), F.coalesce(r["description"], F.lit("")).alias("description"), F.transform_values(props, lambda k, v: spec(v)).alias("props"), kept.alias("required"))

    return F.transform(raw, tool).cast(TOOLS)


def signature(t: Column) -> Column:
    """``- name (k=type! ...) description`` with sorted parameters; ``!`` marks required ones."""

    def part(k: Column) -> Column:
        spec = F.element_at(t["props"], k)
        plain = F.coalesce(spec["type"], F.lit("string"))
        kind = F.when(F.size(spec["enum"]) > 0, F.concat(F.lit("enum("), F.array_join(spec["enum"], "|"), F.lit(")"))).otherwise(_mapped(plain, ABBREVIATIONS, plain))
        return F.concat(k, F.lit("="), kind, F.when(F.array_contains(t["required"], k), "!").otherwise(""))

    return F.concat(F.lit("- "), t["name"], F.lit(" ("), F.array_join(F.transform(F.array_sort(F.map_keys(t["props"])), part), " "), F.lit(") "), F.trim(t["description"]))


def prompt(query: Column, tools: Column) -> Column:
    return F.concat(F.lit("<tools>\n"), F.array_join(F.transform(tools, signature), "\n"), F.lit("\n</tools>\n<query>\n"), query, F.lit("\n</query>\n<call>\n"))


def text_of(t: Column) -> Column:
    """Name, description and parameter names."""
    return F.concat_ws(" ", t["name"], t["description"], F.array_join(F.map_keys(t["props"]), " "))


def named(tools: Column, name: Column) -> Column:
    """The first tool with this name, or NULL; an in-row lookup."""
    return F.try_element_at(F.filter(tools, lambda t: t["name"] == name), F.lit(1))
