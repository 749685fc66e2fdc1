"""Grounding, validation and repair of call examples. Row by row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions import tools as T
from ..functions.text import glue, iso_date_evidenced, let

# Calls that a template asks for; and, in ``error``, the texts of the errors, which are results.
TEMPLATES = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}


def grounded(query: Column, calls: Column) -> Column:
    """Whether the query tells every argument: strings of more than two characters and all numbers, without regard to punctuation; other values pass."""
    return told(query, C.opened(calls))


def told(query: Column, opened: Column) -> Column:
    """``grounded`` of opened calls."""
    said = lambda q, e: F.contains(q, glue(e["text"]))
    fine = lambda q, e: F.when((e["tag"] == "STRING") & (F.length(e["text"]) > 2), said(q, e)).when(e["tag"].isin("INT", "FLOAT"), said(q, e)).otherwise(F.lit(True))
    return let(glue(query), lambda q: F.forall(opened, lambda c: F.coalesce(F.forall(c["entries"], lambda e: fine(q, e)), F.lit(False))))


def _first(errors: Column) -> Column:
    return F.try_element_at(F.filter(errors, lambda x: x.isNotNull()), F.lit(1))


def _large(text: Column) -> Column:
    return F.coalesce(F.abs(text.try_cast("double")) > 1, F.lit(False))


def error(query: Column, tools: Column, answers: Column, template: Column) -> Column:
    """The first rule that an example breaks, or NULL.

    In order: a query; a call list; calls as the template wants; per call a
    known tool, arguments, required parameters, and per argument a known
    parameter, its enum, its type, and evidence in the query.
    """
    want = F.try_element_at(F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv]), template)

    def argument(tool: Column, name: Column, spec: Column, e: Column) -> Column:
        k, tag, text = e["k"], e["tag"], e["text"]
        kind = F.coalesce(spec["type"], F.lit("string"))
        told = F.contains(F.lower(query), F.lower(text)) | iso_date_evidenced(text, query)
        number = tag.isin("INT", "FLOAT")
        return (
            F.when(~F.map_contains_key(tool["props"], k), F.concat(name, F.lit(" has no parameter "), k))
            .when((F.size(spec["enum"]) > 0) & ~F.array_contains(spec["enum"], F.coalesce(text, F.lit("null"))), F.concat(k, F.lit(" not in enum ["), F.array_join(spec["enum"], ", "), F.lit("]")))
            .when((kind == "integer") & ~tag.isin("INT", "BOOLEAN"), F.concat(k, F.lit(" must be integer")))
            .when((kind == "number") & ~tag.isin("INT", "FLOAT", "BOOLEAN"), F.concat(k, F.lit(" must be number")))
            .when((kind == "boolean") & (tag != "BOOLEAN"), F.concat(k, F.lit(" must be boolean")))
            .when((kind == "string") & (tag != "STRING"), F.concat(k, F.lit(" must be string")))
            .when((kind == "string") & (F.length(text) > 2) & ~told, F.concat(F.lit("value '"), text, F.lit("' for "), k, F.lit(" not evidenced in query")))
            .when(kind.isin("integer", "number") & number & ~F.contains(query, text) & _large(text), F.concat(F.lit("number "), text, F.lit(" for "), k, F.lit(" not evidenced in query")))
        )

    def judged(x: Column) -> Column:
        name, tool, given = x["name"], x["tool"], x["given"]
        missing = F.array_sort(F.array_except(tool["required"], F.transform(given, lambda e: e["k"])))
        each = F.transform(given, lambda e: let(F.try_element_at(tool["props"], e["k"]), lambda spec: argument(tool, name, spec, e)))
        return (
            F.when(tool.isNull(), F.concat(F.lit("unknown tool "), name))
            .when(given.isNull(), F.lit("arguments must be an object"))
            .when(F.size(missing) > 0, F.concat(name, F.lit(" missing required ['"), F.array_join(missing, "', '"), F.lit("']")))
            .otherwise(_first(each))
        )

    # The tool is looked up and the arguments are read once for each call.
    call = lambda c: let(F.struct(c["name"].alias("name"), T.named(tools, c["name"]).alias("tool"), C.listed(c["arguments"]).alias("given")), judged)

    return (
        F.when(F.coalesce(F.trim(query), F.lit("")) == "", "missing query")
        .when(answers.isNull(), "answers must be a list")
        .when(template == "refuse", F.when(F.size(answers) > 0, "refuse template must have answers=[]"))
        .when(F.size(answers) == 0, "empty answers for non-refuse template")
        .when(want.isNotNull() & (F.size(answers) != want), F.concat(F.lit("template "), template, F.lit(" needs "), want, F.lit(" calls, got "), F.size(answers)))
        .otherwise(_first(F.transform(answers, call)))
    )


def repaired(query: Column, tools: Column, answers: Column) -> Column:
    """Calls with canonical entries, less the optional arguments that the query does not tell."""
    q = F.lower(query)

    def stays(tool: Column, e: Column) -> Column:
        text = e["text"]
        vague = (e["tag"] == "STRING") & (F.length(text) > 2) & ~F.contains(q, F.lower(text)) & ~iso_date_evidenced(text, query)
        number = e["tag"].isin("INT", "FLOAT") & ~F.contains(query, text) & _large(text)
        return tool.isNull() | F.array_contains(tool["required"], e["k"]) | ~(vague | number)

    kept = lambda c: let(T.named(tools, c["name"]), lambda tool: F.filter(c["entries"], lambda e: stays(tool, e)))
    return F.transform(C.canonical(answers), lambda c: F.struct(c["name"].alias("name"), kept(c).alias("entries")))


def sound_catalog(text: Column) -> Column:
    """Whether an invented catalog can be used: two to nine tools with distinct names, parameters that are objects of known types."""
    items = F.from_json(text, "array<map<string,string>>")
    kinds = F.from_json(text, "array<struct<name:variant,parameters:variant>>")
    name_ok = F.forall(kinds, lambda t: F.coalesce(F.schema_of_variant(t["name"]) == "STRING", F.lit(False)))
    props = lambda m: F.get_json_object(F.try_element_at(m, F.lit("parameters")), "$.properties")
    bare = lambda m: F.coalesce(F.try_element_at(m, F.lit("parameters")), F.lit("{}")).isin("{}", "")
    specs = lambda m: F.map_values(F.from_json(props(m), "map<string,string>"))
    kind = lambda s: F.get_json_object(s, "$.type")
    fine = lambda s: F.coalesce(s.rlike(r"^\s*\{") & (kind(s).isNull() | kind(s).isin(*T.TYPES)), F.lit(False))
    parameters = F.forall(items, lambda m: F.when(props(m).isNull(), bare(m)).otherwise(props(m).rlike(r"^\s*\{") & F.forall(specs(m), fine)))
    names = F.transform(items, lambda m: F.trim(F.try_element_at(m, F.lit("name"))))
    unique = F.size(F.array_distinct(names)) == F.size(names)
    return F.coalesce(text.rlike(r"^\s*\[") & F.size(items).between(2, 9) & name_ok & parameters & unique, F.lit(False))


def omits_option(tools: Column, answers: Column) -> Column:
    """Whether some call leaves out an optional parameter while it uses another one."""

    def one(c: Column) -> Column:
        optional = let(T.named(tools, c["name"]), lambda tool: F.array_except(F.map_keys(tool["props"]), tool["required"]))
        used = F.transform(C.listed(c["arguments"]), lambda e: e["k"])
        both = F.struct(optional.alias("optional"), used.alias("used"))
        return let(both, lambda x: (F.size(F.array_except(x["optional"], x["used"])) > 0) & (F.size(F.array_intersect(x["optional"], x["used"])) > 0))

    return F.coalesce(F.exists(answers, lambda c: F.coalesce(one(c), F.lit(False))), F.lit(False))


def well_formed(tools: Column, answers: Column) -> Column:
    """Every call names a tool of the catalog and uses its parameters only."""
    return F.forall(answers, lambda c: T.named(tools, c["name"]).isNotNull() & (F.size(F.array_except(F.map_keys(C.texts(c["arguments"])), F.map_keys(T.named(tools, c["name"])["props"]))) == 0))
