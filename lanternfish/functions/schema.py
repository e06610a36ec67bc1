"""Checks of JSON documents against a subset of JSON Schema, as expressions made from the schema once.

A document is parsed into a VARIANT; each node of the schema becomes an array of conditions on the value at its place, so that
documents are checked by built-in functions without a walk in Python.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
#: The variant types of each JSON type; a boolean is no number.
TYPES = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "integer": ("BIGINT",), "number": NUMBERS}
#: Levels of $ref that a schema may have; one that refers to itself has no end.
DEEPEST = 12


def _none() -> Column:
    return F.array().cast("array<string>")


def _resolved(schema: dict, root: dict) -> dict:
    """The schema that a chain of $ref leads to."""
    for _ in range(DEEPEST):
        if "$ref" not in schema:
            return schema
        schema = reduce(lambda at, step: at[step], schema["$ref"].removeprefix("#/").split("/"), root)
    raise ValueError("a schema's $ref leads to no end")


def _conditions(value: Column, schema: dict, path: Column) -> list[tuple[Column, str]]:
    """What fails at this value itself: a test and what is then said."""
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    said, is_number = F.to_json(value), kind.isin(*NUMBERS)
    exact = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    out = []
    if "const" in schema:
        out.append((said != exact(schema["const"]), "not the constant"))
    if "enum" in schema:
        out.append((~said.isin(*map(exact, schema["enum"])), "not one of the allowed values"))
    if "pattern" in schema:
        out.append(((kind == "STRING") & ~F.try_variant_get(value, "$", "string").rlike(schema["pattern"]), "doesn't match the pattern"))
    for name, worse, text in (("minimum", Column.__lt__, "below the minimum"), ("maximum", Column.__gt__, "above the maximum")):
        if name in schema:
            out.append((is_number & worse(F.try_variant_get(value, "$", "double"), F.lit(schema[name])), text))
    return [(F.coalesce(test, F.lit(False)), text) for test, text in out]


def _problems(value: Column, schema: dict, root: dict, path: Column, depth: int = 0) -> Column:
    """An array of what is wrong with a variant at a path."""
    if depth > DEEPEST:
        raise ValueError("the schema is too deep, or refers to itself")
    schema = _resolved(schema, root)
    deeper = lambda v, s, p: _problems(v, s, root, p, depth + 1)
    say = lambda text: F.concat(path, F.lit(f": {text}"))
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    names = schema.get("type", [])
    names = [names] if isinstance(names, str) else names
    right = kind.isin(*[t for n in names for t in TYPES[n]]) if names else F.lit(True)
    parts = [F.array_compact(F.array(*[F.when(test, say(text)) for test, text in _conditions(value, schema, path)]))] if _conditions(value, schema, path) else []
    if schema.get("required"):
        missing = [F.when((kind == "OBJECT") & F.try_variant_get(value, f"$['{k}']", "variant").isNull(), F.concat(path, F.lit(f".{k}: missing"))) for k in schema["required"]]
        parts.append(F.array_compact(F.array(*missing)))
    for name, below in schema.get("properties", {}).items():
        inner = F.try_variant_get(value, f"$['{name}']", "variant")
        parts.append(F.when((kind == "OBJECT") & inner.isNotNull(), deeper(inner, below, F.concat(path, F.lit(f".{name}")))).otherwise(_none()))
    if "items" in schema:
        each = lambda v, i: deeper(v, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        found = F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), each))
        parts.append(F.when(kind == "ARRAY", found).otherwise(_none()))
    here = F.concat(*parts) if parts else _none()
    here = F.when(right, here).otherwise(F.array(say(f"not of type {'/'.join(names)}")))
    if "anyOf" in schema:
        fits = reduce(Column.__or__, [F.size(deeper(value, s, path)) == 0 for s in schema["anyOf"]])
        here = F.concat(F.when(fits, _none()).otherwise(F.array(say("matches none of the alternatives"))), here)
    return here


def checked(document: Column, schema: dict) -> Column:
    """What is wrong with a JSON text, each with its path; a text that isn't JSON has one problem, a null none. Keys that the schema doesn't name are allowed."""
    parsed = F.try_parse_json(document)
    return F.when(document.isNull(), _none()).when(parsed.isNull(), F.array(F.lit("$: not JSON"))).otherwise(_problems(parsed, schema, schema, F.lit("$")))


def enumerated(rows: DataFrame, columns: dict[str, str], catalogue: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows with problems: the columns whose value, or one of whose values, their enumeration doesn't have; a null says nothing wrong."""
    tests = []
    for column, name in columns.items():
        allowed = F.array(*map(F.lit, catalogue[name]))
        values = F.col(column) if rows.schema[column].dataType.typeName() == "array" else F.array(column)
        wrong = F.size(F.array_except(F.array_compact(values), allowed)) > 0
        tests.append(F.when(F.coalesce(wrong, F.lit(False)), F.lit(f"{column}: not one of {name}")))
    return rows.withColumn("problems", F.array_compact(F.array(*tests)))
