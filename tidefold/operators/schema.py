"""JSON Schema as one boolean column over a VARIANT, for checking bodies when they are proposed."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords that say nothing about validity.
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
KNOWN = set("type enum const properties required additionalProperties items minItems maxItems minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern allOf anyOf oneOf not".split())
TYPES = ("object", "array", "string", "number", "integer", "boolean", "null")


class SchemaError(ValueError):
    """The schema is refused."""


def checked(schema: dict | bool, at: str = "$") -> dict | bool:
    """Admission: known keywords only, so that none is passed over in silence."""
    if isinstance(schema, bool):
        return schema
    if not isinstance(schema, dict):
        raise SchemaError(f"{at}: a schema is an object or a boolean")
    if extra := set(schema) - KNOWN - NOTES:
        raise SchemaError(f"{at}: {sorted(extra)[0]} isn't supported")
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in TYPES:
            raise SchemaError(f"{at}: no type {kind}")
    if "pattern" in schema:
        try:
            re.compile(schema["pattern"])
        except re.error as e:
            raise SchemaError(f"{at}: pattern: {e}") from e
    for name, part in schema.get("properties", {}).items():
        checked(part, f"{at}.{name}")
    for key in ("items", "not", "additionalProperties"):
        if key in schema:
            checked(schema[key], f"{at}/{key}")
    for key in ("allOf", "anyOf", "oneOf"):
        for n, part in enumerate(schema.get(key, [])):
            checked(part, f"{at}/{key}/{n}")
    return schema


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _same(v: Column, value: object) -> Column:
    """Equal JSON values; numbers by value."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _shape(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(v, "$", "double") == float(value))
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _shape(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is(v: Column, kind: str) -> Column:
    shape = _shape(v)
    number = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if kind == "integer":
        return number & F.coalesce(F.try_variant_get(v, "$", "decimal(38,12)") % 1 == 0, shape == "BIGINT")
    return {"object": shape.startswith("OBJECT"), "array": shape.startswith("ARRAY"), "string": shape == "STRING", "number": number, "boolean": shape == "BOOLEAN", "null": shape == "VOID"}[kind]


def valid(v: Column, schema: dict | bool) -> Column:
    """Whether a VARIANT fits; never null for a VARIANT that isn't SQL null."""
    if isinstance(schema, bool):
        return F.lit(schema)
    out: list[Column] = []
    if "type" in schema:
        out.append(_any([_is(v, k) for k in ([schema["type"]] if isinstance(schema["type"], str) else schema["type"])]))
    if "enum" in schema:
        out.append(_any([_same(v, x) for x in schema["enum"]]))
    if "const" in schema:
        out.append(_same(v, schema["const"]))
    number = F.try_variant_get(v, "$", "double")
    for key, test in (("minimum", number.__ge__), ("maximum", number.__le__), ("exclusiveMinimum", number.__gt__), ("exclusiveMaximum", number.__lt__)):
        if key in schema:
            out.append(~_is(v, "number") | test(float(schema[key])))
    if "multipleOf" in schema:
        out.append(~_is(v, "number") | (F.try_variant_get(v, "$", "decimal(38,12)") % F.lit(schema["multipleOf"]).cast("decimal(38,12)") == 0))
    text = F.try_variant_get(v, "$", "string")
    for key, test in (("minLength", lambda n: F.char_length(text) >= n), ("maxLength", lambda n: F.char_length(text) <= n), ("pattern", text.rlike)):
        if key in schema:
            out.append(~_is(v, "string") | test(schema[key]))
    each = F.try_variant_get(v, "$", "array<variant>")
    for key, test in (("minItems", lambda n: F.size(each) >= n), ("maxItems", lambda n: F.size(each) <= n), ("items", lambda part: F.forall(each, lambda x: valid(x, part)))):
        if key in schema:
            out.append(~_is(v, "array") | test(schema[key]))
    own: list[Column] = []
    for name in schema.get("required", []):
        own.append(_at(v, name).isNotNull())
    for name, part in schema.get("properties", {}).items():
        own.append(F.when(_at(v, name).isNotNull(), valid(_at(v, name), part)).otherwise(True))
    if "additionalProperties" in schema:
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        rest = F.filter(entries, lambda e: ~e.key.isin(*schema.get("properties", {}) or [""]) if schema.get("properties") else F.lit(True))
        own.append(F.forall(rest, lambda e: valid(e.value, schema["additionalProperties"])))
    if own:
        out.append(~_is(v, "object") | _all(own))
    for key, join in (("allOf", _all), ("anyOf", _any)):
        if key in schema:
            out.append(join([valid(v, part) for part in schema[key]]))
    if "oneOf" in schema:
        out.append(reduce(lambda a, b: a + b, [valid(v, part).cast("int") for part in schema["oneOf"]], F.lit(0)) == 1)
    if "not" in schema:
        out.append(~valid(v, schema["not"]))
    return F.coalesce(_all(out), F.lit(False))


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, "$['" + name.replace("'", "''") + "']", "variant")


def proposed(rows: DataFrame, schema: dict | str) -> tuple[DataFrame, DataFrame]:
    """(rows whose data fits, the others with a reason) of rows with data as JSON text."""
    schema = checked(json.loads(schema) if isinstance(schema, str) else schema)
    df = rows.withColumn("_v", F.expr("try_parse_json(data)"))
    reason = F.when(F.col("_v").isNull(), "no JSON").when(~valid(F.col("_v"), schema), "not as the schema says")
    df = df.withColumn("reason", reason).drop("_v")
    return df.where("reason IS NULL").drop("reason"), df.where("reason IS NOT NULL")
