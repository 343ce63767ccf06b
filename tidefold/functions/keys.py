"""Key identity: canonical numbers, key parts and composite keys, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$"


def minimal_decimal(text: Column) -> Column:
    """The text of a plain decimal without trailing zeros, trailing point or negative zero."""
    bare = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), "[.]$", "")).otherwise(text)
    return F.when(bare.isin("-0", ""), F.lit("0")).otherwise(bare)


def canonical_number(value: Column, kind: str = "string") -> Column:
    """5, 5.0000 and 5e0 give '5'; 5.25 stays; -0 gives '0'; what is no number gives null."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("string")
    if kind.startswith("decimal"):
        return minimal_decimal(value.cast("string"))
    if kind in ("float", "double"):
        return minimal_decimal(value.cast("decimal(38,12)").cast("string"))
    text = value.cast("string")
    plain = text.rlike(r"^-?[0-9]+([.][0-9]+)?$")
    whole = minimal_decimal(F.regexp_replace(text, r"^(-?)0+(?=[0-9])", "$1"))
    return F.when(plain, whole).when(text.rlike(NUMBER), minimal_decimal(text.try_cast("decimal(38,12)").cast("string")))


def key_part(value: Column, kind: str = "string", key_type: str | None = None, normalize: str | None = None) -> Column:
    """One key part as text. Numbers are canonical; key_type 'number' also reads texts as numbers
    (unreadable: null, so the input is no member); normalize 'lower' lower-cases."""
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    out = canonical_number(value, kind) if numeric or key_type == "number" else value.cast("string")
    return F.lower(out) if normalize == "lower" else out


def _escaped(json: Column) -> Column:
    for c in "<>&\u2028\u2029":
        json = F.replace(json, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return json


def composite_key(parts: list[Column]) -> Column:
    """A bare value for one part; for several a JSON array of texts in the given order, or, where a
    binary part is no UTF-8, 'b64:' and the parts in base64 joined by points."""
    if len(parts) == 1:
        return parts[0]
    return _escaped(F.to_json(F.array(*(p.cast("string") for p in parts))))


def composite_key_binary(parts: list[Column]) -> Column:
    texts = [p.cast("string") for p in parts]
    sound = reduce(lambda a, b: a & b, [F.is_valid_utf8(t) for t in texts])
    return F.when(sound, composite_key(texts)).otherwise(F.concat(F.lit("b64:"), F.concat_ws(".", *(F.base64(p) for p in parts))))


def decode_composite(key: Column, arity: int) -> Column:
    """The parts by position; null where the arity differs (an error to the caller)."""
    coded = F.transform(F.split(F.substring(key, 5, 1 << 30), "[.]"), lambda p: F.decode(F.unbase64(p), "UTF-8"))
    parts = F.when(key.startswith("b64:"), coded).otherwise(F.from_json(key, "array<string>"))
    return F.when(F.size(parts) == arity, parts)
