"""Where paths find their values: payload structs (or VARIANT), named joined rows, the parent of a fan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = re.compile(r"\.([A-Za-z_][A-Za-z0-9_]*)|\[(\d+)\]|\['((?:[^']|'')*)'\]")
MONEY = "decimal(18,6)"


class PathError(ValueError):
    pass


def steps(path: str) -> list[str | int]:
    """The steps of ``$.a.b``, ``$['k']`` and ``$parent.a``; the whole payload is []."""
    if not path.startswith("$"):
        raise PathError(f"a path starts with $: {path}")
    rest, out, at = path[1:], [], 0
    if rest.startswith("parent"):
        out, rest = ["$parent"], rest[6:]
    while at < len(rest):
        m = STEP.match(rest, at)
        if not m:
            raise PathError(f"a path names one value: {path}")
        out.append(int(m[2]) if m[2] is not None else m[1] or m[3].replace("''", "'"))
        at = m.end()
    return out


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "num"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return "obj"
    if isinstance(kind, T.NullType):
        return "null"
    return "str"


@dataclass
class Value:
    """A column, its family (num, str, bool, obj, null, any) and where it is a data error."""

    col: Column
    fam: str
    kind: T.DataType = field(default_factory=T.StringType)
    err: Column | None = None
    present: Column | None = None  # for null against missing; None: always there

    def number(self) -> Column:
        """As DECIMAL; doubles are read at the scale of MONEY."""
        if isinstance(self.kind, (T.DoubleType, T.FloatType)):
            return self.col.cast(MONEY)
        if isinstance(self.kind, T.IntegralType):
            return self.col.cast("decimal(19,0)")
        return self.col


def text_of(v: Value) -> Column:
    if isinstance(v.kind, (T.TimestampType, T.DateType)):
        return v.col.cast("string")
    return v.col


@dataclass
class Scope:
    """Named structs with their types. '' is the payload."""

    rows: dict[str, tuple[Column, T.DataType]]

    def get(self, path: str) -> Value:
        way = steps(path)
        name = way[0] if way and way[0] in self.rows else ""
        col, kind = self.rows[name]
        for step in way[1:] if name else way:
            if isinstance(kind, T.StructType):
                hit = [f for f in kind.fields if f.name == step]
                if not hit:  # a path that the topic's schema doesn't have is missing everywhere
                    return Value(F.lit(None).cast("string"), "null", T.NullType(), present=F.lit(False))
                col, kind = col.getField(step), hit[0].dataType
            elif isinstance(kind, T.ArrayType) and isinstance(step, int):
                col, kind = F.get(col, step), kind.elementType
            elif isinstance(kind, T.MapType):
                col, kind = F.element_at(col, F.lit(step)), kind.valueType
            elif isinstance(kind, T.VariantType):
                tail = "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in (way[1:] if name else way))
                got = F.try_variant_get(self.rows[name][0], tail, "variant")
                return Value(got, "any", kind, present=got.isNotNull())
            else:
                return Value(F.lit(None).cast("string"), "null", T.NullType(), present=F.lit(False))
        return Value(col, "any" if isinstance(kind, T.VariantType) else family(kind), kind)


def narrowed(v: Value, fam: str) -> tuple[Column, Column]:
    """(value in the family or null, whether it is of the family); for VARIANT the family is found row by row."""
    if v.fam != "any":
        same = v.fam == fam
        return (v.number() if fam == "num" else text_of(v)) if same else F.lit(None).cast({"num": MONEY, "str": "string", "bool": "boolean"}[fam]), F.lit(same) & v.col.isNotNull()
    shape = F.schema_of_variant(v.col)
    if fam == "num":
        return F.try_variant_get(v.col, "$", "decimal(38,12)"), F.coalesce(shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.lit(False))
    if fam == "str":
        return F.try_variant_get(v.col, "$", "string"), F.coalesce(shape == "STRING", F.lit(False))
    return F.try_variant_get(v.col, "$", "boolean"), F.coalesce(shape == "BOOLEAN", F.lit(False))
