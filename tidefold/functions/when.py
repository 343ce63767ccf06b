"""Clause lists (``when`` / ``where``) as one boolean column that is never null."""

from __future__ import annotations

from functools import reduce
from numbers import Number

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import evaluate, parse
from .scope import Scope, Value, narrowed

ARMS = ("equals", "notEquals", "null", "notNull", "greaterThan", "lessThan")


class WhenError(ValueError):
    """The clause is refused."""


def checked(clauses: list[dict]) -> list[dict]:
    """Admission: exactly one arm; scalar literals; numeric bounds; ``null`` and ``notNull`` only true."""
    for c in clauses:
        arms = [k for k in c if k in ARMS]
        if "expr" in c:
            if len(c) > 1:
                raise WhenError("expr stands alone")
            parse(c["expr"])
            continue
        if "path" not in c or len(arms) != 1 or set(c) - {"path", *ARMS}:
            raise WhenError(f"a clause has a path and one of {', '.join(ARMS)}: {c}")
        arm, value = arms[0], c[arms[0]]
        if arm in ("null", "notNull") and value is not True:
            raise WhenError(f"{arm} is true or left out")
        if arm in ("greaterThan", "lessThan") and (isinstance(value, bool) or not isinstance(value, Number)):
            raise WhenError(f"{arm} takes a number")
        if arm in ("equals", "notEquals") and not isinstance(value, (str, bool, Number)):
            raise WhenError(f"{arm} takes a scalar")
    return clauses


def _family(value: object) -> str:
    return "bool" if isinstance(value, bool) else "str" if isinstance(value, str) else "num"


def _number(v: Value) -> tuple[Column, Column]:
    x, ok = narrowed(v, "num")
    return x.cast("double"), ok


def clause(c: dict, scope: Scope) -> Column:
    if "expr" in c:
        v = evaluate(c["expr"], scope)
        return F.coalesce(v.col & (~v.err if v.err is not None else F.lit(True)), F.lit(False)) if v.fam == "bool" else F.lit(False)
    v = scope.get(c["path"])
    arm = next(k for k in ARMS if k in c)
    null = F.is_variant_null(v.col) if v.fam == "any" else v.col.isNull() & (v.present if v.present is not None else F.lit(True))
    if arm == "null":
        return F.coalesce(null, F.lit(False))
    if arm == "notNull":
        return F.coalesce(v.col.isNotNull() & ~null, F.lit(False))
    if arm in ("greaterThan", "lessThan"):
        x, ok = _number(v)
        return F.coalesce(ok & (x > float(c[arm]) if arm == "greaterThan" else x < float(c[arm])), F.lit(False))
    fam = _family(c[arm])
    x, ok = _number(v) if fam == "num" else narrowed(v, fam)
    same = x == F.lit(float(c[arm]) if fam == "num" else c[arm])
    return F.coalesce(ok & (same if arm == "equals" else ~same), F.lit(False))


def matches(clauses: list[dict] | str | None, scope: Scope, discriminator: str | None = None) -> Column:
    """All clauses; none match everything. A bare text compares the type's discriminator path."""
    if isinstance(clauses, str):
        if not discriminator:
            raise WhenError("the type has no discriminator")
        clauses = [{"path": discriminator, "equals": clauses}]
    return reduce(lambda a, b: a & b, [clause(c, scope) for c in checked(clauses or [])], F.lit(True))
