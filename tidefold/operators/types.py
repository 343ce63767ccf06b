"""Topic types: versions, admission, migration chains and validation."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema

KINDS = ("unspecified", "snapshot", "event", "command", "standalone", "revision")
SCHEMAS = ("", "JSONSchema", "Protobuf")
#: Functions that give the same output for the same input; a migration may use no others.
STABLE = set(
    "abs array array_contains array_distinct array_join array_max array_min array_position array_remove array_sort array_union base64 bigint boolean ceil ceiling char_length "
    "coalesce concat concat_ws contains date date_add date_diff date_format date_sub day decimal double element_at element endswith exists explode filter floor forall from_json "
    "get greatest hex if ifnull in initcap int isnotnull isnull least left length levenshtein lower lpad ltrim map map_from_arrays map_keys map_values md5 mod month "
    "named_struct nullif nvl nvl2 parse_json pmod pow power regexp_extract regexp_replace repeat replace reverse right round rpad rtrim sequence sha2 sign size slice sort_array "
    "split split_part sqrt startswith string struct substr substring to_date to_json to_number to_timestamp transform translate trim try_add try_cast try_divide "
    "try_multiply try_parse_json try_subtract try_to_number try_to_timestamp try_variant_get typeof unbase64 unhex upper variant_get xxhash64 year zip_with cast".split()
)
#: Words that may stand before a parenthesis without being functions.
WORDS = set("and or not in case when then else between as on like".split())
#: Names that are functions without a parenthesis, and give another value on another run.
CLOCKS = set("current_date current_timestamp current_time localtimestamp now current_user session_user user current_catalog current_database current_schema".split())


def unstable(text: str) -> str | None:
    """The first name in a SQL expression that a migration may not use; columns may have any name but a clock's."""
    bare = re.sub(r"`[^`]*`", "c", re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", "''", text.lower()))
    for name, call in re.findall(r"(?<![\w.])([a-z_]\w*)\s*(\()?", bare):
        if name in CLOCKS or (call and name not in STABLE and name not in WORDS):
            return name
    return None


class TypeError_(ValueError):
    """The type is refused."""


@dataclass(frozen=True)
class Version:
    """transform maps field names to SQL expressions over the earlier payload's fields; None keeps it."""

    number: int
    schema: str = ""
    transform: dict[str, str] | None = None


@dataclass(frozen=True)
class TopicType:
    name: str
    kind: str = "unspecified"
    schema_type: str = ""
    discriminator: str | None = None
    versions: tuple[Version, ...] = field(default_factory=lambda: (Version(1),))

    @property
    def current(self) -> int:
        return self.versions[-1].number


def admitted(new: TopicType, old: TopicType | None = None) -> TopicType:
    if new.kind == "delta":
        raise TypeError_("delta topics are refused")
    if new.kind not in KINDS:
        raise TypeError_(f"entityKind is one of {', '.join(KINDS)}")
    for v in new.versions:
        for text in (v.transform or {}).values():
            if name := unstable(text):
                raise TypeError_(f"a migration gives the same output each time: {name} in {text}")
    if new.schema_type == "JSONSchema":
        for v in new.versions:
            if v.schema:
                schema.checked(json.loads(v.schema))
    if old is not None and old.kind not in ("unspecified", new.kind):
        raise TypeError_("entityKind stays as declared")
    return new


def revised(old: TopicType, schema: str, transform: dict[str, str] | None = None, none: bool = False) -> TopicType:
    """A schema change takes a transform or none=true and makes a new version."""
    if schema == old.versions[-1].schema:
        return old
    if transform is None and not none:
        raise TypeError_("a schema change needs a transform or none=true")
    return admitted(replace(old, versions=(*old.versions, Version(old.current + 1, schema, transform))), old)


def migrated(rows: DataFrame, kind: TopicType, fields: str) -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters) of rows (type_version, data): each later version's transform in order.

    data is JSON read with ``fields``; every step is a projection, the steps that a row has behind it
    leave it as it is. A row whose data is no JSON object, or that a step makes null, is a dead letter."""
    df = rows.withColumn("_p", F.from_json("data", fields, {"mode": "PERMISSIVE"})).withColumn("_ok", F.expr("try_parse_json(data) IS NOT NULL"))
    for v in kind.versions[1:]:
        if v.transform:
            names = [f.name for f in df.schema["_p"].dataType.fields]
            expr = lambda text: F.expr(text)
            df = df.select(*rows.columns, "_p", "_ok", *(F.col(f"_p.{n}").alias(n) if n not in rows.columns else F.lit(None).alias(f"_skip_{n}") for n in names))
            made = F.struct(*(F.when(F.col("type_version") < v.number, expr(v.transform[n]) if n in v.transform else F.col(f"_p.{n}")).otherwise(F.col(f"_p.{n}") if n in names else expr(v.transform[n])).alias(n) for n in dict.fromkeys([*names, *v.transform])))
            df = df.withColumn("_p", made).select(*rows.columns, "_p", "_ok")
    good = F.col("_ok") & F.col("_p").isNotNull()
    return df.where(good).withColumn("payload", F.col("_p")).withColumn("type_version", F.lit(kind.current)).drop("_p", "_ok"), df.where(~F.coalesce(good, F.lit(False))).select(*rows.columns)


def as_mode(rows: DataFrame, kind: TopicType, fields: str, mode: str) -> DataFrame:
    """'as-stored' reads what was written; 'always-current' migrates first."""
    if mode == "as-stored":
        return rows.withColumn("payload", F.from_json("data", fields))
    return migrated(rows, kind, fields)[0]


def validated(rows: DataFrame, fields: str, required: list[str], rules: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``rows`` with valid and reason: JSON, required fields, then rules on fields."""
    df = rows.withColumn("_p", F.from_json("data", fields))
    reason = F.when(F.expr("try_parse_json(data) IS NULL"), F.lit("no JSON"))
    for r in required:
        reason = reason.when(F.col(f"_p.{r}").isNull(), F.lit(f"{r} is missing"))
    for name, rule in (rules or {}).items():
        reason = reason.when(~F.coalesce(rule(F.col(f"_p.{name}")), F.lit(False)), F.lit(f"{name} is out of range"))
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("_p")


def preflight(spark: SparkSession, kind: TopicType, sample: str, fields: str) -> bool:
    """Whether a sample passes the whole chain."""
    one = spark.createDataFrame([(1, sample)], "type_version int, data string")
    return migrated(one, kind, fields)[0].count() == 1


class Registry:
    """Versioned definitions with history and rollback, kept as rows."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, str]] = []

    def put(self, name: str, text: str) -> int:
        n = max([v for k, v, _ in self.rows if k == name], default=0) + 1
        self.rows.append((name, n, text))
        return n

    def get(self, name: str, version: int | None = None) -> str:
        found = [(v, t) for k, v, t in self.rows if k == name and version in (None, v)]
        if not found:
            raise KeyError(name)
        return max(found)[1]

    def history(self, name: str) -> list[int]:
        return sorted(v for k, v, _ in self.rows if k == name)

    def rollback(self, name: str, version: int) -> int:
        return self.put(name, self.get(name, version))


def config_as_of(history: DataFrame, idx: int) -> DataFrame:
    """The definition of each name that holds at a log index, from (name, idx, text)."""
    return history.where(F.col("idx") <= idx).groupBy("name").agg(F.max("idx").alias("idx"), F.max_by("text", "idx").alias("text"))
