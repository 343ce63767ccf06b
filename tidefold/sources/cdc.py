"""Sources: proposals, table snapshots, change feeds; all give log rows.

A change feed is a DataFrame with op ('insert', 'update', 'delete', 'truncate'), txn long (commit order),
pos int, tbl string, and before / after structs of the table's columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import canonical_number, composite_key

#: Categories of source column types; both the snapshot and the stream read by them.
CATEGORIES = {
    "postgres": {"number": "smallint integer bigint numeric real double oid", "bool": "boolean", "json": "json jsonb", "binary": "bytea"},
    "mysql": {"number": "tinyint smallint mediumint int bigint decimal float double bit year", "json": "json", "binary": "binary varbinary tinyblob blob mediumblob longblob"},
    "sqlserver": {"number": "tinyint smallint int bigint decimal numeric money smallmoney real float", "bool": "bit", "binary": "binary varbinary image rowversion"},
}
REFUSED = {"mysql": {"geometry", "point", "linestring", "polygon", "vector"}}


def category(dialect: str, declared: str) -> str:
    name = declared.lower().split("(")[0].split()[0]
    if name in REFUSED.get(dialect, ()):
        raise ValueError(f"{dialect} type {declared} is refused")
    return next((c for c, names in CATEGORIES[dialect].items() if name in names.split()), "text")


def proposal(spark: SparkSession, idx: int, entities: list[dict]) -> DataFrame:
    """An atomic write: entities {typeId, key, data | delete}; order in it is seq."""
    rows = []
    for n, e in enumerate(entities):
        if ("data" in e) == bool(e.get("delete")):
            raise ValueError("an entity has data or delete")
        rows.append((idx, n, e["typeId"], e["key"], "delete" if e.get("delete") else "row", e.get("data"), 0))
    return spark.createDataFrame(rows, "idx long, seq int, topic string, key string, variant string, data string, generation long")


def snapshot(spark: SparkSession, url: str, tbl: str, primary_key: list[str], partitions: int = 0, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A table over JDBC, read in parallel ranges of the first key column if bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=tbl, **options)
    if bounds and partitions > 1:
        reader = reader.options(partitionColumn=primary_key[0], lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def mapped(df: DataFrame, mappings: dict[str, str] | None = None, exclude: list[str] = (), generated: list[str] = ()) -> DataFrame:
    """Columns under their JSON names ({json: column}); all but excluded and generated ones without mappings."""
    if mappings:
        bad = set(mappings.values()) & set(generated)
        if bad:
            raise ValueError(f"generated columns can't be mapped: {sorted(bad)}")
        return df.select(*(F.col(c).alias(j) for j, c in mappings.items()))
    return df.drop(*exclude, *generated)


def rendered(columns: list[tuple[str, T.DataType]], json_columns: list[str] = (), prefix: str = "") -> Column:
    """A row as canonical JSON: sorted names, exact digits; declared JSON texts are embedded if valid."""
    parts = []
    for name, kind in sorted(columns, key=lambda c: c[0]):
        c = F.col(f"{prefix}{name}")
        if isinstance(kind, T.NumericType):
            value = canonical_number(c, kind.simpleString()) if isinstance(kind, T.FractionalType) else c.cast("string")
        elif isinstance(kind, T.BooleanType):
            value = c.cast("string")
        elif isinstance(kind, T.BinaryType):
            value = F.concat(F.lit('"'), F.base64(c), F.lit('"'))
        elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            value = F.to_json(c)
        else:
            quoted = F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), r"^\{\"v\":(.*)\}$", 1)
            value = F.when(F.expr(f"try_parse_json({prefix}{name}) IS NOT NULL"), c).otherwise(quoted) if name in json_columns else quoted
        parts.append(F.concat(F.lit(f'"{name}":'), F.when(c.isNull(), "null").otherwise(value)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def from_table(df: DataFrame, topic: str, primary_key: list[str], idx: Column, generation: int = 0, json_columns: list[str] = ()) -> DataFrame:
    """Log rows of a snapshot."""
    kinds = [(f.name, f.dataType) for f in df.schema.fields]
    return df.select(
        idx.cast("long").alias("idx"), F.lit(0).alias("seq"), F.lit(topic).alias("topic"), composite_key([F.col(c).cast("string") for c in primary_key]).alias("key"),
        F.lit("row").alias("variant"), rendered(kinds, json_columns).alias("data"), F.lit(generation).cast("long").alias("generation"),
    )


def refresh_marker(spark: SparkSession, topic: str, idx: int, generation: int) -> DataFrame:
    return spark.createDataFrame([(idx, 0, topic, "", "refresh", None, generation)], "idx long, seq int, topic string, key string, variant string, data string, generation long")


@dataclass(frozen=True)
class Route:
    """A table, the topic that it feeds, its key, and what of its columns goes into a body (all, if none are named)."""

    table: str
    topic: str
    primary_key: tuple[str, ...]
    columns: tuple[str, ...] = ()
    json_columns: tuple[str, ...] = ()


def routed(routes: list[Route]) -> list[Route]:
    """Admission of the routes of a source: a table feeds one topic, a topic has one table, a key isn't empty."""
    for what, names in (("table", [r.table.lower() for r in routes]), ("topic", [r.topic for r in routes])):
        if twice := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"{what} {sorted(twice)[0]} is named twice")
    for r in routes:
        if not r.primary_key or len(set(r.primary_key)) < len(r.primary_key):
            raise ValueError(f"table {r.table}: the key has columns, each once")
    return routes


def from_changes(feed: DataFrame, routes: list[Route], generation: int = 0) -> DataFrame:
    """Log rows of a change feed: deletes are tombstones, an update that changes the key is an upsert of
    the new and a tombstone of the old one, truncation isn't propagated; a transaction shares its idx.

    Bodies are those of ``from_table``. before and after have the columns of all routed tables; rows carry
    the generation of the source's last snapshot, so a refresh doesn't sweep what the feed wrote since."""
    kinds = {f.name: f.dataType for f in feed.schema["after"].dataType.fields}
    old = new = body = topic = None
    for r in routed(routes):
        key = lambda side, r=r: composite_key([F.col(f"{side}.{c}").cast("string") for c in r.primary_key])
        made = key("before"), key("after"), rendered([(c, kinds[c]) for c in r.columns or kinds], r.json_columns, "after."), F.lit(r.topic)
        here = F.col("tbl") == r.table
        old, new, body, topic = (F.when(here, m) if x is None else x.when(here, m) for x, m in zip((old, new, body, topic), made, strict=True))
    upsert = F.struct(new.alias("key"), F.lit("row").alias("variant"), body.alias("data"))
    gone = F.struct(old.alias("key"), F.lit("delete").alias("variant"), F.lit(None).cast("string").alias("data"))
    acts = F.when(F.col("op") == "delete", F.array(gone)).when((F.col("op") == "update") & (old != new), F.array(upsert, gone)).when(F.col("op").isin("insert", "update"), F.array(upsert))
    rows = feed.where(F.col("op") != "truncate").select(F.col("txn").alias("idx"), topic.alias("topic"), F.col("pos"), F.posexplode(acts).alias("_n", "_a")).where(F.col("topic").isNotNull())
    return rows.select("idx", (F.col("pos") * 2 + F.col("_n")).cast("int").alias("seq"), "topic", "_a.key", "_a.variant", "_a.data", F.lit(generation).cast("long").alias("generation"))


def truncations(feed: DataFrame) -> DataFrame:
    """(txn, tbl) of truncations, which change nothing downstream; whoever runs the source is told of them."""
    return feed.where(F.col("op") == "truncate").select("txn", "tbl").distinct()


def change_files(spark: SparkSession, path: str, columns: str, files_per_batch: int = 100) -> DataFrame:
    """A change feed as a stream of JSON lines files {op, txn, pos, tbl, before, after}, as log readers write them.

    Files are taken in the order of their times; each is one or more whole transactions."""
    schema = f"op string, txn long, pos int, tbl string, before struct<{columns}>, after struct<{columns}>"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def mysql_json_number(text: Column) -> Column:
    """A number inside a JSON document in the form in which both the table and the log of changes give it: whole
    doubles without a fraction, exponents written out, no negative zero; what is no number gives null."""
    return canonical_number(text)


def refilled(changes: DataFrame, columns: list[str], current: DataFrame, key: str) -> DataFrame:
    """Columns that a change left out as unchanged (listed in ``unchanged``) come from the base table."""
    base = current.select(key, *(F.col(c).alias(f"_base_{c}") for c in columns))
    joined = changes.join(base, key, "left")
    return joined.withColumns({c: F.when(F.array_contains("unchanged", c), F.col(f"_base_{c}")).otherwise(F.col(c)) for c in columns}).drop(*(f"_base_{c}" for c in columns))


def change_tracking(changes: DataFrame, base: DataFrame, primary_key: list[str]) -> DataFrame:
    """A poll of changed keys (op) left-joined to the table; a changed row that is gone by now is skipped."""
    marked = base.withColumn("_there", F.lit(True))
    out = changes.join(marked, primary_key, "left")
    return out.where((F.col("op") == "delete") | F.col("_there")).drop("_there")


def transcoded(raw: Column, charset: str) -> Column:
    return F.decode(raw, charset)


def key_coverage(feed: DataFrame, primary_key: list[str]) -> DataFrame:
    """Deletes and updates whose before image lacks a key column; none may be left before a start."""
    lacks = reduce(lambda a, b: a | b, [F.col(f"before.{c}").isNull() for c in primary_key])
    return feed.where(F.col("op").isin("delete", "update") & (F.col("before").isNull() | lacks))


def drift(old: T.StructType, new: T.StructType, primary_key: list[str], mapped_columns: list[str]) -> tuple[list[str], list[str]]:
    """(missing key columns: park the source, missing mapped columns: warn and read null)."""
    have = set(new.names)
    return [c for c in primary_key if c not in have], [c for c in mapped_columns if c not in have and c not in primary_key and c in old.names]


def status(log: DataFrame, head: int | None = None, snapshot_done: bool = True) -> DataFrame:
    """By topic: entities, last_idx, epoch, phase ('snapshot' until the first one is whole, then 'streaming'), and
    with the source's newest position lag and caught_up."""
    out = log.groupBy("topic").agg(F.count("*").alias("entities"), F.max("idx").alias("last_idx"), F.max("generation").alias("epoch"))
    out = out.withColumn("phase", F.lit("streaming" if snapshot_done else "snapshot"))
    lag = F.greatest(F.lit(0).cast("long"), F.lit(head) - F.col("last_idx")) if head is not None else F.lit(None).cast("long")
    return out.withColumn("lag", lag).withColumn("caught_up", F.lit(snapshot_done) & (F.col("lag") == 0))
