"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import evaluate
from ..functions.scope import Scope
from ..functions.when import matches
from ..operators import log as L
from ..operators import schema, sinks, types
from ..operators.projection import dead, project
from ..operators.stages import Graph, flat
from ..sources import cdc
from ..streaming.driver import View

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def events(s: SparkSession, d: str, key: str = "event_id", variant=None, generation=None) -> DataFrame:
    """The event table as a topic; props is read as JSON with the one field that views use."""
    df = table(s, d, "events").select("event_id", "user_id", "event_type", "value", F.from_json("props", "k bigint").alias("props"))
    return L.envelope(df, F.col("event_id"), F.col(key), variant, generation)


def snapshot(s: SparkSession, d: str, name: str, key: str, columns: list[str] | None = None, variant=None) -> DataFrame:
    """A table as a snapshot topic; idx is its key, or the number given."""
    df = table(s, d, name)
    df = df.select(*columns) if columns else df
    return L.envelope(df, F.col(key).cast("long"), F.col(key), variant)


def orders(s, d, **k):
    df = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    return L.envelope(df, F.col("o_orderkey"), F.col("o_orderkey"), **k)


def lines(s, d):
    """Order lines with a key of their own: the table's (order, line) pairs repeat, so lines are numbered by all columns."""
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")


#: Tables whose keys come once.
SNAPSHOTS = {"orders", "customer", "nation", "region", "part", "baskets"}


def staged(topics: dict[str, DataFrame], *stages: dict, unique: set[str] = frozenset()) -> DataFrame:
    return flat(Graph(topics, list(stages), unique=unique | (SNAPSHOTS & set(topics))).out[stages[-1]["name"]])


def scope_of(df: DataFrame) -> Scope:
    return Scope({"": (F.col("payload"), df.schema["payload"].dataType)})


def by_clause(s, d, clauses) -> DataFrame:
    df = events(s, d)
    return df.where(matches(clauses, scope_of(df))).select("key")


def with_expr(s, d, name: str, key: str, text: str, columns: list[str] | None = None, kind: str | None = None) -> DataFrame:
    df = snapshot(s, d, name, key, columns)
    v = evaluate(text, scope_of(df))
    return df.select("key", (v.col.cast(kind) if kind else v.col).alias("out"))


# predicates


@query("SELECT CAST(event_id AS VARCHAR) AS key FROM events WHERE event_type = 'click'")
def when_equals(s, d):
    return by_clause(s, d, [{"path": "$.event_type", "equals": "click"}])


@query("SELECT CAST(event_id AS VARCHAR) AS key FROM events WHERE event_type <> 'view'")
def when_not_equals(s, d):
    return by_clause(s, d, [{"path": "$.event_type", "notEquals": "view"}])


@query("SELECT CAST(event_id AS VARCHAR) AS key FROM events WHERE value > 20 AND value < 80.5")
def when_range(s, d):
    return by_clause(s, d, [{"path": "$.value", "greaterThan": 20}, {"path": "$.value", "lessThan": 80.5}])


@query("SELECT CAST(event_id AS VARCHAR) AS key FROM events WHERE CAST(props->>'k' AS BIGINT) % 3 = 0")
def when_null(s, d):
    """Every third k is null."""
    df = table(s, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k0"))
    topic = L.envelope(df.select("event_id", F.when(F.col("k0") % 3 != 0, F.col("k0")).alias("k")), F.col("event_id"), F.col("event_id"))
    return topic.where(matches([{"path": "$.k", "null": True}], scope_of(topic))).select("key")


@query("SELECT CAST(event_id AS VARCHAR) AS key FROM events WHERE CAST(props->>'k' AS BIGINT) IS NOT NULL AND event_type = 'error'")
def when_not_null(s, d):
    return by_clause(s, d, [{"path": "$.props.k", "notNull": True}, {"path": "$.event_type", "equals": "error"}])


@query("SELECT CAST(event_id AS VARCHAR) AS key FROM events WHERE user_id * 2 > event_id OR event_type IN ('signup', 'error')")
def when_expr(s, d):
    return by_clause(s, d, [{"expr": "$.user_id * 2 > $.event_id or $.event_type in ('signup', 'error')"}])


# expressions


@query("SELECT CAST(l AS VARCHAR) AS key, v AS out FROM (SELECT p_partkey AS l, CAST(CAST(p_retailprice AS DECIMAL(18,6)) * p_size + 1.5 AS DECIMAL(38,6)) AS v FROM part)")
def expr_arith(s, d):
    return with_expr(s, d, "part", "p_partkey", "$.p_retailprice * $.p_size + 1.5", kind="decimal(38,6)")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(round(p_size * 4 / 16.0, 2) AS DECIMAL(38,2)) AS out FROM part")
def expr_div_round(s, d):
    return with_expr(s, d, "part", "p_partkey", "round($.p_size * 4 / 16, 2)")


@query("SELECT CAST(event_id AS VARCHAR) AS key, (event_type = 'click' AND NOT k > 50) OR (k IS NULL AND NULL) AS out FROM (SELECT *, CAST(props->>'k' AS BIGINT) AS k FROM events)")
def expr_bool3(s, d):
    df = events(s, d)
    return df.select("key", evaluate("($.event_type = 'click' and not $.props.k > 50) or ($.props.k is null and null = 1)", scope_of(df)).col.alias("out"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_size IN (1, 5, 10, 15) AS out FROM part")
def expr_in(s, d):
    return with_expr(s, d, "part", "p_partkey", "$.p_size in (1, 5, 10, 15)")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL AS out FROM customer")
def expr_is_null(s, d):
    return with_expr(s, d, "customer", "c_custkey", "$.c_mktsegment is not null and $.c_acctbal is not null")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, coalesce(nullif(o_orderstatus, 'O'), o_orderpriority) AS out FROM orders")
def expr_coalesce_nullif(s, d):
    return with_expr(s, d, "orders", "o_orderkey", "coalesce(nullif($.o_orderstatus, 'O'), $.o_orderpriority)")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(round(CAST(c_acctbal AS DECIMAL(18,6)), 1) AS DECIMAL(38,1)) AS out FROM customer")
def expr_round(s, d):
    return with_expr(s, d, "customer", "c_custkey", "round($.c_acctbal, 1)")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(trunc(CAST(c_acctbal AS DECIMAL(18,6))) AS DECIMAL(38,0)) AS out FROM customer")
def expr_trunc(s, d):
    return with_expr(s, d, "customer", "c_custkey", "trunc($.c_acctbal)")


# stages

EV = {"from": "events", "keyPath": "$.event_type"}


@query("SELECT event_type AS key, CAST(arg_max(event_id, CAST(event_id AS VARCHAR)) AS BIGINT) AS id, arg_max(user_id, CAST(event_id AS VARCHAR)) AS usr FROM events GROUP BY 1")
def stage_reshape(s, d):
    return staged({"events": events(s, d)}, {**EV, "name": "r", "emit": [{"field": "id", "from": "$.event_id"}, {"field": "usr", "from": "$.user_id"}]}, unique={"events"})


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'view'")
def stage_filter_retract(s, d):
    return staged({"events": events(s, d, "user_id")}, {"name": "f", "from": "events", "keyPath": "$.user_id", "when": [{"path": "$.event_type", "notEquals": "view"}], "emit": [{"field": "kind", "from": "$.event_type"}]})


@query("SELECT kind AS key, count(*) AS n FROM (SELECT arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id) GROUP BY 1")
def stage_rekey(s, d):
    return staged({"events": events(s, d, "user_id")}, {**EV, "name": "k", "reduce": "aggregate", "emit": [{"field": "n", "count": True}]})


@query("SELECT event_type AS key, sum(CAST(value AS DECIMAL(18,6))) AS total FROM events GROUP BY 1")
def stage_agg_sum(s, d):
    return staged({"events": events(s, d)}, {**EV, "name": "a", "reduce": "aggregate", "emit": [{"field": "total", "sum": "$.value"}]}, unique={"events"})


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS n FROM orders GROUP BY 1")
def stage_agg_count(s, d):
    return staged({"orders": orders(s, d)}, {"name": "a", "from": "orders", "keyPath": "$.o_custkey", "reduce": "aggregate", "emit": [{"field": "n", "count": True}]})


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, min(strftime(o_orderdate, '%Y-%m-%d')) AS first, max(CAST(o_totalprice AS DECIMAL(18,6))) AS most FROM orders GROUP BY 1")
def stage_agg_minmax(s, d):
    return staged({"orders": orders(s, d)}, {"name": "a", "from": "orders", "keyPath": "$.o_custkey", "reduce": "aggregate", "emit": [{"field": "first", "min": "$.o_orderdate"}, {"field": "most", "max": "$.o_totalprice"}]})


def joined_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.array_join(F.transform(column, lambda x: x.cast("string")), ","))


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) AS xs FROM orders GROUP BY 1")
def stage_agg_collect(s, d):
    return joined_text(staged({"orders": orders(s, d)}, {"name": "a", "from": "orders", "keyPath": "$.o_custkey", "reduce": "aggregate", "emit": [{"field": "xs", "collect": "$.o_orderstatus"}]}), "xs")


@query("SELECT CAST(user_id AS VARCHAR) AS key, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS xs FROM events GROUP BY 1")
def stage_agg_collect_distinct(s, d):
    return joined_text(staged({"events": events(s, d)}, {"name": "a", "from": "events", "keyPath": "$.user_id", "reduce": "aggregate", "emit": [{"field": "xs", "collect": "$.event_type", "distinct": True}]}, unique={"events"}), "xs")


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) FILTER (WHERE event_type = 'click') AS clicks, sum(CAST(value AS DECIMAL(18,6))) FILTER (WHERE event_type = 'purchase') AS spent FROM events GROUP BY 1")
def stage_agg_filter(s, d):
    return staged({"events": events(s, d)}, {"name": "a", "from": "events", "keyPath": "$.user_id", "reduce": "aggregate", "emit": [{"field": "clicks", "count": True, "where": [{"path": "$.event_type", "equals": "click"}]}, {"field": "spent", "sum": "$.value", "where": [{"path": "$.event_type", "equals": "purchase"}]}]}, unique={"events"})


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS ord, o_orderstatus AS st FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey DESC) = 1")
def stage_latest(s, d):
    return staged({"orders": orders(s, d)}, {"name": "l", "from": "orders", "keyPath": "$.o_custkey", "reduce": "latest", "orderBy": "$.o_orderdate", "orderByType": "text", "tieBy": "$.o_orderkey", "tieByType": "number", "emit": [{"field": "ord", "from": "$.o_orderkey"}, {"field": "st", "from": "$.o_orderstatus"}]})


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, CAST(event_id AS VARCHAR)) AS kind FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'error' AND event_id % 29 = 3) = 0")
def stage_liveset(s, d):
    """A few of the errors end a user's membership for good."""
    topic = events(s, d)
    ends = F.when((F.col("payload.event_type") == "error") & (F.col("payload.event_id") % 29 == 3), "gone").otherwise("on")
    topic = topic.withColumn("payload", F.col("payload").withField("state", ends))
    return staged({"events": topic}, {"name": "v", "from": "events", "keyPath": "$.user_id", "reduce": "liveSet", "deleteWhen": [{"path": "$.state", "equals": "gone"}], "emit": [{"field": "kind", "from": "$.event_type"}]}, unique={"events"})


def baskets(s, d):
    """Orders with their lines as an array, in the order of all columns of a line."""
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
    df = lines(s, d).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("items"))
    return L.envelope(df, F.col("l_orderkey"), F.col("l_orderkey"))


FIRST_LINES = "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_returnflag) = 1"


@query(f"SELECT l_orderkey || '/' || l_linenumber AS key, l_partkey AS part FROM ({FIRST_LINES})")
def stage_foreach(s, d):
    out = staged({"baskets": baskets(s, d)}, {"name": "e", "from": "baskets", "forEach": "$.items[*]", "elementKey": "$.l_linenumber", "keyPath": ["$parent.l_orderkey", "$.l_linenumber"], "emit": [{"field": "part", "from": "$.l_partkey"}]})
    parts = F.from_json("key", "array<string>")
    return out.withColumn("key", F.concat_ws("/", parts))


@query(f"SELECT CAST(l_partkey AS VARCHAR) AS key, sum(CAST(l_quantity AS DECIMAL(18,6))) AS qty, count(*) AS n FROM ({FIRST_LINES}) GROUP BY 1")
def stage_foreach_agg(s, d):
    return staged({"baskets": baskets(s, d)}, {"name": "e", "from": "baskets", "forEach": "$.items[*]", "elementKey": "$.l_linenumber", "keyPath": "$.l_partkey", "reduce": "aggregate", "emit": [{"field": "qty", "sum": "$.l_quantity"}, {"field": "n", "count": True}]})


def customers(s, d, **k):
    return L.envelope(table(s, d, "customer"), F.col("c_custkey"), F.col("c_custkey"), **k)


def both(s, d):
    return {"orders": orders(s, d), "customer": customers(s, d), "nation": snapshot(s, d, "nation", "n_nationkey"), "region": snapshot(s, d, "region", "r_regionkey")}


ORDER_STAGE = {"name": "o", "from": "orders", "keyPath": "$.o_orderkey", "emit": [{"field": "cust", "from": "$.o_custkey"}]}


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_custkey AS cust FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def stage_join_semi(s, d):
    return staged(both(s, d), {**ORDER_STAGE, "join": [{"topic": "customer", "on": "$.o_custkey", "where": [{"path": "$.c_mktsegment", "equals": "BUILDING"}]}]})


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def stage_join_anti(s, d):
    by = {"name": "done", "from": "orders", "keyPath": "$.o_custkey", "when": [{"path": "$.o_orderstatus", "equals": "F"}], "reduce": "aggregate", "emit": [{"field": "n", "count": True}]}
    return staged(both(s, d), by, {"name": "c", "from": "customer", "keyPath": "$.c_custkey", "join": [{"from": "done", "on": "$.c_custkey", "absent": True}], "emit": [{"field": "name", "from": "$.c_name"}]})


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, c_name AS name, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def stage_join_inner(s, d):
    return staged(both(s, d), {"name": "o", "from": "orders", "keyPath": "$.o_orderkey", "join": [{"topic": "customer", "on": "$.o_custkey", "as": "cust"}, {"topic": "nation", "on": "$.cust.c_nationkey", "as": "nat"}], "emit": [{"field": "name", "from": "$.cust.c_name"}, {"field": "nation", "from": "$.nat.n_name"}]})


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, c_name AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def stage_join_left(s, d):
    return staged(both(s, d), {"name": "o", "from": "orders", "keyPath": "$.o_orderkey", "join": [{"topic": "customer", "on": "$.o_custkey", "as": "cust", "optional": True, "where": [{"path": "$.c_acctbal", "greaterThan": 0}]}], "emit": [{"field": "name", "from": "$.cust.c_name"}]})


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def stage_join_stage(s, d):
    return staged(both(s, d), {"name": "per", "from": "orders", "keyPath": "$.o_custkey", "reduce": "aggregate", "emit": [{"field": "n", "count": True}]}, {"name": "c", "from": "customer", "keyPath": "$.c_custkey", "join": [{"from": "per", "on": "$.c_custkey", "as": "per"}], "emit": [{"field": "n", "from": "$.per.n"}]})


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, n FROM orders JOIN (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) g USING (o_custkey, o_orderstatus)")
def stage_join_composite(s, d):
    return staged(both(s, d), {"name": "per", "from": "orders", "keyPath": ["$.o_custkey", "$.o_orderstatus"], "reduce": "aggregate", "emit": [{"field": "n", "count": True}]}, {"name": "o", "from": "orders", "keyPath": "$.o_orderkey", "join": [{"from": "per", "on": ["$.o_custkey", "$.o_orderstatus"], "as": "per"}], "emit": [{"field": "n", "from": "$.per.n"}]})


@query("SELECT lower(c_mktsegment) AS key, count(*) AS n FROM customer GROUP BY 1")
def stage_key_normalize(s, d):
    return staged(both(s, d), {"name": "n", "from": "customer", "keyPath": "$.c_mktsegment", "normalize": "lower", "reduce": "aggregate", "emit": [{"field": "n", "count": True}]})


@query("SELECT CAST(p_size AS VARCHAR) AS key, count(*) AS n FROM part GROUP BY 1")
def stage_key_number(s, d):
    df = table(s, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".000")).alias("size_text"))
    topic = L.envelope(df, F.col("p_partkey"), F.col("p_partkey"))
    return staged({"part": topic}, {"name": "n", "from": "part", "keyPath": "$.size_text", "keyType": "number", "reduce": "aggregate", "emit": [{"field": "n", "count": True}]})


SIDES = ({"name": "bought", "from": "orders", "keyPath": "$.o_custkey", "when": [{"path": "$.o_orderstatus", "equals": "F"}], "reduce": "aggregate", "emit": [{"field": "n", "count": True}]}, {"name": "seen", "from": "events", "keyPath": "$.user_id", "reduce": "aggregate", "emit": [{"field": "n", "count": True}]})
SIDES_SQL = "(SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) {0} JOIN (SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS e FROM events GROUP BY 1) USING (key)"


def merged(s, d, when=None):
    m = {"name": "m", "merge": ["bought", "seen"], "emit": [{"field": "b", "from": "$.bought.n"}, {"field": "e", "from": "$.seen.n"}]}
    return staged({"orders": orders(s, d), "events": events(s, d)}, *SIDES, m | ({"when": when} if when else {}), unique={"events"})


@query(f"SELECT key, b, e FROM {SIDES_SQL.format('FULL')}")
def stage_merge_full(s, d):
    return merged(s, d)


@query(f"SELECT key, b, e FROM {SIDES_SQL.format('INNER')}")
def stage_merge_inner(s, d):
    return merged(s, d, [{"expr": "$.bought.n is not null and $.seen.n is not null"}])


@query(f"SELECT key, b, e FROM {SIDES_SQL.format('LEFT')}")
def stage_merge_left(s, d):
    return merged(s, d, [{"path": "$.bought.n", "notNull": True}])


MARK = 5


def swept_events(s, d):
    """Events stamped with generation event_id % 7; a marker of generation 5 comes last."""
    df = events(s, d, generation=F.col("event_id") % 7)
    last = df.agg(F.max("idx") + 1)
    marker = last.select(F.col(last.columns[0]).alias("idx"), F.lit(0).alias("seq"), F.lit("").alias("key"), F.lit("refresh").alias("variant"), F.lit(MARK).cast("long").alias("generation"), F.lit(None).cast(df.schema["payload"].dataType).alias("payload"))
    return df.unionByName(marker)


@query("SELECT event_type AS key, count(*) AS n FROM events WHERE NOT (event_id % 7 BETWEEN 1 AND 4) GROUP BY 1")
def stage_refresh_sweep(s, d):
    return staged({"events": swept_events(s, d)}, {**EV, "name": "n", "reduce": "aggregate", "emit": [{"field": "n", "count": True}]})


@query("SELECT event_type AS key, count(*) AS n FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE NOT (event_id % 7 BETWEEN 1 AND 4 AND event_id < (SELECT max(event_id) - 200 FROM events)) GROUP BY 1")
def stage_sweep_at_its_place(s, d):
    """The marker comes before the last 200 events, which it can't sweep; a user whose last event is swept is gone."""
    df = events(s, d, "user_id", generation=F.col("event_id") % 7)
    last = df.agg((F.max("idx") - 200).alias("idx"))
    marker = last.select("idx", F.lit(-1).alias("seq"), F.lit("").alias("key"), F.lit("refresh").alias("variant"), F.lit(MARK).cast("long").alias("generation"), F.lit(None).cast(df.schema["payload"].dataType).alias("payload"))
    return staged({"events": df.unionByName(marker)}, {**EV, "name": "n", "reduce": "aggregate", "emit": [{"field": "n", "count": True}]})


# sinks

MAPPED = {"user_id": "$.user_id", "kind": "$.event_type", "value": ("$.value", "DECIMAL(18,2)")}
def deleted():
    """Every tenth event is a tombstone."""
    return F.when(F.col("event_id") % 10 == 7, "delete").otherwise("row")



@query("SELECT user_id, event_type AS kind, CAST(value AS DECIMAL(18,2)) AS value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_id % 10 <> 7")
def mirror_keyed(s, d):
    return sinks.mirror(events(s, d, "user_id", deleted()), MAPPED, ["user_id"])


@query("SELECT event_id AS idx, CAST(0 AS INTEGER) AS seq, user_id, event_type AS kind FROM events WHERE event_id % 10 <> 7")
def history_append(s, d):
    df = events(s, d, variant=deleted())
    return sinks.history(df.unionByName(df.where("idx % 3 = 0")), {"user_id": "$.user_id", "kind": "$.event_type"})  # delivered again in part


@query("SELECT event_id AS idx, CAST(0 AS INTEGER) AS seq, props AS body FROM events")
def history_payload(s, d):
    df = table(s, d, "events").select(F.col("event_id").alias("idx"), F.lit(0).alias("seq"), F.lit("row").alias("variant"), F.col("props").alias("data"), F.struct("event_id").alias("payload"))
    return sinks.history(df, {"body": "$"})


@query("SELECT user_id, event_type AS kind, max(event_id) AS last FROM events GROUP BY 1, 2")
def mirror_composite(s, d):
    return sinks.mirror(events(s, d), {"user_id": "$.user_id", "kind": "$.event_type", "last": "$.event_id"}, ["user_id", "kind"])


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE NOT (event_id % 7 BETWEEN 1 AND 4)")
def mirror_refresh_sweep(s, d):
    return sinks.mirror(swept_events(s, d), {"id": "$.event_id", "kind": "$.event_type"}, ["id"])


def raw_log(s, d):
    df = table(s, d, "events")
    return df.select((F.col("event_id") / 3).cast("long").alias("idx"), (F.col("event_id") % 3).cast("int").alias("seq"), F.lit("events").alias("topic"), F.col("user_id").cast("string").alias("key"), deleted().alias("variant"), F.when(deleted() == "row", F.col("props")).alias("data"), (F.col("event_id") % 7).cast("long").alias("generation"))


@query(
    """SELECT CAST(idx AS VARCHAR) AS idempotency_key, idx, '{"entities":[' || string_agg('{"op":"' || CASE variant WHEN 'row' THEN 'upsert' ELSE variant END || '","key":"' || to_base64(encode(key)) || '"'
    || CASE variant WHEN 'row' THEN ',"data":' || CAST(to_json(props) AS VARCHAR) ELSE '' END || '}', ',' ORDER BY seq) || ']}' AS body FROM (SELECT event_id // 3 AS idx, event_id % 3 AS seq, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_id % 10 = 7 THEN 'delete' ELSE 'row' END AS variant, props FROM events) GROUP BY idx"""
)
def webhook_envelope(s, d):
    return sinks.webhook_envelopes(raw_log(s, d), "events")


# projections

def users(columns: list[str], **source) -> dict:
    return {"primaryKey": "user_id", "table": "users", "db": "x", "columns": ["user_id", *columns], "source": [{"topic": "events", "keyPath": "$.user_id", **source}]}


USER = {"primaryKey": "user_id", "table": "users", "db": "x", "topic": "events", "keyPath": "$.user_id"}
RULES = [
    {"when": [{"path": "$.event_type", "equals": "click"}], "set": [{"column": "last_click", "from": "$.event_id"}]},
    {"when": [{"path": "$.event_type", "notEquals": "view"}], "set": [{"column": "last_kind", "from": "$.event_type"}]},
]


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, max(event_id) FILTER (WHERE event_type = 'click') AS last_click, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS last_kind FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type <> 'view') > 0")
def proj_rules_fold(s, d):
    return project({**USER, "columns": ["user_id", "last_click", "last_kind"], "rules": RULES}, {"events": events(s, d)})


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, max(event_id) AS a, 'seen' AS b, CAST(NULL AS VARCHAR) AS c, CAST(arg_max(round(CAST(value AS DECIMAL(18,6)) * 2, 1), event_id) AS DECIMAL(38,1)) AS e FROM events GROUP BY 1")
def proj_set_arms(s, d):
    sets = [{"column": "a", "from": "$.event_id"}, {"column": "b", "value": "seen"}, {"column": "c", "null": True}, {"column": "e", "expr": "round($.value * 2, 1)"}]
    return project({**USER, "columns": ["user_id", "a", "b", "c", "e"], "rules": [{"set": sets}]}, {"events": events(s, d)})


def lacking(s, d):
    """Events as JSON, three to an actual: of every 50 k one is missing and one is null."""
    df = table(s, d, "events").select("event_id", "user_id", F.from_json("props", "k bigint").getField("k").alias("k"))
    body = F.concat(F.lit('{"user_id":'), "user_id", F.when(F.col("k") % 50 == 7, "").when(F.col("k") % 50 == 8, ',"k":null').otherwise(F.concat(F.lit(',"k":'), "k")), F.lit("}"))
    raw = df.select((F.col("event_id") / 3).cast("long").alias("idx"), (F.col("event_id") % 3).cast("int").alias("seq"), F.lit("events").alias("topic"), F.col("event_id").cast("string").alias("key"), F.lit("row").alias("variant"), F.lit(0).cast("long").alias("generation"), body.alias("data"))
    return L.typed(raw, "events", "user_id bigint, k bigint", raw=True)


ACTUALS = "SELECT *, bool_or(k % 50 = 7) OVER (PARTITION BY idx) AS bad FROM (SELECT *, 'events' AS topic, event_id // 3 AS idx, CAST(event_id AS VARCHAR) AS key, CAST(props->>'k' AS BIGINT) AS k FROM events)"
LACKING = {**USER, "columns": ["user_id", "k"], "rules": [{"set": [{"column": "k", "from": "$.k"}]}]}


@query(f"SELECT CAST(user_id AS VARCHAR) AS user_id, (arg_max({{'k': CASE WHEN k % 50 <> 8 THEN k END}}, event_id)).k AS k FROM ({ACTUALS}) WHERE NOT bad GROUP BY 1")
def proj_dead_letter(s, d):
    """A missing path goes to the dead letters; a null one writes null."""
    return project(LACKING, {"events": lacking(s, d)})


@query(f"SELECT topic AS source, idx, CAST(event_id % 3 AS INTEGER) AS seq, key FROM ({ACTUALS}) WHERE bad")
def proj_dead_actuals(s, d):
    """The whole actual goes where one of its entities lacks the path."""
    return dead(LACKING, {"events": lacking(s, d)})


CUSTOMER = {"primaryKey": "custkey", "table": "c", "db": "x"}


@query("SELECT k AS custkey, name, lo FROM (SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name FROM customer) FULL JOIN (SELECT CAST(user_id AS VARCHAR) AS k, max(event_id) AS lo FROM events GROUP BY 1) USING (k)")
def proj_multi_source(s, d):
    return project({**CUSTOMER, "columns": ["custkey", "name", "lo"], "source": [{"topic": "customer", "keyPath": "$.c_custkey", "rules": [{"set": [{"column": "name", "from": "$.c_name"}]}]}, {"topic": "events", "keyPath": "$.user_id", "rules": [{"set": [{"column": "lo", "from": "$.event_id"}]}]}]}, {"customer": customers(s, d), "events": events(s, d)})


AFTER = "SELECT e.* FROM events e JOIN (SELECT user_id, coalesce(max(event_id) FILTER (WHERE event_id % 10 = 7), -1) AS d FROM events GROUP BY 1) x USING (user_id) WHERE e.event_id > d AND event_id % 10 <> 7"
LAST = [{"set": [{"column": "kind", "from": "$.event_type"}]}, {"when": [{"path": "$.event_type", "equals": "click"}], "set": [{"column": "click", "from": "$.event_id"}]}]


@query(f"SELECT CAST(user_id AS VARCHAR) AS user_id, arg_max(event_type, event_id) AS kind, max(event_id) FILTER (WHERE event_type = 'click') AS click FROM ({AFTER}) GROUP BY 1")
def proj_delete_row(s, d):
    return project(users(["kind", "click"], rules=LAST, onDelete="delete-row"), {"events": events(s, d, "user_id", deleted())})


@query(f"SELECT CAST(u.user_id AS VARCHAR) AS user_id, kind, click FROM (SELECT DISTINCT user_id FROM events WHERE event_id % 10 <> 7) u LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS kind, max(event_id) FILTER (WHERE event_type = 'click') AS click FROM ({AFTER}) GROUP BY 1) USING (user_id)")
def proj_delete_clear(s, d):
    return project(users(["kind", "click"], rules=LAST, onDelete="clear"), {"events": events(s, d, "user_id", deleted())})


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, arg_max(event_type, event_id) AS kind, max(event_id) FILTER (WHERE event_type = 'click') AS click FROM events WHERE event_id % 10 <> 7 GROUP BY 1")
def proj_delete_ignore(s, d):
    return project(users(["kind", "click"], rules=LAST, onDelete="ignore"), {"events": events(s, d, "user_id", deleted())})


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, arg_max(event_type, event_id) AS kind FROM events WHERE value > 50 GROUP BY 1")
def proj_source_when(s, d):
    return project(users(["kind"], rules=[{"set": [{"column": "kind", "from": "$.event_type"}]}], when=[{"path": "$.value", "greaterThan": 50}]), {"events": events(s, d)})


def kids(aggregate: dict, columns: list[str], **source):
    return {**CUSTOMER, "columns": ["custkey", *columns], "source": [{"topic": "orders", "keyPath": "$.o_custkey", "onDelete": "remove-from-aggregate", "aggregate": aggregate} | source]}


ARRAY = {"column": "orders", "elementKey": "$.o_orderkey", "elementKeyType": "number", "element": [{"field": "k", "from": "$.o_orderkey"}, {"field": "s", "from": "$.o_orderstatus"}]}


def listed(df: DataFrame, column: str = "orders", *fields: str) -> DataFrame:
    return df.withColumn(column, F.array_join(F.transform(column, lambda x: F.concat_ws(":", *(F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields or ("k", "s")))), ","))


@query("SELECT CAST(o_custkey AS VARCHAR) AS custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def proj_agg_array(s, d):
    return listed(project(kids(ARRAY, ["orders"]), {"orders": orders(s, d)}))


@query("SELECT CAST(o_custkey AS VARCHAR) AS custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS orders FROM orders GROUP BY 1")
def proj_agg_array_text(s, d):
    return listed(project(kids(ARRAY | {"elementKeyType": "text"}, ["orders"]), {"orders": orders(s, d)}))


def moved(s, d):
    """Orders, and later versions that move every 5th to the next customer."""
    df = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    first = L.envelope(df, F.col("o_orderkey"), F.col("o_orderkey"))
    later = df.where("o_orderkey % 5 = 0").withColumn("o_custkey", F.col("o_custkey") + 1)
    return first.unionByName(L.envelope(later, F.col("o_orderkey") + (1 << 40), F.col("o_orderkey")))


@query("SELECT CAST(c AS VARCHAR) AS custkey, coalesce(orders, '') AS orders FROM (SELECT o_custkey AS c FROM orders UNION SELECT o_custkey + 1 FROM orders WHERE o_orderkey % 5 = 0) LEFT JOIN (SELECT o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS c, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1) USING (c)")
def proj_agg_reparent(s, d):
    return listed(project(kids(ARRAY, ["orders"]), {"orders": moved(s, d)}))


def removed(s, d):
    df = orders(s, d)
    gone = df.where("idx % 4 = 0").withColumns({"idx": F.col("idx") + (1 << 40), "variant": F.lit("delete"), "payload": F.lit(None).cast(df.schema["payload"].dataType)})
    return df.unionByName(gone)


@query("SELECT CAST(c AS VARCHAR) AS custkey, coalesce(orders, '') AS orders FROM (SELECT DISTINCT o_custkey AS c FROM orders) LEFT JOIN (SELECT o_custkey AS c, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS orders FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1) USING (c)")
def proj_agg_remove(s, d):
    return listed(project(kids(ARRAY, ["orders"]), {"orders": removed(s, d)}))


def scalars(s, d, *fields: dict):
    return project(kids({"scalar": list(fields)}, [f["column"] for f in fields]), {"orders": removed(s, d)})


def scalar_sql(*exprs: str) -> str:
    return f"SELECT CAST(c AS VARCHAR) AS custkey, {', '.join(exprs)} FROM (SELECT DISTINCT o_custkey AS c FROM orders) LEFT JOIN (SELECT *, CAST(o_totalprice AS DECIMAL(18,6)) AS p FROM orders WHERE o_orderkey % 4 <> 0) ON o_custkey = c GROUP BY c"


@query(scalar_sql("count(o_orderkey) AS n"))
def proj_scalar_count(s, d):
    return scalars(s, d, {"column": "n", "op": "count"})


@query(scalar_sql("sum(p) AS total"))
def proj_scalar_sum(s, d):
    return scalars(s, d, {"column": "total", "op": "sum", "field": "$.o_totalprice"})


@query(scalar_sql("min(p) AS least", "max(strftime(o_orderdate, '%Y-%m-%d')) AS last"))
def proj_scalar_min_max(s, d):
    return scalars(s, d, {"column": "least", "op": "min", "field": "$.o_totalprice"}, {"column": "last", "op": "max", "field": "$.o_orderdate", "ofType": "text"})


@query(scalar_sql("count(DISTINCT o_orderstatus) AS n"))
def proj_scalar_count_distinct(s, d):
    return scalars(s, d, {"column": "n", "op": "countDistinct", "field": "$.o_orderstatus", "ofType": "text"})


@query(scalar_sql("count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS n", "sum(p) FILTER (WHERE o_orderstatus = 'O') AS total"))
def proj_scalar_filtered(s, d):
    return scalars(s, d, {"column": "n", "op": "count", "where": {"field": "$.o_orderstatus", "equals": "F"}}, {"column": "total", "op": "sum", "field": "$.o_totalprice", "where": {"field": "$.o_orderstatus", "equals": "O"}})


@query("SELECT CAST(n_regionkey AS VARCHAR) AS regionkey, string_agg(n_name || ':' || coalesce(r_name, '-'), ',' ORDER BY n_name) AS nations FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON r_regionkey = n_regionkey GROUP BY 1")
def proj_agg_enriched(s, d):
    element = [{"field": "k", "from": "$.n_name"}, {"field": "s", "lookup": "region", "on": "$.n_regionkey", "select": "$.r_name"}]
    dim = snapshot(s, d, "region", "r_regionkey")
    p = {"db": "x", "table": "r", "primaryKey": "regionkey", "columns": ["regionkey", "nations"], "source": [{"topic": "region", "lookup": {"name": "region"}}, {"topic": "nation", "keyPath": "$.n_regionkey", "aggregate": {"column": "nations", "elementKey": "$.n_name", "element": element}}]}
    return listed(project(p, {"nation": snapshot(s, d, "nation", "n_nationkey"), "region": dim.where("key <> '2'")}), "nations")


def spine(s, d, nation: DataFrame) -> DataFrame:
    p = {**CUSTOMER, "columns": ["custkey", "name", "nation"], "source": [{"topic": "nation", "lookup": {"name": "nation"}}, {"topic": "customer", "keyPath": "$.c_custkey", "rules": [{"set": [{"column": "name", "from": "$.c_name"}, {"column": "nation", "lookup": "nation", "on": "$.c_nationkey", "select": "$.n_name"}]}]}]}
    return project(p, {"customer": customers(s, d), "nation": nation})


@query("SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_name AS name, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def proj_spine_lookup(s, d):
    return spine(s, d, snapshot(s, d, "nation", "n_nationkey"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_name AS name, n_name AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey")
def proj_lookup_delete(s, d):
    df = snapshot(s, d, "nation", "n_nationkey")
    gone = df.where("idx % 3 = 0").withColumns({"idx": F.col("idx") + 1000, "variant": F.lit("delete"), "payload": F.lit(None).cast(df.schema["payload"].dataType)})
    return spine(s, d, df.unionByName(gone))


FAN = {"db": "x", "table": "l", "primaryKey": "line", "columns": ["line", "part", "ord"], "source": [{"topic": "baskets", "forEach": "$.items[*]", "keyPath": "$.id", "onDelete": "delete-rows", "when": [{"path": "$.l_returnflag", "notEquals": "N"}], "rules": [{"set": [{"column": "part", "from": "$.l_partkey"}, {"column": "ord", "from": "$parent.l_orderkey"}]}]}]}


def numbered_baskets(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    df = df.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_returnflag"))).alias("xs"))
    items = F.transform("xs", lambda x, i: F.struct(F.concat_ws("-", F.col("l_orderkey").cast("string"), i.cast("string")).alias("id"), x.l_partkey.alias("l_partkey"), x.l_returnflag.alias("l_returnflag")))
    return L.envelope(df.select("l_orderkey", items.alias("items")), F.col("l_orderkey"), F.col("l_orderkey"))


FAN_SQL = "SELECT l_orderkey || '-' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_returnflag) - 1) AS line, l_partkey AS part, l_orderkey AS ord, l_returnflag AS f FROM lineitem"


@query(f"SELECT line, part, ord FROM ({FAN_SQL}) WHERE f <> 'N'")
def proj_foreach(s, d):
    return project(FAN, {"baskets": numbered_baskets(s, d)})


@query(f"SELECT line, part, ord FROM ({FAN_SQL}) WHERE f <> 'N' AND ord % 6 <> 0")
def proj_foreach_cascade(s, d):
    df = numbered_baskets(s, d)
    gone = df.where("idx % 6 = 0").withColumns({"idx": F.col("idx") + (1 << 40), "variant": F.lit("delete"), "payload": F.lit(None).cast(df.schema["payload"].dataType)})
    return project(FAN, {"baskets": df.unionByName(gone)})


@query("SELECT o_orderkey || '#' || o_orderstatus AS line, o_totalprice AS part, o_custkey AS ord FROM orders")
def proj_foreach_same_key(s, d):
    """Two elements of one key: the last one's write of a column stays, what it doesn't write is the first one's."""
    df = orders(s, d).select("idx", "seq", "key", "variant", "generation", "payload")
    ident = F.concat(F.col("payload.o_orderkey").cast("string"), F.lit("#"), F.col("payload.o_orderstatus"))
    element = lambda n, part: F.struct(ident.alias("id"), F.lit(n).alias("n"), part.alias("part"))
    items = F.array(element(1, F.lit(-1.0)), element(2, F.col("payload.o_totalprice")))
    topic = df.withColumn("payload", F.struct(F.col("payload.o_custkey").alias("cust"), items.alias("items")))
    rules = [{"set": [{"column": "part", "from": "$.part"}]}, {"when": [{"path": "$.n", "equals": 1}], "set": [{"column": "ord", "from": "$parent.cust"}]}]
    return project({"db": "x", "table": "l", "primaryKey": "line", "columns": ["line", "part", "ord"], "source": [{"topic": "orders", "forEach": "$.items[*]", "keyPath": "$.id", "onDelete": "delete-rows", "rules": rules}]}, {"orders": topic})


PER = {"name": "per", "from": "orders", "keyPath": "$.o_custkey", "reduce": "aggregate", "emit": [{"field": "n", "count": True}, {"field": "total", "sum": "$.o_totalprice"}]}


@query("SELECT CAST(o_custkey AS VARCHAR) AS custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,6))) AS total FROM orders GROUP BY 1 HAVING count(*) > 8")
def proj_stage_fed(s, d):
    return project({**CUSTOMER, "columns": ["custkey", "n", "total"], "stage": [PER], "source": [{"from": "per", "when": [{"path": "$.n", "greaterThan": 8}], "rules": [{"set": [{"column": "n", "from": "$.n"}, {"column": "total", "from": "$.total"}]}]}]}, {"orders": orders(s, d)})


@query("SELECT CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS st, CASE WHEN count(*) > 3 THEN count(*) END AS many, CASE WHEN o_orderstatus = 'F' THEN sum(CAST(o_totalprice AS DECIMAL(18,6))) END AS total FROM orders GROUP BY 1, 2 HAVING many IS NOT NULL OR total IS NOT NULL")
def proj_stage_fed_rules(s, d):
    """Each rule writes where it matches; a row needs one that does; the stage's composite key is the row's."""
    per = {"name": "per", "from": "orders", "keyPath": ["$.o_custkey", "$.o_orderstatus"], "reduce": "aggregate", "emit": [{"field": "n", "count": True}, {"field": "total", "sum": "$.o_totalprice"}, {"field": "st", "max": "$.o_orderstatus"}]}
    rules = [{"when": [{"path": "$.n", "greaterThan": 3}], "set": [{"column": "many", "from": "$.n"}]}, {"when": [{"path": "$.st", "equals": "F"}], "set": [{"column": "total", "from": "$.total"}]}]
    return project({"db": "x", "table": "t", "primaryKey": ["cust", "st"], "columns": ["cust", "st", "many", "total"], "stage": [per], "source": [{"from": "per", "rules": rules}]}, {"orders": orders(s, d)})


@query("SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_name AS name, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal > 100")
def proj_row_owner(s, d):
    own = {"name": "own", "from": "customer", "keyPath": "$.c_custkey", "when": [{"path": "$.c_acctbal", "greaterThan": 100}], "emit": [{"field": "name", "from": "$.c_name"}]}
    sources = [{"from": "own", "rowOwner": True, "rules": [{"set": [{"column": "name", "from": "$.name"}]}]}, {"from": "per", "rules": [{"set": [{"column": "n", "from": "$.n"}]}]}]
    return project({**CUSTOMER, "columns": ["custkey", "name", "n"], "stage": [own, PER], "source": sources}, {"orders": orders(s, d), "customer": customers(s, d)})


@query("SELECT CAST(user_id AS VARCHAR) AS usr, event_type AS kind, max(event_id) AS last FROM events GROUP BY 1, 2")
def proj_composite(s, d):
    return project({"db": "x", "table": "t", "primaryKey": ["usr", "kind"], "columns": ["usr", "kind", "last"], "topic": "events", "keyPath": ["$.user_id", "$.event_type"], "rules": [{"set": [{"column": "last", "from": "$.event_id"}]}]}, {"events": events(s, d)})


def differences(s: SparkSession, log: DataFrame, stages: list[dict], topics: dict[str, str], name: str) -> DataFrame:
    """How many rows of a stage differ between the whole log's fold and a view kept by three batches, the later
    entries first, one of them given twice."""
    path = f"{s.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp()}/view-{uuid.uuid4().hex[:12]}"
    view = View(s, path, topics, stages, buckets=8)
    for n in range(3):
        view.apply(log.where(F.pmod(F.xxhash64("idx"), F.lit(3)) == 2 - n).unionByName(log.where("idx % 11 = 0")), n)
    view.apply(log.where("idx % 2 = 0"), 1)
    whole = flat(Graph({t: L.typed(log, t, ddl) for t, ddl in topics.items()}, stages).out[name])
    kept = view.table(name)
    return whole.exceptAll(kept).unionByName(kept.exceptAll(whole)).agg(F.count("*").alias("differences"))


# log maintenance, types, ingest

RAW = "SELECT event_id // 3 AS idx, CAST(event_id % 3 AS INTEGER) AS seq, 'events' AS topic, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_id % 10 = 7 THEN 'delete' ELSE 'row' END AS variant, event_id % 7 AS generation, user_id, event_id, props FROM events"


@query(f"SELECT idx, seq, key, variant FROM ({RAW}) l WHERE variant <> 'row' OR NOT EXISTS (SELECT 1 FROM ({RAW}) x WHERE x.key = l.key AND x.variant = 'delete' AND x.idx > l.idx)")
def log_scrub_rtbf(s, d):
    return L.scrubbed(raw_log(s, d)).select("idx", "seq", "key", "variant")


@query(f"SELECT idx, seq, key, variant FROM ({RAW}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC, seq DESC) = 1")
def log_compact_snapshot(s, d):
    return L.compacted(raw_log(s, d), ["events"]).select("idx", "seq", "key", "variant")


@query(f"SELECT topic, max(generation) AS epoch FROM ({RAW}) GROUP BY 1")
def log_refresh_epoch(s, d):
    return L.refresh_epochs(raw_log(s, d))


@query(f"SELECT idx, seq, key, variant FROM ({RAW}) WHERE idx = 33")
def log_actual_at(s, d):
    return L.actual_at(raw_log(s, d), 33).select("idx", "seq", "key", "variant")


@query("SELECT 'view' || (event_id % 20) AS name, max(event_id) AS idx, arg_max(event_type, event_id) AS text FROM events WHERE event_id <= 500 GROUP BY 1")
def config_as_of(s, d):
    hist = table(s, d, "events").select(F.concat(F.lit("view"), (F.col("event_id") % 20).cast("string")).alias("name"), F.col("event_id").alias("idx"), F.col("event_type").alias("text"))
    return types.config_as_of(hist, 500)


KIND = types.TopicType("events", versions=(types.Version(1), types.Version(2, transform={"k": "k * 10"}), types.Version(3, transform={"k": "k + 1"})))


def versioned(s, d):
    return table(s, d, "events").select("event_id", (F.col("event_id") % 3 + 1).cast("int").alias("type_version"), F.col("props").alias("data"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN k * 10 + 1 WHEN 1 THEN k + 1 ELSE k END AS k FROM (SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events)")
def type_migration_chain(s, d):
    return types.migrated(versioned(s, d), KIND, "k bigint")[0].select("event_id", "payload.k")


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def type_as_stored(s, d):
    return types.as_mode(versioned(s, d), KIND, "k bigint", "as-stored").select("event_id", "payload.k")


@query("SELECT event_id, coalesce(k < 50, false) AS valid FROM (SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events)")
def type_validate(s, d):
    return types.validated(versioned(s, d), "k bigint", ["k"], {"k": lambda c: c < 50}).select("event_id", "valid")


@query("SELECT event_id, k BETWEEN 10 AND 89 AND k % 7 <> 3 AS valid FROM (SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events)")
def type_json_schema(s, d):
    rule = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 10, "exclusiveMaximum": 90, "not": {"enum": [n for n in range(100) if n % 7 == 3]}}}}
    good, bad = schema.proposed(versioned(s, d), rule)
    return good.select("event_id", F.lit(True).alias("valid")).unionByName(bad.select("event_id", F.lit(False).alias("valid")))


@query("SELECT CAST(user_id AS VARCHAR) AS ingest_id, event_id AS source_seq FROM events e WHERE event_id > 200 OR event_id = 0")
def ingest_dedup(s, d):
    df = table(s, d, "events").select(F.col("event_id").alias("idx"), F.lit(0).alias("seq"), F.col("user_id").cast("string").alias("ingest_id"), F.col("event_id").alias("source_seq"))
    seen = df.select("ingest_id").distinct().withColumn("highwater", F.lit(200).cast("long"))
    again = df.where("source_seq % 2 = 0 AND source_seq > 0").withColumn("idx", F.col("idx") + (1 << 40))
    return L.deduplicated(df.unionByName(again), seen).select("ingest_id", "source_seq")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, '{"brand":' || CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE '"' || p_brand || '"' END || ',"id":' || p_partkey || ',"price":' || rtrim(rtrim(CAST(CAST(p_retailprice AS DECIMAL(20,4)) AS VARCHAR), '0'), '.') || ',"size":' || p_size || '}' AS data, CAST(2 AS BIGINT) AS sources FROM part""")
def cdc_same_body(s, d):
    """The snapshot and the change feed give one row the same body, nulls and decimals included."""
    df = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("brand"), F.col("p_retailprice").cast("decimal(20,4)").alias("price"), F.col("p_size").alias("size"))
    feed = df.select(F.col("id").alias("txn"), F.lit(0).alias("pos"), F.lit("part").alias("tbl"), F.lit("insert").alias("op"), F.struct(*df.columns).alias("before"), F.struct(*df.columns).alias("after"))
    stream = cdc.from_changes(feed, [cdc.Route("part", "part", ("id",))])
    return cdc.from_table(df, "part", ["id"], F.col("id")).unionByName(stream).groupBy("key", "data").agg(F.count("*").alias("sources"))


@query("SELECT c_custkey AS idx, c_custkey::VARCHAR AS key, 'row' AS variant FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'x' || c_custkey END, 'row' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_custkey::VARCHAR, 'delete' FROM customer WHERE c_custkey % 3 = 0")
def cdc_key_change(s, d):
    df = table(s, d, "customer").select("c_custkey", "c_name")
    feed = df.select(F.col("c_custkey").alias("txn"), F.lit(0).alias("pos"), F.lit("customer").alias("tbl"), F.when(F.col("c_custkey") % 3 == 0, "update").otherwise("insert").alias("op"), F.struct(F.col("c_custkey").cast("string").alias("id"), "c_name").alias("before"), F.struct(F.concat(F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(""), F.col("c_custkey").cast("string")).alias("id"), "c_name").alias("after"))
    return cdc.from_changes(feed, [cdc.Route("customer", "customer", ("id",))]).select("idx", "key", "variant")


@query("SELECT CAST(0 AS BIGINT) AS differences")
def rebuild_equals_incremental(s, d):
    """A view kept by batches that come out of order and twice, against the fold of the whole log."""
    log = raw_log(s, d).withColumn("data", F.when(F.col("variant") == "row", F.to_json(F.struct("key", F.from_json("data", "k bigint").getField("k").alias("k")))))
    stages = [{"name": "per", "from": "events", "keyPath": "$.key", "reduce": "aggregate", "emit": [{"field": "n", "count": True}, {"field": "k", "sum": "$.k"}]}]
    return differences(s, log, stages, {"events": "key string, k bigint"}, "per")
