"""What is refused when definitions come in, JSON Schema, and change feeds end to end."""

import json

import pytest
from pyspark.sql import functions as F

from tidefold.operators import schema, types
from tidefold.operators.projection import ProjectionError, validated
from tidefold.sources import cdc

RULES = [{"set": [{"column": "a", "from": "$.a"}]}]
GOOD = {"db": "d", "table": "t", "primaryKey": "id", "columns": ["id", "a", "b"], "source": [{"topic": "s", "keyPath": "$.id", "rules": RULES}]}


def changed(**source):
    return GOOD | {"source": [GOOD["source"][0] | source]}


AGG = {"column": "a", "elementKey": "$.k", "element": [{"field": "x", "from": "$.x"}]}


@pytest.mark.parametrize("bad", [
    GOOD | {"primaryKey": "nope"}, GOOD | {"primaryKey": ["id", "id"]}, GOOD | {"columns": ["id", "a", "a"]}, changed(colour=1), changed(normalize="upper"), changed(onDelete="delete-rows"),
    changed(rules=[]), changed(rules=[{"set": []}]), changed(rules=[{"set": [{"column": "a", "from": "$.a", "value": 1}]}]), changed(rules=[{"sets": RULES[0]["set"], "set": RULES[0]["set"]}]),
    changed(rules=[{"set": [{"column": "id", "from": "$.a"}]}]), changed(rules=[{"set": RULES[0]["set"] * 2}]), changed(rules=[{"set": [{"column": "a", "value": [1]}]}]),
    changed(rules=[{"set": [{"column": "a", "lookup": "none", "on": "$.x", "select": "$.y"}]}]), changed(rules=[{"set": [{"column": "a", "from": "$.a", "on": "$.x"}]}]), changed(keyPath=["$.id", "$.x"]),
    changed(forEach="$.xs"), changed(aggregate=AGG), GOOD | {"source": [{"topic": "s", "keyPath": "$.id", "aggregate": AGG | {"elementKeyType": "date"}}]},
    GOOD | {"source": [{"topic": "s", "keyPath": "$.id", "aggregate": {"scalar": [{"column": "a", "op": "sum"}]}}]}, GOOD | {"source": [{"topic": "s", "keyPath": "$.id", "aggregate": {"scalar": [{"column": "a", "op": "count", "field": "$.x"}]}}]},
    GOOD | {"source": [{"topic": "s", "keyPath": "$.id", "aggregate": {"scalar": [{"column": "a", "op": "count", "where": {"field": "$.x"}}]}}]}, GOOD | {"source": [GOOD["source"][0], {"topic": "d", "lookup": {"name": "x"}}, {"topic": "e", "lookup": {"name": "x"}}]},
    GOOD | {"source": [GOOD["source"][0], {"from": "st", "rules": [{"set": [{"column": "b", "from": "$.b"}]}]}]}, GOOD | {"stage": [{"name": "st", "keyPath": ["$.a", "$.b"]}], "source": [{"from": "st", "rules": RULES}]},
])
def test_refused_projections(bad):
    assert validated(GOOD) is GOOD
    with pytest.raises(ProjectionError):
        validated(bad)


@pytest.mark.parametrize("text,name", [("brand || 'rand()'", None), ("upper(operand)", None), ("`now`", None), ("t.current_date", None), ("case when n > 1 then cast(n as decimal(9,2)) else round(n) end", None), ("rand()", "rand"), ("spark_partition_id() + 1", "spark_partition_id"), ("curdate()", "curdate"), ("current_date", "current_date"), ("concat(a, uuid ())", "uuid"), ("NOW()", "now")])
def test_migrations_give_the_same_each_time(text, name):
    assert types.unstable(text) == name


DOCS = ['{"a":1}', '{"a":1.0,"b":"xy"}', '{"a":"1"}', '{"a":2,"b":"xyz"}', '{"a":3,"c":[1,2]}', '{"a":3,"c":[1,"x"]}', "[1]", "null", "nope", '{"a":1.5}', '{"a":7,"d":{"e":null}}', '{"a":7,"d":{"e":1,"f":2}}', "{}"]


@pytest.mark.parametrize("rule,want", [
    ({"type": "object", "required": ["a"]}, [0, 1, 2, 3, 4, 5, 9, 10, 11]),
    ({"properties": {"a": {"type": "integer"}}, "required": ["a"], "type": "object"}, [0, 1, 3, 4, 5, 10, 11]),
    ({"type": "object", "properties": {"b": {"type": "string", "minLength": 3}}, "required": ["b"]}, [3]),
    ({"type": "object", "properties": {"c": {"type": "array", "items": {"type": "number"}, "minItems": 2}}, "required": ["c"]}, [4]),
    ({"type": ["array", "null"]}, [6, 7]),
    ({"type": "object", "properties": {"d": {"type": "object", "additionalProperties": False, "properties": {"e": {"type": "null"}}}}, "required": ["d"]}, [10]),
    ({"type": "object", "properties": {"a": {"enum": [1, "1"]}}, "required": ["a"]}, [0, 1, 2]),
    ({"oneOf": [{"required": ["b"], "type": "object"}, {"type": "object", "properties": {"a": {"const": 2}}, "required": ["a"]}]}, [1]),
    ({"type": "object", "required": ["a"], "not": {"properties": {"a": {"type": "number", "exclusiveMinimum": 1, "maximum": 3}}}}, [0, 1, 2, 10, 11]),
])
def test_json_schema(spark, rule, want):
    rows = spark.createDataFrame(list(enumerate(DOCS)), "idx long, data string")
    good, bad = schema.proposed(rows, json.dumps(rule))
    assert sorted(r.idx for r in good.collect()) == want and bad.count() == len(DOCS) - len(want)


def test_refused_schemas():
    for bad in ({"type": "thing"}, {"properties": {"a": {"format": "date"}}}, {"pattern": "("}, {"items": 5}):
        with pytest.raises(schema.SchemaError):
            schema.checked(bad)
    with pytest.raises(schema.SchemaError):
        types.admitted(types.TopicType("t", schema_type="JSONSchema", versions=(types.Version(1, '{"type": "thing"}'),)))


def test_routes_and_files_of_changes(spark, tmp_path):
    with pytest.raises(ValueError):
        cdc.routed([cdc.Route("a", "t", ("id",)), cdc.Route("A", "u", ("id",))])
    with pytest.raises(ValueError):
        cdc.routed([cdc.Route("a", "t", ("id",)), cdc.Route("b", "t", ("id",))])
    with pytest.raises(ValueError):
        cdc.routed([cdc.Route("a", "t", ())])
    row = lambda **v: {"id": 1, "sub": None, "name": None} | v
    feed = [
        {"op": "insert", "txn": 1, "pos": 0, "tbl": "people", "after": row(name="x")}, {"op": "insert", "txn": 1, "pos": 1, "tbl": "items", "after": row(sub=2)},
        {"op": "update", "txn": 2, "pos": 0, "tbl": "items", "before": row(sub=2), "after": row(sub=3)}, {"op": "truncate", "txn": 3, "pos": 0, "tbl": "people"}, {"op": "delete", "txn": 4, "pos": 0, "tbl": "people", "before": row()}, {"op": "insert", "txn": 5, "pos": 0, "tbl": "other", "after": row()},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(r) for r in feed))
    routes = [cdc.Route("people", "p", ("id",), ("id", "name")), cdc.Route("items", "i", ("id", "sub"), ("id", "sub"))]
    changes = cdc.change_files(spark, str(tmp_path / "in"), "id long, sub long, name string")
    q = cdc.from_changes(changes, routes, generation=3).writeStream.format("memory").queryName("routed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = [(r.idx, r.seq, r.topic, r.key, r.variant, r.data, r.generation) for r in spark.table("routed").orderBy("idx", "seq").collect()]
    assert got == [
        (1, 0, "p", "1", "row", '{"id":1,"name":"x"}', 3), (1, 2, "i", '["1","2"]', "row", '{"id":1,"sub":2}', 3), (2, 0, "i", '["1","3"]', "row", '{"id":1,"sub":3}', 3),
        (2, 1, "i", '["1","2"]', "delete", None, 3), (4, 0, "p", "1", "delete", None, 3),
    ]
    static = spark.read.schema(changes.schema).json(str(tmp_path / "in"))
    assert [tuple(r) for r in cdc.truncations(static).collect()] == [(3, "people")]
    log = spark.createDataFrame([(1, "p", 0), (9, "p", 2)], "idx long, topic string, generation long")
    assert cdc.status(log, head=12).first().asDict() == {"topic": "p", "entities": 2, "last_idx": 9, "epoch": 2, "phase": "streaming", "lag": 3, "caught_up": False}


def test_numbers_inside_documents(spark):
    df = spark.createDataFrame([("1.0",), ("1e2",), ("-0.0",), ("2.50",), ("x",)], "t string")
    assert [r[0] for r in df.select(cdc.mysql_json_number(F.col("t"))).collect()] == ["1", "100", "0", "2.5", None]
