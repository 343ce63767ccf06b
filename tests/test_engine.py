"""Stages, projections, sinks, types and streaming on small logs."""

import json

import pytest
from pyspark.sql import functions as F

from tidefold.operators import log as L
from tidefold.operators import sinks, types
from tidefold.operators.projection import ProjectionError, dead, dead_letters, project, validated
from tidefold.operators.stages import Graph, StageError, fingerprint, flat, key_counts, suppressed
from tidefold.operators.stages import validated as stages_validated
from tidefold.plans import config
from tidefold.sources import cdc
from tidefold.streaming.driver import DeadLetters, Parked, View, affected, lag, supervised, visible


def topic(spark, rows, schema):
    """rows: (key, payload dict | None for a delete | int for a refresh of that generation), in log order."""
    out = []
    for i, (key, body) in enumerate(rows):
        kind = "refresh" if isinstance(body, int) else "delete" if body is None else "row"
        gen = body if kind == "refresh" else (body or {}).pop("_gen", 0) if isinstance(body, dict) else 0
        out.append((i, 0, "t", key, kind, gen, json.dumps(body) if kind == "row" else None))
    df = spark.createDataFrame(out, "idx long, seq int, topic string, key string, variant string, generation long, data string")
    return L.typed(df, "t", schema)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_a_changed_input_leaves_its_old_key(spark):
    t = topic(spark, [("1", {"g": "a", "v": 1}), ("2", {"g": "a", "v": 2}), ("1", {"g": "b", "v": 5}), ("2", None)], "g string, v int")
    s = {"name": "s", "from": "t", "keyPath": "$.g", "reduce": "aggregate", "emit": [{"field": "n", "count": True}, {"field": "v", "sum": "$.v"}]}
    assert [(r[0], r[1], int(r[2])) for r in rows(flat(Graph({"t": t}, [s]).out["s"]))] == [("b", 1, 5)]


def test_latest_ties_go_to_the_smallest_input(spark):
    t = topic(spark, [("2", {"g": "a", "o": 1, "v": "two"}), ("10", {"g": "a", "o": 1, "v": "ten"}), ("3", {"g": "a", "o": None, "v": "x"})], "g string, o int, v string")
    s = {"name": "s", "from": "t", "keyPath": "$.g", "reduce": "latest", "orderBy": "$.o", "tieBy": "$.o", "emit": [{"field": "v", "from": "$.v"}]}
    assert rows(flat(Graph({"t": t}, [s]).out["s"])) == [("a", "ten")]


@pytest.mark.parametrize("entries,want", [
    ([("a", {"g": "x", "_gen": 3}), ("", 5), ("a", {"g": "y", "_gen": 3})], [("a", "y")]),  # after the marker
    ([("a", {"g": "x", "_gen": 5}), ("a", {"g": "y", "_gen": 3}), ("", 5)], []),  # the last version counts
    ([("a", {"g": "x", "_gen": 4}), ("", 5), ("b", {"g": "y", "_gen": 1}), ("", 2)], []),
    ([("a", {"g": "x"}), ("", 5)], [("a", "x")]),
])
def test_a_marker_sweeps_what_is_there_when_it_comes(spark, entries, want):
    assert rows(L.latest(topic(spark, entries, "g string")).select("key", "payload.g")) == want


def test_live_set_and_sweep(spark):
    t = topic(spark, [("1", {"k": "a", "op": "new", "_gen": 1}), ("2", {"k": "a", "op": "del", "_gen": 2}), ("3", {"k": "b", "op": "new", "_gen": 2}), ("4", {"k": "c", "op": "new", "_gen": 1}), ("", 2)], "k string, op string")
    s = {"name": "s", "from": "t", "keyPath": "$.k", "reduce": "liveSet", "deleteWhen": [{"path": "$.op", "equals": "del"}], "emit": [{"field": "op", "from": "$.op"}]}
    assert rows(flat(Graph({"t": t}, [s]).out["s"])) == [("b", "new")]


def test_fan_keeps_the_first_of_equal_elements(spark):
    t = topic(spark, [("1", {"id": "p", "xs": [{"e": 1, "v": "a"}, {"e": 1, "v": "b"}, {"e": None, "v": "c"}, {"e": 2, "v": "d"}]}), ("2", {"id": "q", "xs": []})], "id string, xs array<struct<e: int, v: string>>")
    s = {"name": "s", "from": "t", "forEach": "$.xs[*]", "elementKey": "$.e", "keyPath": ["$parent.id", "$.e"], "emit": [{"field": "v", "from": "$.v"}]}
    assert rows(flat(Graph({"t": t}, [s]).out["s"])) == [('["p","1"]', "a"), ('["p","2"]', "d")]


def test_merge_has_absent_sides_as_nulls(spark):
    t = topic(spark, [("1", {"k": "a", "v": 1}), ("2", {"k": "b", "v": 2})], "k string, v int")
    s = [{"name": n, "from": "t", "keyPath": "$.k", "when": [{"path": "$.k", "equals": n}], "emit": [{"field": "v", "from": "$.v"}]} for n in "ab"]
    g = Graph({"t": t}, [*s, {"name": "m", "merge": ["a", "b"], "emit": [{"field": "d", "expr": "coalesce($.a.v, 0) - coalesce($.b.v, 0)"}]}])
    assert [(k, int(v)) for k, v in rows(flat(g.out["m"]))] == [("a", 1), ("b", -2)]
    assert rows(key_counts(g)) == [("a", 1), ("b", 1), ("m", 2)]
    assert suppressed(g.out["m"], g.out["m"]).count() == 0


@pytest.mark.parametrize("bad", [
    {"name": "x", "from": "t", "emit": [{"field": "a", "from": "$.a"}]}, {"name": "x", "from": "t", "keyPath": "$.a", "reduce": "latest", "emit": [{"field": "a", "from": "$.a"}]},
    {"name": "x", "from": "t", "keyPath": "$.a", "emit": [{"field": "a", "sum": "$.a"}]}, {"name": "x", "merge": ["a", "b"], "emit": [{"field": "a", "from": "$.a"}]},
    {"name": "x", "from": "t", "keyPath": "$.a", "colour": 1, "emit": [{"field": "a", "from": "$.a"}]}, {"name": "x", "from": "t", "keyPath": "$.a", "forEach": "$.b[*]", "reduce": "aggregate", "emit": [{"field": "a", "count": True}]},
])
def test_refused_stages(bad):
    with pytest.raises(StageError):
        stages_validated([bad])


def test_fingerprint_follows_the_declaration():
    assert fingerprint([{"a": 1, "b": 2}]) == fingerprint([{"b": 2, "a": 1}]) != fingerprint([{"a": 2}])


SPINE = {"topic": "s", "keyPath": "$.id", "onDelete": "delete-row", "rules": [{"set": [{"column": "name", "from": "$.name"}]}]}
SIDE = {"topic": "r", "keyPath": "$.id", "onDelete": "clear", "rules": [{"set": [{"column": "score", "from": "$.score"}]}]}


def two(spark, entries):
    """entries: (topic, key, payload) in one order."""
    out = [(i, 0, t, k, "delete" if p is None else "row", 0, json.dumps(p) if p else None) for i, (t, k, p) in enumerate(entries)]
    df = spark.createDataFrame(out, "idx long, seq int, topic string, key string, variant string, generation long, data string")
    return {"s": L.typed(df, "s", "id string, name string"), "r": L.typed(df, "r", "id string, score int")}


@pytest.mark.parametrize("entries,want", [
    ([("r", "1", {"id": "1", "score": 5})], [("1", None, 5)]),
    ([("s", "1", {"id": "1", "name": "a"}), ("r", "1", {"id": "1", "score": 5}), ("s", "1", None)], []),
    ([("s", "1", {"id": "1", "name": "a"}), ("s", "1", None), ("r", "1", {"id": "1", "score": 5})], [("1", None, 5)]),
    ([("r", "1", {"id": "1", "score": 5}), ("s", "1", None), ("s", "1", {"id": "1", "name": "b"})], [("1", "b", None)]),
    ([("r", "1", {"id": "1", "score": 5}), ("r", "1", None)], [("1", None, None)]),
    ([("r", "1", None)], []),
    ([("r", "1", {"id": "1", "score": 5}), ("r", "1", None), ("r", "1", {"id": "1", "score": 6})], [("1", None, 6)]),
])
def test_rule_folds_depend_on_history(spark, entries, want):
    p = {"db": "d", "table": "t", "primaryKey": "id", "columns": ["id", "name", "score"], "source": [SPINE, SIDE]}
    assert rows(project(p, two(spark, entries))) == want


def test_movie_card(spark):
    log = [("m", "1", {"movie_id": "1", "title": "T", "year": 1999}), ("c", "c1", {"movie_id": "1", "billing": 2, "person_id": "p2", "role": "actor"}), ("c", "c2", {"movie_id": "1", "billing": 1, "person_id": "p1", "role": "actor"}), ("c", "c3", {"movie_id": "1", "billing": 1, "person_id": "p1", "role": "director"}), ("p", "p1", {"person_id": "p1", "name": "Ann"}), ("c", "c1", None)]
    df = spark.createDataFrame([(i, 0, t, k, "delete" if p is None else "row", 0, json.dumps(p) if p else None) for i, (t, k, p) in enumerate(log)], "idx long, seq int, topic string, key string, variant string, generation long, data string")
    topics = {"m": L.typed(df, "m", "movie_id string, title string, year int"), "c": L.typed(df, "c", "movie_id string, billing int, person_id string, role string"), "p": L.typed(df, "p", "person_id string, name string")}
    cast = lambda column, role: {"topic": "c", "keyPath": "$.movie_id", "when": [{"path": "$.role", "equals": role}], "onDelete": "remove-from-aggregate", "aggregate": {"column": column, "elementKey": "$.billing", "elementKeyType": "number", "element": [{"field": "n", "lookup": "people", "on": "$.person_id", "select": "$.name"}]}}
    p = {"db": "d", "table": "card", "primaryKey": "movie_id", "columns": ["movie_id", "title", "year", "cast", "directors"], "source": [{"topic": "m", "keyPath": "$.movie_id", "onDelete": "delete-row", "rules": [{"set": [{"column": "title", "from": "$.title"}, {"column": "year", "from": "$.year"}]}]}, {"topic": "p", "lookup": {"name": "people"}}, cast("cast", "actor"), cast("directors", "director")]}
    r = project(p, topics).first()
    assert (r.title, [x.n for x in r.cast], [x.n for x in r.directors]) == ("T", ["Ann"], ["Ann"])


def test_refused_projections():
    with pytest.raises(ProjectionError):
        validated({"columns": ["a"], "colour": 1})
    with pytest.raises(ProjectionError):
        validated({"columns": ["name"], "source": [SPINE, SPINE]})


def test_dead_letters_take_the_whole_actual(spark):
    out = [(0, 0, "t", "1", "row", 0, '{"id":"1","name":null}'), (1, 0, "t", "2", "row", 0, '{"id":"2","name":"b"}'), (1, 1, "t", "3", "row", 0, '{"id":"3"}'), (2, 0, "t", "4", "row", 0, '{"id":"4","name":"x","skip":true}')]
    t = L.typed(spark.createDataFrame(out, "idx long, seq int, topic string, key string, variant string, generation long, data string"), "t", "id string, name string, skip boolean", raw=True)
    rules = [{"when": [{"path": "$.id", "notEquals": "4"}], "set": [{"column": "name", "from": "$.name"}]}]
    ok, gone = dead_letters(t, {"keyPath": "$.id", "rules": rules})
    assert (ok.count(), gone.count()) == (2, 2)
    p = {"db": "d", "table": "t", "primaryKey": "id", "columns": ["id", "name"], "topic": "t", "keyPath": "$.id", "rules": rules}
    assert rows(project(p, {"t": t})) == [("1", None)] and rows(dead(p, {"t": t}).select("key")) == [("2",), ("3",)]


def test_refreshes_leave_lookups_and_fans_alone(spark):
    d = topic(spark, [("1", {"name": "one", "_gen": 1}), ("", 2)], "name string")
    t = topic(spark, [("a", {"id": "a", "on": "1"})], "id string, on string")
    p = {"db": "d", "table": "t", "primaryKey": "id", "columns": ["id", "n"], "source": [{"topic": "d", "lookup": {"name": "dim"}}, {"topic": "t", "keyPath": "$.id", "rules": [{"set": [{"column": "n", "lookup": "dim", "on": "$.on", "select": "$.name"}]}]}]}
    assert rows(project(p, {"d": d, "t": t})) == [("a", "one")]


def test_mixed_values_and_expressions_that_begin_with_a_path(spark):
    out = [(i, 0, "t", str(i), "row", 0, json.dumps({"v": v, "a": 5, "b": i})) for i, v in enumerate(["x", 2, True, 10.50, "x", {"o": 1}, None, False])]
    t = L.typed(spark.createDataFrame(out, "idx long, seq int, topic string, key string, variant string, generation long, data string"), "t", "v variant, a int, b int")
    s = {"name": "s", "from": "t", "keyPath": "$.a", "reduce": "aggregate", "emit": [{"field": "all", "collect": "$.v"}, {"field": "each", "collect": "$.v", "distinct": True}, {"field": "d", "sum": "$.a-$.b"}]}
    r = flat(Graph({"t": t}, [s]).out["s"]).select(F.to_json(F.col("all")).alias("all"), F.to_json("each").alias("each"), "d").first()
    assert (r["all"], r.each, int(r.d)) == ('[2,10.5,"x","x",false,true]', '[2,10.5,"x",false,true]', 12)


def test_plain_fans_take_the_key_path_as_identity(spark):
    t = topic(spark, [("1", {"xs": [{"e": 1, "v": "a"}, {"e": 2, "v": "b"}]})], "xs array<struct<e: int, v: string>>")
    s = {"name": "s", "from": "t", "forEach": "$.xs[*]", "keyPath": "$.e", "emit": [{"field": "v", "from": "$.v"}]}
    assert rows(flat(Graph({"t": t}, [s]).out["s"])) == [("1", "a"), ("2", "b")]


def test_mirror_deletes_and_sweeps(spark):
    t = topic(spark, [("1", {"id": "1", "_gen": 1}), ("2", {"id": "2", "_gen": 2}), ("3", {"id": "3", "_gen": 2}), ("3", None), ("", 2)], "id string")
    assert rows(sinks.mirror(t, {"id": "$.id"}, ["id"])) == [("2",)]


def test_coercion(spark):
    c = lambda v, kind: spark.range(1).select(sinks.coerced(F.lit(v), F.lit(v).dataType if hasattr(F.lit(v), "dataType") else None, kind)).first()[0]
    assert c("5", "BIGINT") == 5 and c("x", "INT") is None and c("1.5", "DOUBLE") == 1.5 and c("true", "BOOLEAN") is True and str(c("2.345", "DECIMAL(10,2)")) == "2.35" and c(5, "TEXT") == "5"


def test_types(spark):
    with pytest.raises(types.TypeError_):
        types.admitted(types.TopicType("t", kind="delta"))
    with pytest.raises(types.TypeError_):
        types.admitted(types.TopicType("t", versions=(types.Version(1, transform={"a": "rand()"}),)))
    one = types.TopicType("t", versions=(types.Version(1, "a"),))
    with pytest.raises(types.TypeError_):
        types.revised(one, "b")
    two_ = types.revised(one, "b", {"n": "n * 2"})
    assert two_.current == 2
    df = spark.createDataFrame([(1, '{"n": 4}'), (2, '{"n": 4}'), (1, "no")], "type_version int, data string")
    ok, dead = types.migrated(df, two_, "n int")
    assert sorted(r.payload.n for r in ok.collect()) == [4, 8] and dead.count() == 1
    assert types.preflight(spark, two_, '{"n": 1}', "n int") and not types.preflight(spark, two_, "x", "n int")
    reg = types.Registry()
    assert (reg.put("a", "x"), reg.put("a", "y"), reg.rollback("a", 1), reg.get("a")) == (1, 2, 3, "x")


def test_sources(spark):
    log = cdc.proposal(spark, 7, [{"typeId": "t", "key": "1", "data": "{}"}, {"typeId": "t", "key": "2", "delete": True}])
    assert rows(log.select("idx", "seq", "variant")) == [(7, 0, "row"), (7, 1, "delete")]
    df = spark.sql("SELECT 2 AS b, 'x\"y' AS a, cast(5.0000 AS decimal(20,4)) AS c, '{\"k\":1}' AS j, cast(null AS string) AS n")
    out = cdc.from_table(df, "t", ["b"], F.lit(1), json_columns=["j"]).first()
    assert out.data == '{"a":"x\\"y","b":2,"c":5,"j":{"k":1},"n":null}' and out.key == "2"
    assert cdc.category("postgres", "numeric(10,2)") == "number" and cdc.category("sqlserver", "bit") == "bool" and cdc.category("mysql", "varchar(9)") == "text"
    with pytest.raises(ValueError):
        cdc.category("mysql", "geometry")
    changes = spark.sql("SELECT 1 AS id, 'new' AS a, cast(null AS string) AS big, array('big') AS unchanged")
    assert cdc.refilled(changes, ["big"], spark.sql("SELECT 1 AS id, 'old' AS a, 'B' AS big"), "id").first().big == "B"


def test_scrub_and_dedup(spark):
    log = spark.createDataFrame([(0, 0, "t", "a", "row", "{}"), (1, 0, "t", "a", "delete", None), (2, 0, "t", "a", "row", "{}"), (3, 0, "t", "b", "row", "{}")], "idx long, seq int, topic string, key string, variant string, data string")
    assert [r.idx for r in L.scrubbed(log).orderBy("idx").collect()] == [1, 2, 3]
    assert [r.idx for r in L.compacted(log, ["t"]).orderBy("idx").collect()] == [2, 3]
    assert L.user_entities(log.union(log.limit(1).withColumn("topic", F.lit("__x")))).count() == 4


def test_config():
    text = '[projection]\ndb="${DB:-main}"\ntable="t"\nprimaryKey="id"\ncolumns=["id","n"]\n[[projection.source]]\nfrom="s"\nrules=[{set=[{column="n",from="$.n"}]}]\n[[projection.stage]]\nname="s"\nfrom="t"\nkeyPath="$.k"\nreduce="aggregate"\nemit=[{field="n",count=true}]\n'
    p = config.projection_of(config.parsed(text, env={}))
    assert p["db"] == "main" and p["stage"][0]["name"] == "s"
    with pytest.raises(config.ConfigError):
        config.interpolated("${NOPE}", {})
    assert config.rebuild_needed(p, p | {"columns": ["id"]}) == ["columns"]
    with pytest.raises(config.ConfigError):
        config.rebuild_needed(p, p | {"table": "u"})
    assert config.minimal_schema({"$.a.b": "int", "$.c": "string"}) == "`a` struct<`b`: int>, `c` string"
    s = config.sink_of({"sql": {"topic": "t", "primaryKey": "id", "mappings": [{"column": "id", "jsonPath": "$.id", "type": "BIGINT"}]}})
    assert s["mappings"] == {"id": ("$.id", "BIGINT")} and s["primaryKey"] == ["id"]


SCHEMA = "idx long, seq int, topic string, key string, variant string, generation long, data string"
STAGE = [{"name": "s", "from": "t", "keyPath": "$.g", "reduce": "aggregate", "emit": [{"field": "n", "count": True}, {"field": "v", "sum": "$.v"}]}]


GRAPH = [
    {"name": "s", "from": "t", "keyPath": "$.g", "when": [{"path": "$.v", "lessThan": 8}], "join": [{"topic": "d", "on": "$.g", "as": "dim", "optional": True}], "reduce": "aggregate", "emit": [{"field": "n", "count": True}, {"field": "v", "sum": "$.v"}, {"field": "w", "max": "$.dim.w"}]},
    {"name": "p", "from": "t", "keyPath": "$.g", "forEach": "$.xs[*]", "elementKey": "$.e", "keyPath": "$.e", "reduce": "aggregate", "emit": [{"field": "n", "count": True}]},
    {"name": "only", "from": "t", "keyPath": "$.g", "join": [{"from": "p", "on": "$.v"}, {"topic": "d", "on": "$.g", "absent": True}], "reduce": "aggregate", "emit": [{"field": "n", "count": True}]},
    {"name": "big", "from": "s", "keyPath": "$.n", "reduce": "aggregate", "emit": [{"field": "groups", "count": True}]},
    {"name": "m", "merge": ["s", "only"], "emit": [{"field": "d", "expr": "coalesce($.s.n, 0) * 10 + coalesce($.only.n, 0)"}]},
]
DDL = {"t": "g string, v int, xs array<struct<e: int>>", "d": "w int"}


def random_log(rng, n=60):
    out = []
    for i in range(n):
        r = rng.random()
        if r < 0.05:
            out.append((i, 0, "t", "", "refresh", i // 10, None))
        elif r < 0.25:
            out.append((i, 0, "d", rng.choice("abc"), "delete" if rng.random() < 0.3 else "row", 0, json.dumps({"w": rng.randrange(9)})))
        else:
            body = {"g": rng.choice("abc"), "v": rng.randrange(10), "xs": [{"e": rng.randrange(4)} for _ in range(rng.randrange(3))]}
            out.append((i, 0, "t", str(rng.randrange(8)), "delete" if rng.random() < 0.2 else "row", rng.randrange(i // 10 + 1), json.dumps(body)))
    return out


def test_batches_in_any_order_and_twice_converge(spark, tmp_path):
    import random

    rng = random.Random(2)
    log = random_log(rng)
    whole = spark.createDataFrame(log, SCHEMA)
    graph = Graph({t: L.typed(whole, t, ddl) for t, ddl in DDL.items()}, GRAPH)
    view = View(spark, str(tmp_path / "v"), DDL, GRAPH, buckets=3)
    again = log + rng.sample(log, 15)
    rng.shuffle(again)
    for b in range(3):
        view.apply(spark.createDataFrame(again[b::3], SCHEMA), b)
    view.apply(spark.createDataFrame(again[1::3], SCHEMA), 1)
    for name in graph.out:
        assert rows(view.table(name)) == rows(flat(graph.out[name])), name
    again = View(spark, str(tmp_path / "v"), DDL, GRAPH, buckets=5)  # goes on from what is there
    assert again.store.buckets == 3 and rows(again.table()) == rows(view.table())
    again.rebuild(whole)
    assert rows(again.table()) == rows(flat(graph.out["m"]))


def test_a_batch_reads_and_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    stages = [{"name": "s", "from": "t", "keyPath": "$.g", "reduce": "aggregate", "emit": [{"field": "n", "count": True}]}]
    view = View(spark, str(tmp_path / "v"), {"t": "g string"}, stages, buckets=16)
    log = [(i, 0, "t", str(i), "row", 0, json.dumps({"g": f"g{i % 40}"})) for i in range(80)]
    view.apply(spark.createDataFrame(log, SCHEMA), 0)
    first = {t: dict(p) for t, p in view.store.now["tables"].items()}
    view.apply(spark.createDataFrame([(90, 0, "t", "3", "row", 0, '{"g": "g3"}')], SCHEMA), 1)  # the same again: only its own place moves
    second = view.store.now["tables"]
    moved = lambda a, b, t: sum(a[t].get(k) != b[t].get(k) for k in a[t])
    assert moved(first, second, "t") == 1 and moved(first, second, "s") <= 1
    view.apply(spark.createDataFrame([(91, 0, "t", "3", "row", 0, '{"g": "g4"}')], SCHEMA), 2)
    third = view.store.now["tables"]
    assert moved(second, third, "t") == 1 and 1 <= moved(second, third, "s") <= 2 and moved(second, third, "index-s") <= 2
    assert {r.key: r.n for r in view.table().collect()}["g4"] == 3


def test_stream_and_dead_letters(spark, tmp_path):
    log = [(i, 0, "t", str(i % 3), "row", 0, json.dumps({"g": "a", "v": i}) if i != 4 else "no") for i in range(9)]
    src = str(tmp_path / "in")
    spark.createDataFrame(log, SCHEMA).repartition(3).write.parquet(src)
    view = View(spark, str(tmp_path / "v"), {"t": "g string, v int"}, STAGE, buckets=2)
    supervised(lambda: view.start(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)))
    assert [(r[0], r[1], int(r[2])) for r in rows(view.table())] == [("a", 3, 21)]
    assert lag(spark.createDataFrame([*log, (20, 0, "t", "9", "row", 0, "{}")], SCHEMA), view).first().behind == 1
    assert [(r.idx, r.reason, r.acknowledged) for r in view.dead.list().collect()] == [(4, "no JSON", False)]
    d = DeadLetters(spark, str(tmp_path / "dead"))
    assert d.list().count() == 0
    d.record(spark.createDataFrame(log[:2], SCHEMA), "test")
    d.acknowledge(d.list().where("idx = 0"))
    got = []
    d.replay(lambda df: got.append([r.idx for r in df.collect()]))
    assert got == [[1]] and visible(spark.createDataFrame(log, SCHEMA), 3).count() == 4


def test_supervision_parks_what_does_not_go_on():
    class Fails:
        def __init__(self, at):
            self.lastProgress = {"batchId": at}

        def awaitTermination(self):
            raise RuntimeError("down")

    pauses, at = [], iter([0, 0, 1, 1, 1, 1])
    with pytest.raises(Parked):
        supervised(lambda: Fails(next(at)), most=3, first=1, longest=3, sleep=pauses.append)
    assert pauses == [1, 2, 1, 2, 3]


def test_affected_keys(spark):
    t = topic(spark, [("1", {"g": "a"}), ("2", {"g": "b"}), ("3", {"g": "c"}), ("1", {"g": "b"})], "g string")
    keyed = lambda df: df.withColumn("_key", F.col("payload.g"))
    got = affected(t, t.where("idx = 3"), keyed)
    assert sorted(r["_key"] for r in got.collect()) == ["b", "b"]
