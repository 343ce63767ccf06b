"""Projections: tables with one row by key, folded from rules, children, dimensions, fans and stages.

A column holds the write of greatest (idx, seq, source, rule) after the last row-removing delete of its
key; clearing writes null; the row is there if an upsert came after that delete. All sources of a
table meet in one aggregation: since the greatest write decides, comparing it with the last delete
afterwards is enough, and no ordered window over a key's history is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import parse
from ..functions.keys import decode_composite
from ..functions.scope import Scope, steps
from ..functions.when import checked, matches
from .log import latest, swept
from .stages import Graph, StageError, _value, key_of, out_column

SOURCE = {"topic", "from", "keyPath", "when", "onDelete", "rules", "aggregate", "lookup", "forEach", "normalize", "rowOwner"}


class ProjectionError(ValueError):
    """The projection is refused."""


RULE, SET = {"when", "set"}, {"column", "from", "value", "null", "expr", "lookup", "on", "select"}
AGGREGATE, ELEMENT, SCALAR = {"column", "elementKey", "elementKeyType", "element", "scalar"}, {"field", "from", "lookup", "on", "select"}, {"column", "op", "field", "ofType", "where"}


def _only(where: str, given: dict, known: set[str]) -> None:
    if extra := set(given) - known:
        raise ProjectionError(f"{where}: unknown keys {sorted(extra)}")


def validated(p: dict) -> dict:
    """Admission of a projection; the first fault is named with its place."""
    _only("projection", p, {"db", "table", "primaryKey", "columns", "topic", "keyPath", "rules", "onDelete", "when", "source", "stage"})
    named = [c["name"] if isinstance(c, dict) else c for c in p["columns"]]
    columns, pk = set(named), [p["primaryKey"]] if isinstance(p.get("primaryKey"), str) else list(p.get("primaryKey", []))
    if len(columns) < len(named) or not all(named):
        raise ProjectionError("columns have names, each once")
    if p.get("primaryKey") is not None and (not pk or len(set(pk)) < len(pk) or set(pk) - columns):
        raise ProjectionError("primaryKey names declared columns, each once")
    sources = p.get("source") or [{k: p[k] for k in ("topic", "keyPath", "rules", "onDelete", "when") if k in p}]
    lookups: set[str] = set()
    for n, s in enumerate(sources):
        if "lookup" in s:
            _only(f"source {n} lookup", s["lookup"], {"name"})
            if not s["lookup"].get("name") or s["lookup"]["name"] in lookups:
                raise ProjectionError(f"source {n}: a lookup has a name of its own")
            lookups.add(s["lookup"]["name"])
    stages = {x["name"]: x for x in p.get("stage", []) if "name" in x}
    owners: dict[str, int] = {}
    writers = [s for s in sources if "lookup" not in s and "aggregate" not in s]
    owning = [s for s in writers if s.get("rowOwner")]
    if len(owning) > 1:
        raise ProjectionError("one source owns the rows")
    if len(writers) > 1 and any("from" in s for s in writers) and not owning:
        raise ProjectionError("several sources write the rows and one is fed by a stage: one of them is the rowOwner")
    fans: set[str] = set()
    for n, s in enumerate(sources):
        at = f"source {n}"
        _only(at, s, SOURCE)
        if ("topic" in s) == ("from" in s):
            raise ProjectionError(f"{at}: either topic or from")
        if sum(k in s for k in ("rules", "aggregate", "lookup")) != 1:
            raise ProjectionError(f"{at}: one of rules, aggregate, lookup")
        if s.get("normalize") not in (None, "lower"):
            raise ProjectionError(f"{at}: normalize is lower")
        if isinstance(s.get("when"), list):
            checked(s["when"])
        plain = "rules" in s and not s.get("forEach")
        if s.get("rowOwner") and not plain:
            raise ProjectionError(f"{at}: only a plain source of rules owns rows")
        if owning and plain and not s.get("rowOwner") and "from" not in s:
            raise ProjectionError(f"{at}: beside a row owner other writers are fed by stages")
        if "from" in s:
            if "from" in s and p.get("stage") and s["from"] not in stages:
                raise ProjectionError(f"{at}: no stage {s['from']}")
            if "rules" not in s or s.get("forEach"):
                raise ProjectionError(f"{at}: what a stage feeds has rules")
            keys = stages.get(s["from"], {}).get("keyPath")
            if keys is not None and pk and (1 if isinstance(keys, str) else len(keys)) != len(pk):
                raise ProjectionError(f"{at}: the stage's key and the primary key have as many parts")
        how = s.get("onDelete", "ignore")
        fits = ("remove-from-aggregate", "ignore") if "aggregate" in s else ("delete-rows", "ignore") if s.get("forEach") else ("clear", "ignore") if "from" in s and owning and not s.get("rowOwner") else ("delete-row", "ignore") if "from" in s else ("delete-row", "clear", "ignore")
        if "lookup" not in s and how not in fits:
            raise ProjectionError(f"{at}: onDelete is one of {', '.join(fits)}")
        if s.get("forEach"):
            if not s["forEach"].endswith("[*]") or (len(pk) > 1):
                raise ProjectionError(f"{at}: forEach names an array ([*]) and the key has one column")
            if s["topic"] in fans:
                raise ProjectionError(f"{at}: a topic is fanned once")
            fans.add(s["topic"])
        paths = s.get("keyPath", [])
        if plain and "topic" in s and pk and (1 if isinstance(paths, str) else len(paths)) != len(pk):
            raise ProjectionError(f"{at}: one key path for each key column")
        mine = _rules(at, s.get("rules"), columns, set(pk), lookups, len(pk)) if "rules" in s else _aggregate(at, s["aggregate"], columns, set(pk), lookups) if "aggregate" in s else set()
        if "aggregate" in s and len(pk) > 1:
            raise ProjectionError(f"{at}: an aggregate needs a key of one column")
        if how == "clear" and not mine:
            raise ProjectionError(f"{at}: there is nothing to clear")
        for c in mine:
            if owners.setdefault(c, n) != n:
                raise ProjectionError(f"column {c} has two sources")
    return p


def _rules(at: str, rules: list[dict] | None, columns: set[str], pk: set[str], lookups: set[str], arity: int) -> set[str]:
    """The columns that rules write."""
    if not rules:
        raise ProjectionError(f"{at}: no rules")
    joins: dict[str, tuple] = {}
    out: set[str] = set()
    for n, r in enumerate(rules):
        where = f"{at} rule {n}"
        _only(where, r, RULE)
        if isinstance(r.get("when"), list):
            checked(r["when"])
        if not r.get("set"):
            raise ProjectionError(f"{where}: set is empty")
        seen: set[str] = set()
        for x in r["set"]:
            c = x.get("column")
            _only(f"{where} column {c}", x, SET)
            if c not in columns or c in pk or c in seen:
                raise ProjectionError(f"{where}: column {c} is declared, no key, and set once")
            seen.add(c)
            if sum(k in x for k in ("from", "value", "null", "expr", "lookup")) != 1:
                raise ProjectionError(f"column {c}: exactly one of from, value, null, expr, lookup")
            if "value" in x and not isinstance(x["value"], (str, int, float, bool)):
                raise ProjectionError(f"column {c}: value is a scalar")
            if "expr" in x:
                parse(x["expr"])
            if "lookup" in x:
                if x["lookup"] not in lookups or not x.get("on") or not x.get("select") or arity > 1:
                    raise ProjectionError(f"column {c}: a lookup that is declared, with on and select, and a key of one column")
                if joins.setdefault(c, (x["lookup"], x["on"], x["select"])) != (x["lookup"], x["on"], x["select"]):
                    raise ProjectionError(f"column {c}: one lookup in all rules")
            elif "on" in x or "select" in x:
                raise ProjectionError(f"column {c}: on and select go with lookup")
        out |= seen
    return out


def _aggregate(at: str, a: dict, columns: set[str], pk: set[str], lookups: set[str]) -> set[str]:
    """The columns that an aggregate writes."""
    _only(f"{at} aggregate", a, AGGREGATE)
    if "column" not in a and not a.get("scalar"):
        raise ProjectionError(f"{at}: an aggregate has an array column, scalars, or both")
    if a.get("elementKeyType", "text") not in ("text", "number"):
        raise ProjectionError(f"{at}: elementKeyType is text or number")
    if "column" in a and (not a.get("elementKey") or not a.get("element")):
        raise ProjectionError(f"{at}: an array column takes elementKey and element")
    fields: set[str] = set()
    for e in a.get("element", []):
        _only(f"{at} element {e.get('field')}", e, ELEMENT)
        if not e.get("field") or e["field"] in fields:
            raise ProjectionError(f"{at}: element fields have names, each once")
        fields.add(e["field"])
        if "lookup" in e and (e["lookup"] not in lookups or "from" in e or not e.get("on") or not e.get("select")):
            raise ProjectionError(f"{at} element {e['field']}: a lookup that is declared, with on and select")
        if "lookup" not in e and ("from" not in e or "on" in e or "select" in e):
            raise ProjectionError(f"{at} element {e['field']}: from, or lookup with on and select")
    out = [a["column"]] if "column" in a else []
    for x in a.get("scalar", []):
        _only(f"{at} scalar {x.get('column')}", x, SCALAR)
        if x.get("op") not in ("count", "sum", "min", "max", "countDistinct"):
            raise ProjectionError(f"{at} scalar {x.get('column')}: op is count, sum, min, max or countDistinct")
        if ("field" in x) == (x["op"] == "count") or ("ofType" in x and x["op"] not in ("min", "max", "countDistinct")):
            raise ProjectionError(f"{at} scalar {x['column']}: all but count fold a field; ofType goes with min, max and countDistinct")
        if x.get("ofType", "number") not in ("text", "number"):
            raise ProjectionError(f"{at} scalar {x['column']}: ofType is text or number")
        w = x.get("where")
        if w is not None and (set(w) - {"field", "equals", "null"} or "field" not in w or ("equals" in w) == bool(w.get("null"))):
            raise ProjectionError(f"{at} scalar {x['column']}: where has a field and either equals or null")
        out.append(x["column"])
    for c in out:
        if c not in columns or c in pk or out.count(c) > 1:
            raise ProjectionError(f"{at}: column {c} is declared, no key, and written once")
    return set(out)


def _payload_scope(df: DataFrame) -> Scope:
    return Scope({"": (F.col("payload"), df.schema["payload"].dataType)})


def _set_value(x: dict, scope: Scope) -> Column:
    if "value" in x:
        return F.lit(x["value"])
    if x.get("null"):
        return F.lit(None).cast("string")
    if "lookup" in x:
        return scope.get(x["on"]).col.cast("string")
    return out_column(_value(x.get("from", x.get("expr")), scope))


def rule_writes(topic: DataFrame, s: dict, pk: list[str], source_no: int) -> DataFrame:
    """(pk, ord, up, del, w_<column> struct(ord, value)) of each entity that a rule or a delete makes act."""
    scope = _payload_scope(topic)
    row, deleted = F.col("variant") == "row", F.col("variant") == "delete"
    hit = [row & matches(s.get("when"), scope) & matches(r.get("when"), scope) for r in s["rules"]]
    any_hit = reduce(lambda a, b: a | b, hit)
    order = F.struct("idx", "seq", F.lit(source_no).alias("source"))
    how = s.get("onDelete", "ignore")
    columns: dict[str, list[tuple[Column, Column]]] = {}
    for h, r in zip(hit, s["rules"], strict=True):
        for x in r["set"]:
            columns.setdefault(x["column"], []).append((h, _set_value(x, scope)))
    paths = s.get("keyPath", [])
    parts = [paths] if isinstance(paths, str) else paths
    keys = [F.when(row, scope.get(p).col.cast("string")).otherwise(F.col("key") if len(parts) == 1 else F.from_json("key", "array<string>")[i]).alias(k) for i, (p, k) in enumerate(zip(parts, pk, strict=True))]
    writes = []
    for name, choices in columns.items():
        wrote, value = F.lit(False), F.lit(None)
        for h, v in choices:  # the last rule that matches wins
            value = F.when(h, v).otherwise(value)
            wrote = wrote | h
        if how == "clear":
            wrote = wrote | deleted
        writes.append(F.when(wrote, F.struct(order.alias("ord"), F.when(~deleted, value).alias("v"))).alias(f"w_{name}"))
    acts = any_hit | (deleted & F.lit(how in ("delete-row", "clear")))
    return topic.where(row | deleted).where(acts).select(*keys, order.alias("ord"), any_hit.alias("up"), (deleted & F.lit(how == "delete-row")).alias("del"), *writes)


def folded(writes: list[DataFrame], pk: list[str]) -> DataFrame:
    """(pk, d, up, w_*): the greatest delete, upsert and write by column; one shuffle."""
    names = list(dict.fromkeys(c for w in writes for c in w.columns if c.startswith("w_")))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), writes)
    return both.groupBy(*pk).agg(F.max(F.when(F.col("del"), F.col("ord"))).alias("d"), F.max(F.when(F.col("up"), F.col("ord"))).alias("up"), *(F.max_by(n, F.col(f"{n}.ord")).alias(n) for n in names))


def finished(fold: DataFrame, pk: list[str]) -> DataFrame:
    after = lambda o: o.isNotNull() & (F.col("d").isNull() | (o > F.col("d")))
    names = [c[2:] for c in fold.columns if c.startswith("w_")]
    return fold.where(after(F.col("up"))).select(*pk, "d", *(F.when(after(F.col(f"w_{n}.ord")), F.col(f"w_{n}.v")).alias(n) for n in names))


def missing(path: str, topic: DataFrame, scope: Scope) -> Column:
    """Where a path isn't there. A null is there: with the JSON text (``data``) the two are told apart, without it
    a path is missing where the schema lacks it or a struct on the way to it is null."""
    v = scope.get(path)
    if v.fam == "any":
        return v.col.isNull()
    if "data" in topic.columns:
        tail = "$" + "".join(f"[{x}]" if isinstance(x, int) else f"['{x}']" for x in steps(path))
        return F.try_variant_get(F.expr("try_parse_json(data)"), tail, "variant").isNull()
    if v.present is not None:
        return ~v.present
    way = path.rpartition(".")[0]
    return scope.get(way).col.isNull() if way not in ("", "$") else F.lit(False)


def _bad(topic: DataFrame, s: dict) -> DataFrame | None:
    """idx of the actuals that the rules of a source can't take; None if there can't be any."""
    scope = _payload_scope(topic)
    lacks = []
    paths = [s["keyPath"]] if isinstance(s["keyPath"], str) else s["keyPath"]
    for r in s["rules"]:
        hit = (F.col("variant") == "row") & matches(s.get("when"), scope) & matches(r.get("when"), scope)
        for x in r["set"]:
            if "from" in x:
                lacks.append(hit & missing(x["from"], topic, scope))
            elif "expr" in x and (err := _value(x["expr"], scope).err) is not None:
                lacks.append(hit & F.coalesce(err, F.lit(False)))
        lacks += [hit & (missing(p, topic, scope) | scope.get(p).col.isNull()) for p in paths]
    return topic.where(F.coalesce(reduce(lambda a, b: a | b, lacks), F.lit(False))).select("idx").distinct() if lacks else None


def dead_letters(topic: DataFrame, s: dict) -> tuple[DataFrame, DataFrame]:
    """(applied, dead): an actual of which an entity matches a rule but lacks a path that it reads, has no key or
    fails in an expression goes as a whole."""
    bad = _bad(topic, s)
    return (topic, topic.limit(0)) if bad is None else (topic.join(bad, "idx", "left_anti"), topic.join(bad, "idx", "left_semi"))


def children(topic: DataFrame, s: dict) -> DataFrame:
    """Live children (key, parent, payload): the last matching version of each, unless deleted after it."""
    scope = _payload_scope(topic)
    use = topic.where((F.col("variant") == "delete") | ((F.col("variant") == "row") & matches(s.get("when"), scope)))
    live = latest(use, sweep=False)
    return live.withColumn("parent", key_of(s["keyPath"], _payload_scope(live), None, s.get("normalize"))).where(F.col("parent").isNotNull())


def touched(topic: DataFrame, s: dict) -> DataFrame:
    """(parent, t): the last entity that touched each parent ever materialised. A parent is touched by its
    children's rows and deletes, also by those that move a child to another parent."""
    scope = _payload_scope(topic)
    seen = topic.where((F.col("variant") == "row") & matches(s.get("when"), scope)).withColumn("parent", key_of(s["keyPath"], scope, None, s.get("normalize")))
    ever = seen.where("parent IS NOT NULL").select("key", "parent", F.struct("idx", "seq").alias("t"))
    last = topic.where(F.col("variant").isin("row", "delete")).groupBy("key").agg(F.max(F.struct("idx", "seq")).alias("u"))
    return ever.join(last, "key").groupBy("parent").agg(F.max("u").alias("t"), F.max("t").alias("up"))


def aggregated(kids: DataFrame, a: dict, dims: dict[str, DataFrame]) -> DataFrame:
    """(parent, array column, scalar columns) of live children."""
    aliases, df = [], kids
    kind = kids.schema["payload"].dataType
    wanted = {}
    for e in a.get("element", []):
        if "lookup" in e:
            wanted.setdefault((e["lookup"], e["on"]), f"_l{len(wanted)}")
    for (name, on), alias in wanted.items():  # equal lookups share a join
        dim = dims[name].select(F.col("key").alias("_lk"), F.col("payload").alias(alias))
        df = df.join(dim, key_of(on, Scope({"": (F.col("payload"), kind)}), None, None) == F.col("_lk"), "left").drop("_lk")
        aliases.append(alias)
    rows = {"": (F.col("payload"), kind)} | {x: (F.col(x), df.schema[x].dataType) for x in aliases}
    scope = Scope(rows)
    out = []
    if "column" in a:
        made = [(Scope({"": rows[wanted[e["lookup"], e["on"]]]}).get(e["select"]).col if "lookup" in e else scope.get(e["from"]).col).alias(e["field"]) for e in a["element"]]
        sort = scope.get(a["elementKey"])
        place = sort.number() if a.get("elementKeyType") == "number" and sort.fam == "num" else sort.col.cast("decimal(38,12)") if a.get("elementKeyType") == "number" else sort.col.cast("string")
        # ties of the element key are settled by the child's key
        out.append(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), F.col("key").alias("k"), F.struct(*made).alias("e")))), lambda x: x.e).alias(a["column"]))
    for x in a.get("scalar", []):
        keep = F.lit(True)
        if w := x.get("where"):
            v = scope.get(w["field"])
            keep = v.col.isNull() if w.get("null") else v.col.cast("string") == F.lit(str(w["equals"]).lower() if isinstance(w["equals"], bool) else str(w["equals"]))
        v = scope.get(x["field"]) if "field" in x else None
        col = None if v is None else v.number() if x.get("ofType", "number") == "number" and v.fam == "num" else v.col
        one = F.lit(1) if col is None else col
        fold = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "countDistinct": F.count_distinct}[x["op"]]
        out.append(fold(F.when(keep, one)).alias(x["column"]))
    return df.groupBy("parent").agg(*out)


def fanned(topic: DataFrame, s: dict, pk: str) -> DataFrame:
    """forEach: rows for the elements of live parents, absolutely reconciled; a parent's delete takes its rows.
    Elements of one key write one row: in the order of the log and of the array, the last write of a column stays."""
    live = latest(topic, sweep=False)
    df = live.select("idx", "seq", F.col("payload").alias("_p"))
    path = s["forEach"].removesuffix("[*]")
    v = Scope({"": (F.col("_p"), df.schema["_p"].dataType)}).get(path)
    df = df.select("idx", "seq", F.col("_p").alias("_parent"), F.posexplode(v.col).alias("_at", "_p"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    scope = Scope({"": (F.col("_p"), kinds["_p"]), "$parent": (F.col("_parent"), kinds["_parent"])})
    out = df.where(matches(s.get("when"), scope))
    hit, cols = rule_columns(s["rules"], scope)
    order = F.struct("idx", "seq", "_at")
    made = out.where(hit).select(key_of(s["keyPath"], scope, None, s.get("normalize")).alias(pk), *(F.when(wrote, F.struct(order.alias("ord"), value.alias("v"))).alias(f"w_{n}") for n, (wrote, value) in cols.items()))
    return made.where(F.col(pk).isNotNull()).groupBy(pk).agg(*(F.max_by(f"w_{n}", F.col(f"w_{n}.ord")).getField("v").alias(n) for n in cols))


def rule_columns(rules: list[dict], scope: Scope) -> tuple[Column, dict[str, tuple[Column, Column]]]:
    """(whether any rule matches, column: (whether it is written, value)); of rules that match the last wins."""
    hits, cols = [], {}
    for r in rules:
        hit = matches(r.get("when"), scope)
        hits.append(hit)
        for x in r["set"]:
            wrote, value = cols.get(x["column"], (F.lit(False), F.lit(None)))
            cols[x["column"]] = wrote | hit, F.when(hit, _set_value(x, scope)).otherwise(value)
    return reduce(lambda a, b: a | b, hits), cols


def stage_fed(stage: DataFrame, s: dict, pk: list[str]) -> DataFrame:
    """Row key = stage key, its parts if there are several; what no when or no rule matches isn't there."""
    scope = Scope({"": (F.col("out"), stage.schema["out"].dataType)})
    hit, cols = rule_columns(s["rules"], scope)
    parts = [F.col("key")] if len(pk) == 1 else [F.get(decode_composite(F.col("key"), len(pk)), i) for i in range(len(pk))]
    return stage.where(matches(s.get("when"), scope) & hit).select(*(c.alias(k) for c, k in zip(parts, pk, strict=True)), *(F.when(wrote, value).alias(n) for n, (wrote, value) in cols.items()))


def _topic_rules(p: dict) -> list[dict]:
    """The sources whose rules read a topic's rows."""
    sources = p.get("source") or [{k: p[k] for k in ("topic", "keyPath", "rules", "onDelete", "when") if k in p}]
    return [s for s in sources if "topic" in s and "rules" in s and not s.get("forEach")]


def dead(p: dict, topics: dict[str, DataFrame]) -> DataFrame:
    """(source, idx, seq, key) of the entities that ``project`` leaves out, each of whose actuals a source can't take."""
    out = [dead_letters(topics[s["topic"]], s)[1].select(F.lit(s["topic"]).alias("source"), "idx", "seq", "key") for s in _topic_rules(p)]
    return reduce(DataFrame.unionByName, out)


def project(p: dict, topics: dict[str, DataFrame], discriminators: dict[str, str] | None = None) -> DataFrame:
    """The table of a projection: primary key as text, then its columns. Actuals that its rules can't take
    aren't applied; ``dead`` has them."""
    validated(p)
    graph = Graph(topics, p.get("stage", []), discriminators)
    pk = [p["primaryKey"]] if isinstance(p["primaryKey"], str) else p["primaryKey"]
    sources = p.get("source") or [{k: p[k] for k in ("topic", "keyPath", "rules", "onDelete", "when") if k in p}]
    names = [c["name"] if isinstance(c, dict) else c for c in p["columns"] if (c["name"] if isinstance(c, dict) else c) not in pk]
    dims = {s["lookup"]["name"]: latest(topics[s["topic"]], sweep=False) for s in sources if "lookup" in s}
    writes, extra, fed, fans, owner = [], [], [], [], None
    for n, s in enumerate(sources):
        if "lookup" in s:
            continue
        if "aggregate" in s:
            kids = children(topics[s["topic"]], s)
            got = touched(topics[s["topic"]], s).join(aggregated(kids, s["aggregate"], dims), "parent", "left").withColumnRenamed("parent", pk[0])
            if "column" in s["aggregate"]:
                c = s["aggregate"]["column"]
                got = got.withColumn(c, F.coalesce(c, F.expr(f"filter({c}, x -> false)"), F.from_json(F.lit("[]"), got.schema[c].dataType)))
            for x in s["aggregate"].get("scalar", []):
                if x["op"].startswith("count"):
                    got = got.withColumn(x["column"], F.coalesce(x["column"], F.lit(0)))
            if not any(o.get("rowOwner") for o in sources):
                writes.append(got.select(pk[0], F.struct(F.col("up.idx").alias("idx"), F.col("up.seq").alias("seq"), F.lit(n).alias("source")).alias("ord"), F.lit(True).alias("up"), F.lit(False).alias("del")))
            extra.append(got.drop("up"))
        elif "from" in s:
            df = stage_fed(graph.out[s["from"]], s, pk)
            owner = df if s.get("rowOwner") else owner
            fed += [] if s.get("rowOwner") else [df]
        elif s.get("forEach"):
            fans.append(fanned(topics[s["topic"]], s, pk[0]))
        else:
            w = rule_writes(dead_letters(topics[s["topic"]], s)[0], s, pk, n)
            if any(o.get("rowOwner") for o in sources) and not s.get("rowOwner"):
                w = w.withColumn("up", F.lit(False))
            writes.append(w)
    out = finished(folded(writes, pk), pk) if writes else None
    for df in extra:
        cols = [c for c in df.columns if c not in (*pk, "t")]
        out = out.join(df, pk[0], "left")
        live = F.col("t").isNotNull() & (F.col("d").isNull() | (F.col("t") > F.struct(F.col("d.idx").alias("idx"), F.col("d.seq").alias("seq"))))
        out = out.withColumns({c: F.when(live, F.col(c)) for c in cols}).drop("t")
    out = out.drop("d") if out is not None else None
    for df in fans:
        out = df if out is None else out.join(df, pk[0], "full_outer")
    if owner is not None:
        out = owner if out is None else owner.join(out, pk, "left")
    for df in fed:
        out = df if out is None else out.join(df, pk, "left" if owner is not None else "full_outer")
    for s in sources:
        for r in s.get("rules", []):
            for x in r["set"]:
                if "lookup" in x:
                    dim = dims[x["lookup"]].select(F.col("key").alias("_lk"), Scope({"": (F.col("payload"), dims[x["lookup"]].schema["payload"].dataType)}).get(x["select"]).col.alias("_lv"))
                    out = out.join(dim, F.col(x["column"]) == F.col("_lk"), "left").drop(x["column"], "_lk").withColumnRenamed("_lv", x["column"])
    return out.select(*pk, *(n for n in names if n in out.columns))


__all__ = ["ProjectionError", "StageError", "dead", "project", "swept", "validated"]
