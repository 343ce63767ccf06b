"""Stages: private keyed folds of a topic, of earlier stages, or of several of them merged.

A stage is a dict (see FIELDS). ``compile_stages`` turns a list of them into DataFrames (key, out);
each is a pure function of the log, so a changed or vanished input needs no delta arithmetic.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import evaluate, parse
from ..functions.keys import composite_key, key_part, minimal_decimal
from ..functions.scope import PathError, Scope, Value, narrowed, steps
from ..functions.when import checked, matches
from .log import latest, swept

FIELDS = {"name", "from", "merge", "keyPath", "keyType", "normalize", "when", "deleteWhen", "reduce", "orderBy", "orderByType", "tieBy", "tieByType", "forEach", "elementKey", "join", "emit"}
JOIN = {"topic", "from", "on", "where", "absent", "as", "optional", "normalize", "onType"}
EMIT = {"field", "from", "expr", "sum", "min", "max", "count", "collect", "distinct", "where"}
FOLDS = ("sum", "min", "max", "count", "collect")


class StageError(ValueError):
    """The stage is refused."""


def validated(stages: list[dict]) -> list[dict]:
    """Admission of a list of stages, in order; names only look back."""
    seen: set[str] = set()
    for s in stages:
        name = s.get("name")
        bad = lambda text: StageError(f"stage {name}: {text}")  # noqa: E731, B023
        if not name or name in seen:
            raise bad("a stage has a name of its own")
        if extra := set(s) - FIELDS:
            raise bad(f"unknown fields {sorted(extra)}")
        if ("from" in s) == ("merge" in s):
            raise bad("either from or merge")
        if "merge" in s:
            names = [m if isinstance(m, str) else m["stage"] for m in s["merge"]]
            if len(names) < 2 or len(set(names)) < len(names) or set(names) - seen:
                raise bad("merge names two or more earlier stages")
            if s.get("reduce") or s.get("forEach") or s.get("keyPath") or s.get("join"):
                raise bad("merge takes when and emit only")
        elif not s.get("keyPath"):
            raise bad("keyPath is missing")
        if s.get("reduce", "") not in ("", "aggregate", "latest", "liveSet"):
            raise bad("reduce is aggregate, latest or liveSet")
        if s.get("reduce") == "latest" and not (s.get("orderBy") and s.get("tieBy")):
            raise bad("latest takes orderBy and tieBy")
        if s.get("reduce") == "liveSet" and not s.get("deleteWhen"):
            raise bad("liveSet takes deleteWhen")
        if s.get("deleteWhen") and s.get("reduce") != "liveSet":
            raise bad("deleteWhen goes with liveSet")
        if s.get("elementKey") and not s.get("forEach"):
            raise bad("elementKey goes with forEach")
        if s.get("forEach") and not s.get("elementKey") and (s.get("reduce") or not isinstance(s["keyPath"], str)):
            raise bad("elements have the key path as their identity only in a plain stage with one key path")
        if not s.get("emit"):
            raise bad("emit is missing")
        for w in ("when", "deleteWhen"):
            if isinstance(s.get(w), list):
                checked(s[w])
        fields = set()
        for e in s["emit"]:
            if set(e) - EMIT or "field" not in e or e["field"] in fields:
                raise bad(f"emit {e}")
            fields.add(e["field"])
            arms = [k for k in ("from", "expr", *FOLDS) if k in e]
            if len(arms) != 1 or (arms[0] in FOLDS) != (s.get("reduce") == "aggregate"):
                raise bad(f"emit {e['field']}: one arm, a fold exactly under aggregate")
            if e.get("distinct") and "collect" not in e or e.get("where") and arms[0] not in FOLDS:
                raise bad(f"emit {e['field']}: distinct goes with collect, where with a fold")
            if "where" in e:
                checked(e["where"])
            if arms[0] == "expr" or arms[0] in FOLDS[:3] or arms[0] == "collect":
                is_path(str(e[arms[0]])) or parse(e[arms[0]])
        for j in s.get("join", []):
            if set(j) - JOIN or ("topic" in j) == ("from" in j) or not j.get("on"):
                raise bad("a join has on and either topic or from")
            if "from" in j and j["from"] not in seen:
                raise bad("a join looks back")
            if j.get("absent") and j.get("as") or j.get("optional") and not j.get("as"):
                raise bad("absent has no alias; optional needs one")
            if "where" in j:
                checked(j["where"])
        seen.add(name)
    return stages


def fingerprint(stages: list[dict]) -> str:
    """Of the declared content only; stored beside a checkpoint."""
    return hashlib.sha256(json.dumps(stages, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def is_path(text: str) -> bool:
    try:
        steps(text)
    except PathError:
        return False
    return True


def _value(text: str, scope: Scope) -> Value:
    return scope.get(text) if is_path(text) else evaluate(text, scope)


def out_column(v: Value) -> Column:
    return v.number() if v.fam == "num" and isinstance(v.kind, T.DecimalType) else v.col


def key_of(paths: str | list[str], scope: Scope, key_type: str | None, normalize: str | None) -> Column:
    vs = [scope.get(p) for p in ([paths] if isinstance(paths, str) else paths)]
    return composite_key([key_part(v.col, v.kind.simpleString(), key_type, normalize) for v in vs])


def _ordering(v: Value, mode: str | None) -> Column:
    if mode == "number":
        return v.number() if v.fam == "num" else v.col.cast("string").try_cast("decimal(38,12)")
    if mode == "text":
        return v.col.cast("string")
    return v.number() if v.fam == "num" else v.col


def descending(text: Column) -> Column:
    """A text that sorts the other way round."""
    return F.concat(F.translate(F.lower(F.hex(text)), "0123456789abcdef", "fedcba9876543210"), F.lit("g"))


FIRST = re.compile(r"\$(parent)?(?:\.([A-Za-z_]\w*)|\['((?:[^']|'')*)'\])?")


def used_fields(stages: list[dict], discriminators: dict[str, str]) -> dict[str, set[str] | None]:
    """By topic the payload fields that stages read, as far as first steps of paths tell; None stands for all."""
    out: dict[str, set[str] | None] = {}

    def add(topic: str, texts: list[str], alias: str | None = None) -> None:
        found = out.setdefault(topic, set())
        for text in texts:
            hits = re.findall(rf"\$\.{alias}(?:\.([A-Za-z_]\w*))?", text) if alias else [m[2] or m[3] for m in FIRST.finditer(text)]
            if any(not h for h in hits):
                out[topic] = None
                return
            if found is not None:
                found |= {h.replace("''", "'") for h in hits}

    def texts(x: object) -> list[str]:
        return [x] if isinstance(x, str) else [t for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()) for t in texts(v)]

    for s in stages:
        if "from" in s:
            own = {k: v for k, v in s.items() if k != "join"}
            add(s["from"], [*texts(own), *(t for j in s.get("join", []) for t in texts(j.get("on", []))), discriminators.get(s["from"], "")])
        for j in s.get("join", []):
            if "topic" in j:
                add(j["topic"], texts(j.get("where", [])))
                if j.get("as") and out[j["topic"]] is not None:
                    add(j["topic"], texts(s), j["as"])
    return out


def pruned(topic: DataFrame, fields: set[str] | None) -> DataFrame:
    """``topic`` with no more of its payload than ``fields``, so that scans and aggregations carry only these."""
    kind = topic.schema["payload"].dataType
    if fields is None or not isinstance(kind, T.StructType) or not set(kind.names) - fields:
        return topic
    kept = [F.col("payload").getField(n).alias(n) for n in kind.names if n in fields] or [F.lit(None).cast("int").alias("none")]
    return topic.withColumn("payload", F.when(F.col("payload").isNotNull(), F.struct(*kept)))


class Graph:
    """Compiles stages over topics (name -> DataFrame as in ``operators.log``).

    unique: topics whose keys never come twice (events); their rows are the last versions as they
    are, so no aggregation and no shuffle is needed to find them."""

    def __init__(self, topics: dict[str, DataFrame], stages: list[dict], discriminators: dict[str, str] | None = None, unique: set[str] = frozenset()):
        self.topics, self.discriminators, self.unique = topics, discriminators or {}, unique
        self.out: dict[str, DataFrame] = {}
        self.key_rules: dict[str, tuple[str | None, str | None]] = {}
        self.last: dict[str, DataFrame] = {}
        self.used = used_fields(stages, self.discriminators)
        for s in validated(stages):
            self.out[s["name"]] = self.merge(s) if "merge" in s else self.stage(s)
            self.told(s)

    def told(self, s: dict) -> None:
        """How keys of the stage are made, for those that look them up."""
        own = s.get("merge", [None])[0]
        self.key_rules[s["name"]] = (s.get("keyType"), s.get("normalize")) if "merge" not in s else self.key_rules[own if isinstance(own, str) else own["stage"]]

    def current(self, topic: str) -> DataFrame:
        if topic not in self.last:
            rows = pruned(self.topics[topic], self.used.get(topic))
            self.last[topic] = swept(rows).where(F.col("variant") == "row") if topic in self.unique else latest(rows)
        return self.last[topic]

    def inputs(self, s: dict) -> DataFrame:
        """(_in, _p): one row for each live input."""
        if s["from"] in self.out:
            return self.out[s["from"]].select(F.col("key").alias("_in"), F.col("out").alias("_p"))
        return self.current(s["from"]).select(F.col("key").alias("_in"), F.col("payload").alias("_p"))

    def scope(self, df: DataFrame, aliases: list[str] = ()) -> Scope:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        rows = {"": (F.col("_p"), kinds["_p"])}
        if "_parent" in kinds:
            rows["$parent"] = (F.col("_parent"), kinds["_parent"])
        return Scope(rows | {a: (F.col(f"_a_{a}"), kinds[f"_a_{a}"]) for a in aliases})

    def stage(self, s: dict) -> DataFrame:
        return self.folded(self.members(self.inputs(s), s), s)

    def members(self, df: DataFrame, s: dict) -> DataFrame:
        """The inputs (_in, _p), or their elements, that the stage takes, with their keys and sources (_key, _src, _dead)."""
        df = df.withColumn("_src", F.col("_in"))
        if s.get("forEach"):
            df = self.fan(df, s)
        scope = self.scope(df)
        alive = matches(s.get("when"), scope, self.discriminators.get(s["from"]))
        dead = matches(s["deleteWhen"], scope) if s.get("reduce") == "liveSet" else F.lit(False)
        return df.where(alive | dead).withColumn("_dead", dead).withColumn("_key", key_of(s["keyPath"], scope, s.get("keyType"), s.get("normalize"))).where(F.col("_key").isNotNull())

    def folded(self, df: DataFrame, s: dict) -> DataFrame:
        """(key, out) of members."""
        aliases: list[str] = []
        for j in s.get("join", []):
            df = self.join(df, j, aliases)
        return self.reduce(df, s, self.scope(df, aliases))

    def looked_up(self, df: DataFrame, s: dict) -> DataFrame:
        """(key, src, on0, on1, ...): which key of each join's other side members look at, found there or not."""
        aliases: list[str] = []
        for n, j in enumerate(s.get("join", [])):
            dim, on = self.other(df, j, aliases)
            df = df.withColumn(f"on{n}", on)
            if j.get("as"):
                name = f"_a_{j['as']}"
                aliases.append(j["as"])
                df = df.join(dim.select("_dk", F.col("_d").alias(name)), F.col(f"on{n}") == F.col("_dk"), "left").drop("_dk")
        return df.select(F.col("_key").alias("key"), F.col("_src").alias("src"), *(f"on{n}" for n in range(len(s.get("join", []))))).distinct()

    def fan(self, df: DataFrame, s: dict) -> DataFrame:
        """One row for each identified element; of equal identities in a parent the first stays."""
        path = s["forEach"].removesuffix("[*]")
        v = self.scope(df).get(path)
        if not isinstance(v.kind, T.ArrayType):
            raise StageError(f"stage {s['name']}: forEach names an array")
        df = df.select("_in", F.col("_p").alias("_parent"), F.posexplode(v.col).alias("_at", "_p"))  # _in is the source's key here
        ident = self.scope(df).get(s.get("elementKey") or s["keyPath"])
        df = df.withColumn("_id", ident.col.cast("string")).where(F.col("_id").isNotNull())
        first = df.groupBy("_in", "_id").agg(F.min_by(F.struct("_parent", "_p"), "_at").alias("_v"))
        return first.select(composite_key([F.col("_in"), F.col("_id")]).alias("_in"), F.col("_in").alias("_src"), "_v._parent", "_v._p")

    def other(self, df: DataFrame, j: dict, aliases: list[str]) -> tuple[DataFrame, Column]:
        """((_dk, _d) of a join's other side, the key that rows of ``df`` look up there)."""
        scope = self.scope(df, aliases)
        if "from" in j:
            dim = self.out[j["from"]].select(F.col("key").alias("_dk"), F.col("out").alias("_d"))
            key_type, normalize = self.key_rules[j["from"]]
        else:
            dim = self.current(j["topic"]).select(F.col("key").alias("_dk"), F.col("payload").alias("_d"))
            key_type, normalize = j.get("onType"), j.get("normalize")
            if normalize == "lower":
                dim = dim.withColumn("_dk", F.lower("_dk"))
        if j.get("where"):
            kind = {f.name: f.dataType for f in dim.schema.fields}["_d"]
            dim = dim.where(matches(j["where"], Scope({"": (F.col("_d"), kind)})))
        return dim, key_of(j["on"], scope, j.get("onType", key_type), j.get("normalize", normalize))

    def join(self, df: DataFrame, j: dict, aliases: list[str]) -> DataFrame:
        dim, looked = self.other(df, j, aliases)
        df = df.withColumn("_on", looked)
        on = F.col("_on") == F.col("_dk")
        if not j.get("as"):
            return df.join(dim.select("_dk"), on, "left_anti" if j.get("absent") else "left_semi").drop("_on")
        name = f"_a_{j['as']}"
        aliases.append(j["as"])
        return df.join(dim.select("_dk", F.col("_d").alias(name)), on, "left" if j.get("optional") else "inner").drop("_on", "_dk")

    def merge(self, s: dict) -> DataFrame:
        """Full outer by key: a union with one column for each side, then one aggregation; absent sides are null."""
        sides = [(m, m) if isinstance(m, str) else (m["stage"], m.get("as", m["stage"])) for m in s["merge"]]
        kinds = {a: self.out[n].schema["out"].dataType for n, a in sides}
        parts = [self.out[n].select("key", *((F.col("out") if b == a else F.lit(None).cast(kinds[b])).alias(f"_a_{b}") for _, b in sides)) for n, a in sides]
        both = reduce(DataFrame.unionByName, parts).groupBy("key").agg(*(F.max_by(f"_a_{a}", F.when(F.col(f"_a_{a}").isNotNull(), 1)).alias(f"_a_{a}") for _, a in sides))
        rows = {a: (F.col(f"_a_{a}"), kinds[a]) for _, a in sides}
        scope = Scope(rows | {"": (F.struct(*(F.col(f"_a_{a}").alias(a) for _, a in sides)), T.StructType([T.StructField(a, kinds[a]) for _, a in sides]))})
        return both.where(matches(s.get("when"), scope)).select("key", self.emitted(s, scope))

    def emitted(self, s: dict, scope: Scope) -> Column:
        return F.struct(*(out_column(_value(e.get("from", e.get("expr")), scope)).alias(e["field"]) for e in s["emit"])).alias("out")

    def reduce(self, df: DataFrame, s: dict, scope: Scope) -> DataFrame:
        kind = s.get("reduce", "")
        by = df.withColumnRenamed("_key", "key")
        if kind == "aggregate":
            got = by.groupBy("key").agg(*(self.fold(e, scope).alias(e["field"]) for e in s["emit"]))
            return got.select("key", F.struct(*(F.col(f"`{e['field']}`") for e in s["emit"])).alias("out"))
        by = by.select("key", "_in", "_dead", self.emitted(s, scope), *([_ordering(scope.get(s["orderBy"]), s.get("orderByType")).alias("_o"), _ordering(scope.get(s["tieBy"]), s.get("tieByType")).alias("_t")] if kind == "latest" else []))
        if kind == "latest":
            return by.groupBy("key").agg(F.max_by("out", F.struct("_o", "_t", descending(F.col("_in")))).alias("out"))
        if kind == "liveSet":
            live = by.groupBy("key").agg(F.max("_dead").alias("_dead"), F.max_by("out", F.when(~F.col("_dead"), F.col("_in"))).alias("out"), F.count(F.when(~F.col("_dead"), 1)).alias("_n"))
            return live.where((F.col("_n") > 0) & ~F.col("_dead")).select("key", "out")
        return by.groupBy("key").agg(F.max_by("out", "_in").alias("out"))

    def fold(self, e: dict, scope: Scope) -> Column:
        keep = matches(e["where"], scope) if e.get("where") else None
        only = lambda c: c if keep is None else F.when(keep, c)
        if "count" in e:
            return F.count(only(F.lit(1)))
        arm = next(a for a in FOLDS if a in e)
        v = _value(e[arm], scope)
        if arm == "sum":
            x, ok = narrowed(v, "num")
            return F.sum(only(x if v.fam == "num" else F.when(ok, x)))
        if v.fam == "any":
            # numbers before texts before booleans; other values aren't taken
            n, t, b = (narrowed(v, f) for f in ("num", "str", "bool"))
            rank = F.struct(F.when(n[1], 1).when(t[1], 2).when(b[1], 3).alias("of"), F.when(n[1], n[0]).alias("n"), F.when(t[1], t[0]).alias("t"), F.when(b[1], b[0]).alias("b"))
            if arm == "collect":
                taken = only(F.when(n[1] | t[1] | b[1], rank))
                text = lambda x: F.when(x.of == 1, minimal_decimal(x.n.cast("string"))).when(x.of == 2, F.regexp_extract(F.to_json(F.struct(x.t.alias("v"))), r"^\{\"v\":(?s)(.*)\}$", 1)).otherwise(x.b.cast("string"))
                return F.transform(F.sort_array(F.collect_set(taken) if e.get("distinct") else F.collect_list(taken)), lambda x: F.parse_json(text(x)))
            pick = F.max_by if arm == "max" else F.min_by
            return pick(only(F.to_json(v.col)), only(F.when(n[1] | t[1] | b[1], rank)))
        x = v.number() if v.fam == "num" else v.col
        if arm == "collect":
            return F.sort_array(F.collect_set(only(x)) if e.get("distinct") else F.collect_list(only(x)))
        return (F.min if arm == "min" else F.max)(only(x))


def flat(stage: DataFrame, key: str = "key") -> DataFrame:
    """(key, out) with out's fields as columns."""
    return stage.select(F.col("key").alias(key), "out.*")


def suppressed(new: DataFrame, old: DataFrame) -> DataFrame:
    """Changed rows only: (key, out), out null where a key is gone."""
    both = new.select("key", F.col("out").alias("_n")).join(old.select("key", F.col("out").alias("_o")), "key", "full_outer")
    return both.where(~F.col("_n").eqNullSafe(F.col("_o"))).select("key", F.col("_n").alias("out"))


def probe(graph: Graph, stage: str, key: str) -> DataFrame:
    return graph.out[stage].where(F.col("key") == key)


def key_counts(graph: Graph) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("keys")).select(F.lit(n).alias("stage"), "keys") for n, df in graph.out.items()])
