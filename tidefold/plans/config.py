"""View definitions as TOML or JSON: parsed, filled in from the environment, validated."""

from __future__ import annotations

import json
import os
import re
import tomllib

from ..operators import projection, stages

PLAIN = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


class ConfigError(ValueError):
    """The definition is refused."""


def interpolated(text: str, env: dict[str, str] | None = None) -> str:
    """``${NAME}`` and ``${NAME:-default}``; an unset name without a default is refused."""
    env = os.environ if env is None else env

    def fill(m: re.Match) -> str:
        value = env.get(m[1], m[2])
        if value is None:
            raise ConfigError(f"{m[1]} isn't set")
        return value

    return PLAIN.sub(fill, text)


def parsed(text: str, kind: str = "toml", env: dict[str, str] | None = None) -> dict:
    text = interpolated(text, env)
    return tomllib.loads(text) if kind == "toml" else json.loads(text)


def projection_of(config: dict) -> dict:
    """The validated projection of a definition; ``when`` given as a text is a discriminator's value."""
    if "projection" not in config:
        raise ConfigError("no [projection]")
    p = dict(config["projection"])
    projection.validated(p)
    stages.validated(p.get("stage", []))
    return p


def sink_of(config: dict) -> dict:
    """A validated [sql] mirror or history, or [http] sink."""
    if "sql" in config:
        s = config["sql"]
        extra = set(s) - {"db", "topic", "table", "primaryKey", "keyColumn", "mappings", "indexes"}
        if extra or not s.get("mappings") or not s.get("topic"):
            raise ConfigError(f"[sql] takes topic and mappings; unknown: {sorted(extra)}")
        names = [m["column"] for m in s["mappings"]]
        pk = [s["primaryKey"]] if isinstance(s.get("primaryKey"), str) else s.get("primaryKey", [])
        if set(pk) - set(names):
            raise ConfigError("the primary key is mapped")
        return s | {"primaryKey": pk, "mappings": {m["column"]: (m["jsonPath"], m["type"]) if m.get("type") else m["jsonPath"] for m in s["mappings"]}}
    if "http" in config:
        h = config["http"]
        if h.get("method", "POST") not in ("POST", "PUT") or not h.get("url"):
            raise ConfigError("[http] takes a url and POST or PUT")
        return {"method": "POST", "timeoutMs": 5000, "headers": []} | h
    raise ConfigError("no sink")


def rebuild_needed(old: dict, new: dict) -> list[str]:
    """Parts of a projection that only a rebuild can change; a change of identity is refused."""
    for part in ("db", "table", "primaryKey"):
        if old.get(part) != new.get(part):
            raise ConfigError(f"{part} can't change")
    return [part for part in ("columns", "stage") if old.get(part) != new.get(part)] + [part for part in ("aggregate", "lookup", "rowOwner") if [s.get(part) for s in old.get("source", [])] != [s.get(part) for s in new.get("source", [])]]


def minimal_schema(paths: dict[str, str]) -> str:
    """A DDL schema of just the paths ({'$.a.b': 'type'}) that a view reads."""
    tree: dict = {}
    for path, kind in paths.items():
        way = path.removeprefix("$.").split(".")
        node = tree
        for step in way[:-1]:
            node = node.setdefault(step, {})
        node[way[-1]] = kind
    ddl = lambda n: ", ".join(f"`{k}` struct<{nested(v)}>" if isinstance(v, dict) else f"`{k}` {v}" for k, v in n.items())
    nested = lambda n: ", ".join(f"`{k}`: struct<{nested(v)}>" if isinstance(v, dict) else f"`{k}`: {v}" for k, v in n.items())
    return ddl(tree)
