"""Routes as configuration: dataclasses, YAML or JSON text, environment overrides, validation and registries."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from routeflow.operators.routing import CORE, DEPTH, check_policy
from routeflow.plans.handlers import TypeHandlers

#: Endpoint types and middleware that need no registration, and other spellings.
ENDPOINTS = {*CORE, "kafka", "nats", "amqp", "mqtt", "mongodb", "aws", "http", "ibmmq", "zeromq", "parquet"}
MIDDLEWARE = {"deduplication", "weak_join", "retry", "dlq", "metrics", "delay", "random_panic"}
SPELLINGS = {"ibm_mq": "ibmmq"}
SOURCE_ONLY, SINK_ONLY = {"deduplication", "weak_join"}, {"retry", "dlq"}

SOURCES: dict[str, Callable] = {}
SINKS: dict[str, Callable] = {}
CUSTOM_MIDDLEWARE: dict[str, Callable] = {}


@dataclass(frozen=True)
class Endpoint:
    kind: str = "null"
    options: Mapping[str, Any] = field(default_factory=dict)
    middlewares: tuple[tuple[str, Mapping[str, Any]], ...] = ()
    handler: Callable | None = None
    sink: str = ""  # its name in a route, where it is a sink of one

    def with_handler(self, handler: Callable) -> Endpoint:
        return replace(self, handler=handler)

    def add_middleware(self, name: str, **options: Any) -> Endpoint:
        return replace(self, middlewares=(*self.middlewares, (name, options)))


@dataclass(frozen=True)
class Route:
    input: Endpoint
    output: Endpoint = Endpoint()
    concurrency: int = 1
    batch_size: int = 1
    commit_concurrency_limit: int = 4096

    def with_options(self, **options: int) -> Route:
        return replace(self, **options)

    def with_handler(self, handler: Callable) -> Route:
        return replace(self, output=self.output.with_handler(handler))

    def add_handler(self, kind: str, schema: str, handler: Callable) -> Route:
        """A handler of one kind of message more; a raw handler that is there gets what no kind matches."""
        known = self.output.handler
        typed = known if isinstance(known, TypeHandlers) else TypeHandlers(fallback=known)
        return self.with_handler(typed.add(kind, schema, handler))

    def add_handlers(self, handlers: Mapping[str, tuple[str, Callable]]) -> Route:
        out = self
        for kind, (schema, handler) in handlers.items():
            out = out.add_handler(kind, schema, handler)
        return out


def endpoint(raw: Any, depth: int = 0) -> Endpoint:
    """``null`` and ``{}`` drop everything; one key names the type; an unknown single key is a custom type; several are an error."""
    if depth > DEPTH:
        raise ValueError(f"endpoints nest deeper than {DEPTH}")
    if raw is None or raw == {}:
        return Endpoint()
    raw = dict(raw)
    middlewares = _middlewares(raw.pop("middlewares", ()))
    if len(raw) != 1:
        raise ValueError(f"an endpoint has one type, not {sorted(raw)}")
    (kind, options), = raw.items()
    kind = SPELLINGS.get(kind, kind)
    if kind == "file" and isinstance(options, str):
        options = {"path": options}
    if kind == "file" and options.get("consume") is False:
        options = {k: v for k, v in options.items() if k != "consume"} | {"subscribe_mode": True}
    if kind == "switch":
        cases = {str(k): endpoint(v, depth + 1) for k, v in options["cases"].items()}
        options = {"metadata_key": options["metadata_key"], "cases": cases, "default": endpoint(options["default"], depth + 1) if options.get("default") is not None else None}
    elif kind == "fanout":
        options = {"targets": [endpoint(x, depth + 1) for x in options]}
    elif kind not in ENDPOINTS:
        kind, options = "custom", {"name": kind, "config": options}
    if kind == "kafka" and not isinstance(options, Mapping):
        raise ValueError("kafka needs a mapping of options")
    return Endpoint(kind, options if isinstance(options, Mapping) else {"value": options}, middlewares)


def _middlewares(raw: Any) -> tuple[tuple[str, Mapping[str, Any]], ...]:
    """A list, or a map with numbers as keys (what environment variables make), in numeric order."""
    if isinstance(raw, Mapping):
        raw = [v for _, v in sorted(raw.items(), key=lambda kv: int(kv[0]))]
    out = []
    for item in raw:
        (name, options), = ({item: {}} if isinstance(item, str) else item).items()
        options = options or {}
        if name == "dlq":
            options = {"endpoint": endpoint(options["endpoint"])}
        if name == "random_panic" and not 0 <= float(options.get("probability", 0)) <= 1:
            raise ValueError("probability must be from 0 to 1")
        if name not in MIDDLEWARE and name not in CUSTOM_MIDDLEWARE:
            name, options = "custom", {"name": name, "config": options}
        out.append((name, options))
    return tuple(out)


def route(raw: Mapping[str, Any]) -> Route:
    extra = {k: int(raw[k]) for k in ("concurrency", "batch_size", "commit_concurrency_limit") if k in raw}
    if unknown := set(raw) - {"input", "output", *extra}:
        raise ValueError(f"unknown fields of a route: {sorted(unknown)}")
    return Route(endpoint(raw["input"]), endpoint(raw.get("output")), **extra)


def load(text: str, environ: Mapping[str, str] | None = None, prefix: str = "MQB") -> dict[str, Route]:
    """Routes by name from YAML or JSON; ``PREFIX__ROUTE__INPUT__KAFKA__TOPIC=x`` overrides a value."""
    try:
        import yaml

        raw = yaml.safe_load(text) or {}
    except ModuleNotFoundError:
        raw = json.loads(text)
    for name, value in (os.environ if environ is None else environ).items():
        path = name.split("__")
        if path[0] != prefix or len(path) < 2:
            continue
        at = raw
        for part in path[1:-1]:
            known = next((k for k in at if str(k).lower() == part.lower()), part.lower())
            at = at.setdefault(known, {})
        at[path[-1].lower()] = value
    return {name: route(r) for name, r in raw.items()}


def children(e: Endpoint) -> list[Endpoint]:
    found = [*e.options.get("cases", {}).values(), e.options.get("default"), *e.options.get("targets", [])] if e.kind in ("switch", "fanout") else []
    return [c for c in found if isinstance(c, Endpoint)]


def tree(e: Endpoint) -> list[Endpoint]:
    return [e, *(x for c in children(e) for x in tree(c))]


def title(e: Endpoint) -> str:
    """What an endpoint is called: its type and what it is addressed by."""
    o = e.options
    return ":".join(str(x) for x in (e.kind, o.get("url"), o.get("topic") or o.get("queue") or o.get("path") or o.get("collection") or o.get("subject") or o.get("name") or o.get("value")) if x)


def named(e: Endpoint, known: dict[str, int] | None = None) -> Endpoint:
    """The same tree with a name for every sink, those of dead letters too: its title, and a number where others have the same.
    So each place in the tree is a sink of its own."""
    known = {} if known is None else known
    options = dict(e.options)
    if e.kind == "switch":
        options["cases"] = {k: named(c, known) for k, c in options["cases"].items()}
        options["default"] = named(options["default"], known) if options["default"] else None
    elif e.kind == "fanout":
        options["targets"] = [named(c, known) for c in options["targets"]]
    middlewares = tuple((n, {**o, "endpoint": named(o["endpoint"], known)} if n == "dlq" else o) for n, o in e.middlewares)
    name = ""
    if not children(e) and e.kind != "null":
        name = title(e)
        known[name] = known.get(name, 0) + 1
        name += f"#{known[name]}" if known[name] > 1 else ""
    return replace(e, options=options, middlewares=middlewares, sink=name)


def kinds(e: Endpoint) -> set[str]:
    return {x.kind for x in tree(e)}


def schema() -> dict[str, Any]:
    """The configuration's JSON schema, for editors and checks."""
    one = lambda *names: {"type": "object", "properties": {n: {} for n in names}}
    whole = lambda least: {"type": "integer", "minimum": least}
    options = {
        "deduplication": {"required": ["ttl_seconds"], "properties": {"ttl_seconds": whole(0)}},
        "weak_join": {"required": ["group_by", "expected_count", "timeout_ms"], "properties": {"group_by": {"type": "string"}, "expected_count": whole(1), "timeout_ms": whole(0)}},
        "retry": {"properties": {"max_attempts": whole(1), "initial_interval_ms": whole(0), "max_interval_ms": whole(0), "multiplier": {"type": "number"}}},
        "dlq": {"required": ["endpoint"], "properties": {"endpoint": {"$ref": "#/$defs/endpoint"}}},
        "metrics": {}, "delay": {"required": ["delay_ms"], "properties": {"delay_ms": whole(0)}},
        "random_panic": {"required": ["probability"], "properties": {"probability": {"type": "number", "minimum": 0, "maximum": 1}}},
    }
    middleware = {"anyOf": [{"type": "string"}, {"type": "object", "minProperties": 1, "maxProperties": 1, "properties": {k: {"type": ["object", "null"], **v} for k, v in options.items()}}]}
    middlewares = {"anyOf": [{"type": "array", "items": middleware}, {"type": "object", "patternProperties": {"^[0-9]+$": middleware}, "additionalProperties": False}]}
    nested = {"$ref": "#/$defs/endpoint"}
    switch = {"type": "object", "required": ["metadata_key", "cases"], "properties": {"metadata_key": {"type": "string"}, "cases": {"type": "object", "additionalProperties": nested}, "default": nested}, "additionalProperties": False}
    known = one(*sorted(ENDPOINTS))["properties"] | {"switch": switch, "fanout": {"type": "array", "items": nested}, "middlewares": middlewares}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "additionalProperties": {"$ref": "#/$defs/route"},
        "$defs": {
            "endpoint": {"type": ["object", "null"], "maxProperties": 2, "properties": known},
            "route": {"type": "object", "required": ["input"], "additionalProperties": False, "properties": {"input": nested, "output": nested} | {f.name: whole(1) for f in fields(Route) if f.type == "int"}},
        },
    }


def validate(r: Route, allowed: set[str] | None = None) -> list[str]:
    """Warnings; raises what can't run. Retry and dead letters do nothing on an input, nor deduplication on an output; a weak join there is an error."""
    if allowed is not None:
        check_policy(kinds(r.input) | kinds(r.output), allowed)
    if r.input.kind in ("switch", "fanout", "response"):
        raise ValueError(f"{r.input.kind} can't be an input")
    outer = [n for e in tree(r.output) for n, _ in e.middlewares]
    if "weak_join" in outer:
        raise ValueError("weak_join can't stand on an output")
    return [f"{n} on an input is ignored" for n, _ in r.input.middlewares if n in SINK_ONLY] + [f"{n} on an output is ignored" for n in outer if n == "deduplication"]
