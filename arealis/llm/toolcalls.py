"""Tool calls of conversations: linked with their results, ordered, validated and written as canonical JSON.

Calls and results are hash-joined by identifier.  A call comes after the calls
it depends on: chains of single dependencies are followed by doubling pointers,
and in rounds the calls with several get a level once all of these have one.
Arguments are checked against the JSON schema of the tool.  One canonical JSON text per call has sorted keys,
no spaces and no escapes but those JSON requires.

No step gathers a conversation: one that holds most of the rows is spread like
any others, and the order is given by ``level`` and ``position``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.spread import drop, keep

_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "null": lambda v: v is None,
}


def violations(value: Any, schema: Mapping[str, Any], at: str = "$") -> list[str]:
    """Where ``value`` breaks ``schema`` (type, enum, bounds, lengths, items, properties, required, additionalProperties)."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not one of the allowed values")
    if _TYPES["number"](value):
        if value < schema.get("minimum", value):
            found.append(f"{at}: below {schema['minimum']}")
        if value > schema.get("maximum", value):
            found.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            found.append(f"{at}: too long")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            found += violations(item, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}: {name} is missing" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in known:
                found += violations(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}: {name} is not allowed")
    return found


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _finish(schemas: dict[str, dict]):
    """Status, first violation and JSON of each linked call."""

    def one(call_id, tool, arguments, has_result, result):
        body = {"call_id": call_id, "name": tool, "result": result}
        try:
            value = json.loads(arguments if arguments is not None else "null", parse_constant=_constant)
        except (ValueError, RecursionError):
            return "malformed", "$: not JSON", canonical(body | {"arguments": arguments})
        text = canonical(body | {"arguments": value})
        if tool not in schemas:
            return "unknown_tool", None, text
        wrong = violations(value, schemas[tool])
        if wrong:
            return "invalid", wrong[0], text
        return ("valid" if has_result else "no_result"), None, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("call_id", "tool", "arguments", "has_result", "result")))
            out = [one(*row) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *[pa.array([x[i] for x in out], pa.string()) for i in range(3)]],
                names=["row", "status", "violation", "json"],
            )

    return run


def _paths(singles: DataFrame, scope: list[str], own: str) -> DataFrame:
    """For each call with one dependency: the first call behind it without one or with several (``end``), and the steps there.

    Pointers double in each round, so a chain of n calls takes about log2(n).
    Rows that are not ``final`` then are in or behind a cycle.
    """
    keys = [*scope, own]
    inner = singles.select(*scope, F.col(own).alias("end"), F.lit(False).alias("final"))
    paths = keep(
        singles.withColumnRenamed("dep", "end").join(inner, [*scope, "end"], "left")
        .select(*keys, "end", F.lit(1).cast("bigint").alias("steps"), F.coalesce("final", F.lit(True)).alias("final")),
        "paths",
    )
    for _ in range(paths.count().bit_length()):
        if not paths.where("not final").limit(1).count():
            break
        behind = paths.select(*scope, F.col(own).alias("end"), F.struct("end", "steps", "final").alias("behind"))
        longer = paths.where("not final").join(behind, [*scope, "end"]).select(
            *keys, F.col("behind.end").alias("end"), (F.col("steps") + F.col("behind.steps")).alias("steps"), F.col("behind.final").alias("final")
        )
        before, paths = paths, keep(paths.where("final").union(longer), "paths")
        drop(before)
    return paths


def topological_levels(calls: DataFrame, keys: list[str], depends_on: str = "depends_on") -> DataFrame:
    """``keys``, ``level``: 0 for calls that depend on no known call, else one more than the latest of those.

    ``keys`` ends with the call's identifier, ``depends_on`` holds identifiers
    with the same other keys.  Unknown and null identifiers are ignored.  Calls
    in or behind a cycle are left out.

    Calls with one dependency are steps on a path to its end; only calls with
    several wait in rounds, as many as the longest chain of such calls has.
    """
    *scope, own = keys
    nodes = keep(calls.select(*keys, depends_on).where(F.col(own).isNotNull()), "calls")
    known = nodes.select(*scope, F.col(own).alias("dep")).distinct()
    edges = nodes.select(*keys, F.explode(depends_on).alias("dep")).distinct()
    edges = keep(edges.join(known, [*scope, "dep"], "left_semi").select(*keys, "dep"), "edges")
    counted = keep(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("dep")), "counted")
    paths = _paths(counted.where("n = 1").drop("n"), scope, own)

    ready = nodes.select(*keys).distinct().join(counted.select(*keys), keys, "left_anti")
    ready = keep(ready.withColumn("level", F.lit(0).cast("bigint")), "ready")
    levels = ready
    dep = paths.select(*scope, F.col(own).alias("dep"), F.when(F.col("final"), F.struct("end", "steps")).alias("path"))
    waiting = edges.join(counted.where("n > 1").select(*keys), keys, "left_semi").join(dep, [*scope, "dep"], "left")
    waiting = waiting.groupBy(*keys, F.coalesce("path.end", "dep").alias("end")).agg(F.max(1 + F.coalesce("path.steps", F.lit(0))).alias("steps"))
    waiting = keep(waiting.withColumn("level", F.lit(None).cast("bigint")), "waiting")
    while waiting.limit(1).count():
        came = ready.select(*scope, F.col(own).alias("end"), F.col("level").alias("from"))
        seen = keep(
            waiting.join(came, [*scope, "end"], "left")
            .select(*keys, "end", "steps", F.coalesce("level", F.col("from") + F.col("steps")).alias("level")),
            "seen",
        )
        done = seen.groupBy(*keys).agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        ready = keep(done.where("open = 0").drop("open"), "ready")
        drop(waiting)
        waiting = keep(seen.join(ready.select(*keys), keys, "left_anti"), "waiting")
        drop(seen)
        if not ready.limit(1).count():
            break
        levels = levels.union(ready)
    ends = levels.withColumnRenamed(own, "end")
    along = paths.where("final").join(ends, [*scope, "end"]).select(*keys, F.col("level") + F.col("steps"))
    return levels.union(along).select(*keys, F.col("level").cast("int").alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """One row per row of ``calls``: conv_id, call_id, position, level, status, violation, json.

    ``calls`` has conv_id, call_id, position, tool, arguments (JSON text) and
    depends_on (array of call ids); ``results`` has conv_id, call_id, position,
    content.  Of several results of a call the first by position, then content,
    counts.  ``status`` is valid, no_result (valid, but never answered),
    invalid (against the schema; ``violation`` says where), unknown_tool or
    malformed (arguments that are not JSON; they are kept as text).  A call
    without id has no result and level 0; calls in a cycle have no level.
    Results without a call are left out.
    """
    answer = results.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("position", "content")).alias("answer"), F.lit(True).alias("has_result")
    )
    keys = ["conv_id", "call_id"]
    levels = topological_levels(calls, keys)
    linked = calls.select("conv_id", "call_id", "position", "tool", "arguments").join(answer.hint("shuffle_hash"), keys, "left")
    linked = linked.join(levels.hint("shuffle_hash"), keys, "left")
    level = F.when(F.col("call_id").isNull(), 0).otherwise(F.col("level"))
    source = linked.select(
        F.struct("conv_id", "call_id", "position", level.alias("level")).alias("row"),
        F.col("call_id").cast("string").alias("call_id"),
        "tool",
        "arguments",
        F.coalesce("has_result", F.lit(False)).alias("has_result"),
        F.col("answer.content").alias("result"),
    )
    ddl = f"row {source.schema['row'].dataType.simpleString()}, status string, violation string, json string"
    return source.mapInArrow(_finish({k: dict(v) for k, v in schemas.items()}), ddl).select("row.*", "status", "violation", "json")
