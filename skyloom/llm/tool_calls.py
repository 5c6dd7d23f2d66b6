"""Tool calls of conversations, linked with their results.

Calls and results are joined by conversation and identifier.  A call may wait
for one other call; its level is the number of calls it waits for in turn, so
levels order the calls topologically.  Levels come from pointer doubling, in as
many rounds as the longest chain has binary digits, and never need a whole
conversation in one place.  Arguments are held against the tool's schema, and
each call becomes one line of canonical JSON: sorted keys, no spaces, every
number and string written one way.

Defined results
    several calls with one identifier    the first turn is the call, others are ``repeated``
    several results for a call           the first turn counts, others are ``repeated``
    a call without result                ``open``
    a result without call                ``orphan``, with no level and no name
    waiting for an unknown call          level 0 and the problem ``unknown dependency``
    waiting in a circle, or for one      no level and the problem ``circular dependency``
    arguments that are no JSON object    the problem ``arguments: no object``; null in the JSON
    null identifiers or conversations    link with nothing: ``open`` or ``orphan``
    whole rows repeated                  all but one are ``repeated``
    extra columns                        ignored
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.session import materialise

#: Of each tool, each argument's JSON type and whether it must be there.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}

_LINE = "conv_id long, turn long, call_id string, name string, level long, status string, problem string, line string"


def _problem(arguments: object, schema: Mapping[str, tuple[str, bool]] | None) -> str | None:
    """The first fault of the arguments, by argument name."""
    if not isinstance(arguments, dict):
        return "arguments: no object"
    if schema is None:
        return "unknown tool"
    for name in sorted({*arguments, *schema}):
        if name not in schema:
            return f"{name}: not in the schema"
        kind, needed = schema[name]
        if name not in arguments:
            if needed:
                return f"{name}: missing"
            continue
        value = arguments[name]
        if not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind != "boolean"):
            return f"{name}: no {kind}"
    return None


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def _lines(schemas: Schemas):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problems, lines = [], []
            for r in batch.to_pylist():
                arguments = _parsed(r["arguments"])
                orphan = r["status"] == "orphan" or (r["status"] == "repeated" and r["result_turn"] is not None and r["name"] is None)
                problems.append(None if orphan else r["problem"] or _problem(arguments, schemas.get(r["name"])))
                line = {"call": r["call_id"], "conversation": r["conv_id"], "result": r["content"], "turn": r["turn"]}
                if not orphan:
                    line |= {"arguments": arguments if isinstance(arguments, dict) else None, "level": r["level"], "name": r["name"]}
                lines.append(canonical(line))
            kept = [batch.column(c) for c in ("conv_id", "turn", "call_id", "name", "level", "status")]
            names = ["conv_id", "turn", "call_id", "name", "level", "status", "problem", "line"]
            yield pa.record_batch([*kept, pa.array(problems, pa.string()), pa.array(lines, pa.string())], names=names)

    return write


def _told(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``part``: first or again among the rows of one identifier, or null without one.

    The first row is found by a minimum and joined back, so that an identifier
    that very many rows repeat is split like any hot key.
    """
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    named = rows.filter("conv_id is not null and call_id is not null")
    first = named.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", *order, "row"))["row"].alias("first"))
    first = materialise(first, "first")
    part = F.when(F.col("first") == F.col("row"), "first").when(F.col("first").isNotNull(), "again")
    return rows.join(first, ["conv_id", "call_id"], "left").withColumn("part", part).drop("row", "first")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level and problem of calls (conv_id, call_id, after) that have identifiers of their own."""
    names = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    state = calls.join(names, ["conv_id", "after"], "left").select(
        "conv_id", "call_id", F.when(F.col("known"), F.col("after")).alias("next"),
        F.when(F.col("known"), 1).otherwise(0).cast("long").alias("level"),
        (F.col("after").isNotNull() & F.col("known").isNull()).alias("unknown"),
    )
    state = materialise(state, "levels")
    longest = state.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    # a chain that is longer than its conversation has calls runs in a circle
    while reach <= longest and not state.filter("next is not null").isEmpty():
        ahead = state.select("conv_id", F.col("call_id").alias("next"), F.col("next").alias("further"), F.col("level").alias("more"))
        state = state.join(ahead, ["conv_id", "next"], "left").select(
            "conv_id", "call_id", F.col("further").alias("next"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), "unknown",
        )
        state, reach = materialise(state, "levels"), 2 * reach
    circle = F.col("next").isNotNull()
    problem = F.when(circle, "circular dependency").when(F.col("unknown"), "unknown dependency")
    return state.select("conv_id", "call_id", F.when(~circle, F.col("level")).alias("level"), problem.alias("problem"))


def linked(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call, and for each result that no call takes.

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON text) and after,
    ``results`` conv_id, turn, call_id and content.  Returned are conv_id, turn,
    call_id, name, level, status, problem and the canonical JSON ``line``.
    """
    calls = materialise(_told(calls.select("conv_id", "turn", "call_id", "name", "arguments", "after"), "name", "arguments", "after"), "calls")
    results = materialise(_told(results.select("conv_id", F.col("turn").alias("result_turn"), F.col("turn"), "call_id", "content"), "content"), "results")
    first = calls.filter("part = 'first'")
    level = levels(first.select("conv_id", "call_id", "after"))
    answers = results.filter("part = 'first'").select("conv_id", "call_id", "result_turn", "content")
    held = first.join(level, ["conv_id", "call_id"]).join(answers, ["conv_id", "call_id"], "left")
    held = held.withColumn("status", F.when(F.col("result_turn").isNull(), "open").otherwise("linked"))
    columns = ["conv_id", "turn", "call_id", "name", "arguments", "level", "status", "problem", "result_turn", "content"]
    held = held.select(columns)

    none = {"level": "long", "problem": "string", "result_turn": "long", "content": "string"}
    extra = calls.filter("part is null or part <> 'first'").withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    extra = extra.withColumn("status", F.when(F.col("part").isNull(), "open").otherwise("repeated")).select(columns)
    unmet = results.filter("part = 'first'").join(first.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").withColumn("status", F.lit("orphan"))
    again = results.filter("part is null or part <> 'first'").withColumn("status", F.when(F.col("part").isNull(), "orphan").otherwise("repeated"))
    lone = unmet.unionByName(again).withColumns({c: F.lit(None).cast(t) for c, t in {"name": "string", "arguments": "string", "level": "long", "problem": "string"}.items()})
    return held.unionByName(extra).unionByName(lone.select(columns)).mapInArrow(_lines(schemas), _LINE)
