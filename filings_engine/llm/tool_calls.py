"""Tool-call linking for chat data.

Calls and results of a conversation are joined by identifier, ordered so that each call
stands behind the calls it depends on, their arguments validated against the
schema of their tool, and each linked record written as canonical JSON.

Order: calls are sorted by (level, turn, identifier).  A dependency on an earlier call
already holds in that order, so it only hands its level on; one on a later call asks for a
level above that call's.  Levels start at zero and rise by rounds of joins over the calls
whose level changed; without dependencies against the turn order no round changes anything.
A call can rise at most once per such backward dependency of its conversation, so one that
rises more often depends on itself: it is marked ``cycle`` and stays behind the others.
Positions are counted per block of turns and summed, so a long conversation is not one task.

Defined results: rows without conversation or identifier are dropped calls (status
``no_id``), kept with a null position; a repeated identifier keeps its first turn, later ones
are counted in ``repeats``; a call without result is ``no_result``, a result without call
``no_call`` (null position); dependencies on unknown identifiers are ignored; arguments that are null, not
JSON, or not finite are invalid with a reason and canonicalised as null; unknown tools
are invalid; so is an integer of over 4,300 digits (not JSON).  A very long argument text is one
value of a batch; empty tables give an empty result.  Extra columns do not take part.

With ``every``, as the query runs it, each input call and result has its row: the calls of
one identifier are numbered in turn order, ``repeats`` counts those before, and the nth call
meets the nth result.  Results beyond the calls are ``no_call``, too, or ``extra_result`` if
the identifier has calls; results without conversation or identifier are ``no_id_result``.
A dependency is on the last call of its identifier before the asking one, else on the first.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from filings_engine.llm.common import cut_lineage

TURNS_A_BLOCK = 1024
TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
NUMBERS = {"number", "integer"}


def canonical(value) -> str:
    """Sorted keys, no blanks, no escapes beyond JSON's own."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def unique_keys(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("repeated key")
    return found


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def has_type(value, kind: str) -> bool:
    """An unknown type name fits everything."""
    if kind in NUMBERS:
        return is_number(value) and (kind == "number" or value == int(value))
    return isinstance(value, TYPES.get(kind, object))


def equal(a, b) -> bool:
    """Equality of JSON values: 1 is 1.0 but not true."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return a == b


def violations(value, schema: dict | bool, path: str = "$") -> list[str]:
    """Where a value breaks a schema (type, one or a list; enum, required, properties,
    additionalProperties, items, minimum, maximum, minLength, maxLength).  The
    schema ``true`` admits every value, ``false`` none."""
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: not allowed"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(has_type(value, k) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    number = is_number(value)
    out = []
    if "enum" in schema and not any(equal(value, x) for x in schema["enum"]):
        out.append(f"{path}: not in enum")
    if number:
        out += [f"{path}: {k}" for k, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, str):
        out += [f"{path}: {k}" for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))) if bad]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif (more := schema.get("additionalProperties", True)) is False:
                out.append(f"{path}.{k}: unknown")
            else:
                out += violations(value[k], more, f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}[{i}]")
    return out


def check_arguments(name: str | None, arguments: str | None, schemas: dict) -> tuple[object, list[str]]:
    if name not in schemas:
        errors = ["unknown tool"]
    else:
        errors = []
    try:
        value = json.loads(arguments, object_pairs_hook=unique_keys) if arguments is not None else None
        canonical(value).encode()
    except (ValueError, RecursionError):
        return None, errors + ["not JSON"]
    if arguments is None:
        return None, errors + ["no arguments"]
    return value, errors or violations(value, schemas[name])


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv, id, level, cycle) of every call.  calls(conv, id, turn),
    needs(conv, id, needed) with both ends known."""
    child = calls.select("conv", "id", F.col("turn").alias("t"))
    parent = calls.select(F.col("conv").alias("pc"), F.col("id").alias("needed"), F.col("turn").alias("pt"))
    edges = needs.join(child, ["conv", "id"]).join(parent.withColumnRenamed("needed", "pid"), (F.col("conv") == F.col("pc")) & (F.col("needed") == F.col("pid")))
    late = F.struct("pt", "needed") >= F.struct("t", "id")
    edges = cut_lineage(edges.select("conv", "id", "needed", late.cast("int").alias("up")).distinct())
    bound = cut_lineage(edges.groupBy("conv").agg(F.sum("up").alias("bound")).where("bound > 0"))
    # only conversations with a backward dependency have levels
    edges = cut_lineage(edges.join(bound, "conv"))
    raised = cut_lineage(edges.where("up > 0").groupBy("conv", "id").agg(F.lit(1).cast("long").alias("level"), F.first("bound").alias("bound")))
    changed = raised
    while changed.limit(1).count():
        at = changed.select(F.col("conv").alias("c"), F.col("id").alias("i"), "level")
        asked = (edges.join(at, (F.col("conv") == F.col("c")) & (F.col("needed") == F.col("i")))
                 .groupBy("conv", "id").agg(F.max(F.least(F.col("level") + F.col("up"), F.col("bound") + 1)).alias("asked"), F.first("bound").alias("b")))
        both = raised.join(asked, ["conv", "id"], "full")
        both = cut_lineage(both.select("conv", "id", F.coalesce("level", F.lit(0)).cast("long").alias("old"),
                                       F.greatest(F.coalesce("level", F.lit(0)), F.coalesce("asked", F.lit(0))).cast("long").alias("level"), F.coalesce("bound", "b").alias("bound")))
        changed = both.where("level > old").select("conv", "id", "level", "bound")
        raised = both.select("conv", "id", "level", "bound")
    found = calls.select("conv", "id").join(raised, ["conv", "id"], "left")
    return found.select("conv", "id", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce(F.col("level") > F.col("bound"), F.lit(False)).alias("cycle"))


def positions(calls: DataFrame) -> DataFrame:
    """calls(conv, id, turn, level, ...) with the place of each in its conversation."""
    block = calls.withColumn("block", F.floor(F.col("turn") / TURNS_A_BLOCK))
    sizes = block.groupBy("conv", "level", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("level", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv", "level", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("conv", "level", "block").orderBy("turn", "id"))
    return (block.withColumn("inside", inside).join(sizes, ["conv", "level", "block"])
            .withColumn("position", F.col("offset") + F.col("inside") - 1).drop("block", "inside", "offset"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(conv, id, turn, ...) with ``nth``, the place among those of its identifier
    from 0 on, counted per block of turns and summed."""
    block = rows.withColumn("block", F.floor(F.col("turn") / TURNS_A_BLOCK))
    sizes = block.groupBy("conv", "id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv", "id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv", "id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("conv", "id", "block").orderBy("turn", *order))
    return (block.withColumn("inside", inside).join(sizes, ["conv", "id", "block"])
            .withColumn("nth", F.col("offset") + F.col("inside") - 1).drop("block", "inside", "offset"))


def needed_calls(calls: DataFrame) -> DataFrame:
    """(conv, id, needed) between the calls(conv, id, turn, nth, needs) themselves, each
    named by struct(id, nth)."""
    node = F.struct("id", "nth")
    at = F.struct("turn", "id", "nth")
    # each call takes the dependencies behind it up to the next one of its identifier
    until = F.lead(at).over(Window.partitionBy("conv", "id").orderBy("nth"))
    asked = calls.select("conv", F.col("id").alias("name"), node.alias("needed"), at.alias("since"), until.alias("until"))
    asks = calls.select("conv", node.alias("id"), at.alias("at"), F.explode("needs").alias("name"))
    behind = (F.col("needed.nth") == 0) | (F.col("since") < F.col("at"))
    met = asks.join(asked.withColumnRenamed("conv", "c").withColumnRenamed("name", "n"), (F.col("conv") == F.col("c")) & (F.col("name") == F.col("n")) & behind & (F.col("until").isNull() | (F.col("at") <= F.col("until"))))
    return met.select("conv", "id", "needed")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict, every: bool = False) -> DataFrame:
    """calls(conv_id, turn, call_id, name, arguments, needs array<string>) and
    results(conv_id, turn, call_id, content) -> (conv_id, position, call_id, name, status,
    repeats, valid, errors, record canonical JSON)."""
    c = calls.select(F.col("conv_id").alias("conv"), F.col("call_id").alias("id"), F.coalesce(F.col("turn"), F.lit(0)).cast("long").alias("turn"), "name", "arguments", "needs")
    r = results.select(F.col("conv_id").alias("conv"), F.col("call_id").alias("id"), F.coalesce(F.col("turn"), F.lit(0)).cast("long").alias("turn"), "content")
    named = F.col("conv").isNotNull() & F.col("id").isNotNull()
    if every:
        first = numbered(c.where(named), ["name", "arguments", "needs"]).withColumn("repeats", F.col("nth"))
        answer = numbered(r.where(named), ["content"]).select("conv", "id", "nth", "content", F.lit(True).alias("answered"))
    else:
        first = (c.where(named).groupBy("conv", "id").agg(F.min(F.struct("turn", "name", "arguments", "needs")).alias("x"), (F.count("*") - 1).alias("repeats"))
                 .select("conv", "id", "x.*", "repeats", F.lit(0).cast("long").alias("nth")))
        answer = r.where(named).groupBy("conv", "id").agg(F.min(F.struct("turn", "content")).alias("a")).select("conv", "id", F.lit(0).cast("long").alias("nth"), "a.content", F.lit(True).alias("answered"))
    first = cut_lineage(first)
    nodes = first.select("conv", F.struct("id", "nth").alias("id"), "turn")
    ordered = positions(nodes.join(levels(nodes, needed_calls(first)), ["conv", "id"])).select("conv", "id.id", "id.nth", "position", "cycle")
    linked = first.drop("turn").join(ordered, ["conv", "id", "nth"]).join(answer, ["conv", "id", "nth"], "full")
    status = (F.when(F.col("repeats").isNull(), F.when(F.col("nth") > 0, "extra_result").otherwise("no_call")).when(F.col("cycle"), "cycle").when(F.col("answered").isNull(), "no_result").otherwise("linked"))
    linked = linked.select("conv", "position", "id", "nth", "name", "arguments", "content", status.alias("status"), F.coalesce("repeats", F.lit(0)).cast("long").alias("repeats"))
    if every:
        # a result beyond the first of an identifier that has no call at all
        known = first.where("nth = 0").select(F.col("conv").alias("c"), F.col("id").alias("i"))
        lost = linked.where("status = 'extra_result'")
        none = lost.join(known, (F.col("conv") == F.col("c")) & (F.col("id") == F.col("i")), "left_anti").withColumn("status", F.lit("no_call"))
        some = lost.join(known, (F.col("conv") == F.col("c")) & (F.col("id") == F.col("i")), "left_semi")
        linked = linked.where("status <> 'extra_result'").unionByName(none).unionByName(some)
    linked = linked.drop("nth")
    none = {k: F.lit(None).cast(t) for k, t in (("position", "long"), ("text", "string"))}
    loose = c.where(~named).select("conv", none["position"].alias("position"), "id", "name", "arguments", none["text"].alias("content"), F.lit("no_id").alias("status"), F.lit(0).cast("long").alias("repeats"))
    if every:
        loose = loose.unionByName(r.where(~named).select("conv", none["position"].alias("position"), "id", none["text"].alias("name"), none["text"].alias("arguments"), "content",
                                                        F.lit("no_id_result").alias("status"), F.lit(0).cast("long").alias("repeats")))
    linked = linked.unionByName(loose)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, errors, records = [], [], []
            for row in zip(*[b.column(k).to_pylist() for k in ("id", "name", "arguments", "content", "status")]):
                value, bad = check_arguments(row[1], row[2], schemas) if row[4] not in ("no_call", "extra_result", "no_id_result") else (None, [])
                valid.append(not bad)
                errors.append("; ".join(bad))
                records.append(canonical({"arguments": value, "id": row[0], "name": row[1], "result": row[3], "status": row[4]}))
            yield pa.record_batch([*[b.column(k) for k in ("conv", "position", "id", "name", "status", "repeats")], pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(records, pa.string())],
                                  names=["conv_id", "position", "call_id", "name", "status", "repeats", "valid", "errors", "record"])

    kind = linked.schema["conv"].dataType.simpleString()
    return linked.mapInArrow(run, f"conv_id {kind}, position long, call_id string, name string, status string, repeats long, valid boolean, errors string, record string")


# --- calls and results read off plain conversations ----------------------
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "minLength": 3}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "note": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "maxLength": 400}, "lines": {"type": "integer", "minimum": 1, "maximum": 3}}},
}


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations(conv_id, turn, role, text) as calls and results: each user turn
    asks a tool with its text, each assistant turn answers the user turn before it.  A
    user turn may need the user turn two before (by text hash), or the one two after,
    which is a dependency against the turn order."""
    name = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    pick = F.pmod(F.xxhash64("text"), F.lit(16))
    asks = turns.where("role = 'user'")
    words = F.size(F.split("text", " "))
    tool = F.when(F.length("text") % 2 == 0, "search").otherwise("note")
    # keys are written out of order on purpose: the canonical form sorts them
    search = F.to_json(F.struct(words.alias("limit"), F.col("text").alias("query")))
    note = F.to_json(F.struct(F.col("text"), F.regexp_count("text", F.lit("\n")).alias("lines")))
    needs = F.when(pick < 6, F.array(name(F.col("turn") - 2))).when(pick == 6, F.array(name(F.col("turn") + 2))).otherwise(F.array().cast("array<string>"))
    calls = asks.select("conv_id", "turn", name(F.col("turn")).alias("call_id"), tool.alias("name"), F.when(tool == "search", search).otherwise(note).alias("arguments"), needs.alias("needs"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
