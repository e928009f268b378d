"""Chat formatting: tool calls linked to results, ordered, validated and serialised.

Calls and results meet by a hash join on (conv_id, call_id). A call may name the
call whose result it builds on; these references form a forest, whose depths come
from pointer doubling, so a chain of n calls takes log2(n) joins and no task sees a
whole conversation. Calls are ordered by depth, then turn, then call_id, and their
positions in the conversation are running totals over range-sorted rows that begin
anew with each conversation, so that a conversation with a third of all rows is split.
Arguments are checked against the schema of the call's tool, and each call is written
as canonical JSON: sorted keys, no spaces, no escapes beyond JSON's own, numbers as
Python writes them. Half of a surrogate pair, which JSON may name and UTF-8 cannot
hold, stays the escape it was.

Defined cases: repeated calls or results of one id count as one, the least by
(turn, text), and ``copies`` says how many calls there were; a result without a
call has status ``orphan``; a call without a result ``unanswered``; arguments that
are null, no JSON object or break the schema give ``invalid`` with the reasons; a
reference to no call makes a root; calls on a cycle of references have depth null,
status ``cyclic`` and come last. Turns that are neither call nor result may be given
as context: rows of status ``context`` with their role as name, which come last, as
all without a depth. Rows with a null conv_id or call_id are linked to nothing: they
are left out, as no id can be written for them. Numbers beyond a double, NaN and
arguments nested deeper than Python reads are no JSON here; of a key that stands twice in
an object the last counts. Arguments and contents of any length are written whole.
Empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prefix_sums

#: JSON types by name, as a schema gives them.
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


_HALF = re.compile("[\ud800-\udfff]")


def writable(text: str) -> str:
    """The text with halves of surrogate pairs as the escapes of JSON."""
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return writable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def problems(value, schema: dict, path: str = "$") -> list[str]:
    """What breaks the schema (type, required, properties, additionalProperties, items, enum)."""
    kind = schema.get("type")
    if kind:
        right = isinstance(value, TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))
        if not right:
            return [f"{path}: not {kind}"]
    found = [] if "enum" not in schema or value in schema["enum"] else [f"{path}: not in enum"]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{path}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{path}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += problems(x, schema["items"], f"{path}[{i}]")
    return found


def _reject(constant: str):
    raise ValueError(constant)


def _number(text: str) -> float:
    value = float(text)
    return value if abs(value) < float("inf") else _reject(text)


def checked(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[object, list[str]]:
    if name not in schemas:
        return arguments, ["unknown tool"]
    try:
        value = json.loads(arguments or "", parse_constant=_reject, parse_float=_number)
        canonical(value)
        return value, [writable(p) for p in problems(value, schemas[name])]
    except (ValueError, RecursionError):
        return arguments, ["$: not JSON"]


def _written(schemas: dict[str, dict]):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, reasons, states = [], [], []
            for r in batch.to_pylist():
                if r["is_call"]:
                    value, wrong = checked(r["name"], r["arguments"], schemas)
                    state = "cyclic" if r["cyclic"] else "invalid" if wrong else "unanswered" if not r["answered"] else "linked"
                    line = {"arguments": value, "depth": r["depth"], "id": r["call_id"], "name": r["name"], "parent": r["parent"], "result": r["content"], "valid": not wrong}
                elif r["is_context"]:
                    wrong, state, line = [], "context", {"content": r["content"], "id": r["call_id"], "role": r["name"]}
                else:
                    wrong, state, line = [], "orphan", {"id": r["call_id"], "result": r["content"]}
                out.append(canonical(line))
                reasons.append(wrong)
                states.append(state)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("conv_id", "call_id", "name", "depth", "turn", "copies")]
            yield pa.record_batch([*kept, pa.array(states, pa.string()), pa.array(reasons, pa.list_(pa.string())), pa.array(out, pa.string())], ["conv_id", "call_id", "name", "depth", "turn", "copies", "status", "errors", "json"])

    return write


def depths(calls: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, parent) with depth: 0 for roots, null on and above cycles."""
    known = calls.select("conv_id", F.col("call_id").alias("parent"), F.lit(True).alias("_there"))
    state = calls.join(known, ["conv_id", "parent"], "left").select("conv_id", "call_id", F.when(F.col("_there"), F.col("parent")).alias("up"), F.when(F.col("_there"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("depth"))
    state = cut(state)
    open_rows, limit = state.where("up is not null").count(), 1
    while open_rows:
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("_next"), F.col("depth").alias("_more"))
        state = cut(state.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("_next").alias("up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")))
        left = state.where("up is not null").count()
        # A pointer now spans 2 ** limit steps; a forest of n calls is done by then.
        limit += 1
        if left and 2**limit > 4 * max(2, state.count()):
            break
        open_rows = left
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], context: DataFrame | None = None) -> DataFrame:
    """One row per call, per result without a call and per row of context.

    calls: conv_id, call_id, parent, turn, name, arguments (JSON text); results:
    conv_id, call_id, turn, content; context: conv_id, call_id, turn, role, content.
    Returns conv_id, position (from 1), call_id, name, depth, turn, copies, status,
    errors, json.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    least = F.min(F.struct("turn", "arguments", "name", "parent"))
    calls = calls.where(named).groupBy("conv_id", "call_id").agg(least.alias("c"), F.count("*").alias("copies")).select("conv_id", "call_id", "c.*", "copies")
    calls = cut(calls)
    results = results.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("r")).select("conv_id", "call_id", "r.*", F.lit(True).alias("answered"))
    deep = depths(calls.select("conv_id", "call_id", "parent"))
    joined = calls.withColumn("is_call", F.lit(True)).join(deep, ["conv_id", "call_id"]).join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    rows = joined.select(
        "conv_id", "call_id", "name", "arguments", "parent", "content", "depth", F.coalesce("turn", "result_turn").alias("turn"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"),
        F.coalesce("is_call", F.lit(False)).alias("is_call"), F.coalesce("answered", F.lit(False)).alias("answered"), (F.col("is_call") & F.col("depth").isNull()).alias("cyclic"),
        F.lit(False).alias("is_context"),
    )
    if context is not None:
        one = context.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content", "role")).alias("x"), F.count("*").alias("copies")).select("conv_id", "call_id", "x.*", "copies")
        rows = rows.unionByName(one.withColumnRenamed("role", "name").withColumn("is_context", F.lit(True)), allowMissingColumns=True)
    conv, call = (calls.schema[c].dataType.simpleString() for c in ("conv_id", "call_id"))
    written = cut(rows.mapInArrow(_written(schemas), f"conv_id {conv}, call_id {call}, name string, depth long, turn long, copies long, status string, errors array<string>, json string"))
    # A row of context may have the id of a call.
    written = written.withColumn("_context", F.col("status") == "context")
    late = F.coalesce("depth", F.lit(2**62))
    order = [late, F.col("_context"), F.coalesce("turn", F.lit(2**62)), F.col("call_id")]
    placed = prefix_sums(written.select("conv_id", "call_id", "_context", "depth", "turn"), order, {"position": F.lit(1)}, group=[F.col("conv_id")]).select("conv_id", "call_id", "_context", "position")
    return written.join(placed, ["conv_id", "call_id", "_context"]).select("conv_id", "position", "call_id", "name", "depth", "turn", "copies", "status", "errors", "json")
