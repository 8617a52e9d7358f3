"""Tool-call linking: calls and their results become ordered, checked, canonical records.

Messages carry an identifier within their conversation.  Results meet their calls
by a hash join on (conversation, identifier).  Calls may name identifiers that
they need (``after``).  A conversation of bounded length is ordered within a task; a
longer one in chunks of its positions, round by round (see ``levels``), so none is
gathered in one task.  What is in, or behind, a cycle has no level.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

#: Calls of a conversation that are ordered in one task.
CHUNK_ROWS = 20_000
_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def canonical(value: object) -> str:
    """Keys sorted by code point, no white space, no escapes but the needed ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema's common keywords the value breaks."""
    out: list[str] = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: not {'/'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not const")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    if _TYPES["number"](value) and (value < schema.get("minimum", value) or value > schema.get("maximum", value)):
        out.append(f"{at}: range")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in own:
                out += violations(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            out.append(f"{at}: items")
        if "items" in schema:
            for i, v in enumerate(value):
                out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def _reject(text: str):
    raise ValueError(text)


def _serialise(schemas: dict[str, dict]):
    out = pa.schema([("conv_id", pa.int64()), ("call_id", pa.string()), ("position", pa.int64()), ("name", pa.string()), ("level", pa.int64()), ("status", pa.string()), ("valid", pa.bool_()), ("errors", pa.list_(pa.string())), ("json", pa.string())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                apart = r["status"] in ("repeated_call", "repeated_result", "no_identifier")
                call = r["status"] not in ("no_call", "repeated_result") and not (apart and r["name"] is None and r["arguments"] is None)
                value, errors = None, []
                try:
                    value = json.loads(r["arguments"], parse_constant=_reject) if call else None
                    canonical(value).encode()
                except (TypeError, ValueError, RecursionError):
                    value, errors = r["arguments"], ["$: not JSON"]
                if call and not errors:
                    errors = violations(value, schemas[r["name"]]) if r["name"] in schemas else ["$: no schema"]
                if apart:
                    errors = ["$: no identifier" if r["status"] == "no_identifier" else "$: repeated identifier", *errors]
                record = {"call": {"arguments": value, "id": r["call_id"], "name": r["name"]} if call else None, "result": r["content"]}
                rows.append({**{k: r[k] for k in ("conv_id", "call_id", "position", "name", "level", "status")}, "valid": call and not errors, "errors": errors, "json": canonical(record)})
            yield pa.RecordBatch.from_pylist(rows, out)

    return go


_EDGE = "conv_id long, chunk int, call_id string, need string, outside boolean, level long"
_PLACED = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int32()), ("call_id", pa.string()), ("level", pa.int64())])
_PLACED_DDL = "conv_id long, chunk int, call_id string, level long"


def _place(rows: list[tuple]) -> list[tuple[str, int | None]]:
    """Levels of one group's calls, from rows (call, need, outside, level of an outside need); null where a need has none."""
    waits: dict[str, int] = {}
    level: dict[str, int] = {}
    users: dict[str, list[str]] = {}
    for call, need, outside, known in rows:
        waits.setdefault(call, 0)
        if need is None:
            continue
        if outside and known is not None:
            level[call] = max(level.get(call, 0), known + 1)
            continue
        waits[call] += 1
        if not outside:
            users.setdefault(need, []).append(call)
    ready = [c for c, n in waits.items() if not n]
    done = set(ready)
    for c in ready:  # grows as calls become ready
        level.setdefault(c, 0)
        for u in users.get(c, ()):
            level[u] = max(level.get(u, 0), level[c] + 1)
            waits[u] -= 1
            if not waits[u]:
                done.add(u)
                ready.append(u)
    return [(c, level[c] if c in done else None) for c in waits]


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_place for each run of rows of one (conversation, chunk)."""
    held: list[tuple] = []
    group, out = None, []

    def flush() -> None:
        out.extend((*group, *x) for x in _place(held))
        held.clear()

    for b in batches:
        for conv, chunk, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (conv, chunk) != group:
                if held:
                    flush()
                group = (conv, chunk)
            held.append(tuple(row))
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), _PLACED, strict=True)], schema=_PLACED)
            out.clear()
    if held:
        flush()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), _PLACED, strict=True)], schema=_PLACED)


def levels(calls: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(conv_id, call_id, level): 0 without needs, else one more than the highest need; null in or behind a cycle.

    Needs that name no call of the conversation don't bind.  A conversation of up to
    chunk_rows calls is ordered within a task; a longer one is cut by position into
    chunks of about that many, which are ordered side by side, again for as long as
    levels that crossed from one chunk to another placed something more.
    """
    key = ["conv_id", "call_id"]
    n = calls.groupBy("conv_id").agg(F.count("*").alias("n"), F.percentile_approx("position", [i / 64 for i in range(1, 64)], 1000).alias("cuts")).where(F.col("n") > chunk_rows)
    # Of the 63 cuts between 64 parts, those between n / chunk_rows; a position that several cuts share is dealt among them by hash.
    at = calls.join(n, "conv_id", "left").withColumn("k", F.least(F.lit(64), F.ceil(F.col("n") / chunk_rows)))
    lower = F.size(F.filter("cuts", lambda c: c < F.col("position")))
    upper = F.size(F.filter("cuts", lambda c: c <= F.col("position")))
    part = lower + F.pmod(F.xxhash64("call_id"), upper - lower + 1)
    at = at.withColumn("chunk", F.when(F.col("n").isNull(), 0).otherwise(F.floor(part * F.col("k") / 64)).cast("int")).withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    at = tables.written(at.select(*key, "chunk", "after"), "calls-chunks")
    needs = at.select(*key, "chunk", F.explode("after").alias("need")).distinct()
    needs = needs.join(at.select("conv_id", F.col("call_id").alias("need"), F.col("chunk").alias("at")), ["conv_id", "need"])
    edges = at.select(*key, "chunk").join(needs.select(*key, "need", "at"), key, "left").select("conv_id", "chunk", "call_id", "need", F.coalesce(F.col("chunk") != F.col("at"), F.lit(False)).alias("outside"))
    edges, placed, before = tables.written(edges, "calls-needs"), None, -1
    while True:
        rows = edges.withColumn("level", F.lit(None).cast("long"))
        if placed is not None:
            known = placed.where("level is not null").select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("outside"), "level")
            rows = edges.join(known, ["conv_id", "need", "outside"], "left").select(*edges.columns, "level")
        fresh = tables.written(rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk").mapInArrow(_order, _PLACED_DDL), "calls-placed")
        now = fresh.where("level is not null").count()
        tables.remove(placed)
        placed = fresh
        if now == before or edges.where("outside").isEmpty():
            return placed.select(*key, "level")
        before = now


def _first(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """With the column repeated: whether another row of the same (conv_id, call_id) comes first, by order."""
    rows = tables.written(df.withColumn("uid", F.monotonically_increasing_id()), name)
    first = rows.groupBy("conv_id", "call_id").agg(F.min(F.struct(*order, "uid")).alias("m")).select("conv_id", "call_id", F.col("m.uid").alias("first"))
    return rows.join(first, ["conv_id", "call_id"], "left").withColumn("repeated", F.col("uid") != F.col("first")).drop("uid", "first")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call, and for each result without one.

    calls: conv_id, call_id, position, name, arguments (JSON text), after
    (identifiers); results: conv_id, call_id, position, content.  Columns: conv_id,
    call_id, position, name, level, status (linked, no_result, no_call), valid,
    errors, json (canonical).  Reading a conversation by (level, position) keeps
    every call behind what it needs.

    If an identifier repeats within a conversation, the call, and the result, of
    the smallest position count (of equal positions, the smaller texts); the others are
    rows of status repeated_call and repeated_result, not valid and without level, as are
    rows of null conv_id or call_id (no_identifier).  Null arguments aren't JSON; a null
    result is linked as null.  Columns other than those named don't matter.
    """
    key = ["conv_id", "call_id"]
    sound = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    c = calls.select(*key, F.col("position").cast("long").alias("position"), "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    r = results.select(*key, F.col("position").cast("long").alias("r_position"), "content")
    # Positions, then texts: a struct of nullable columns orders nulls first.
    cs, rs = _first(c.where(sound), ["position", "name", "arguments", "after"], "calls"), _first(r.where(sound), ["r_position", "content"], "results")
    c1 = cs.where("not repeated").drop("repeated")
    both = c1.drop("after").withColumn("has_call", F.lit(True)).join(rs.where("not repeated").drop("repeated").withColumn("has_result", F.lit(True)), key, "full").join(levels(c1), key, "left")
    status = F.when(F.col("has_call").isNull(), "no_call").when(F.col("has_result").isNull(), "no_result").otherwise("linked")
    names = [*key, "position", "name", "level", "status", "arguments", "content"]
    rows = both.withColumn("position", F.coalesce("position", "r_position")).withColumn("status", status).select(names)
    none = lambda kind: F.lit(None).cast(kind)
    for df, at, status in ((cs.where("repeated"), "position", "repeated_call"), (rs.where("repeated"), "r_position", "repeated_result"), (c.where(~sound), "position", "no_identifier"), (r.where(~sound), "r_position", "no_identifier")):
        call = at == "position"
        rows = rows.unionByName(df.select(*key, F.col(at).alias("position"), F.col("name") if call else none("string").alias("name"), none("long").alias("level"), F.lit(status).alias("status"), F.col("arguments") if call else none("string").alias("arguments"), none("string").alias("content") if call else F.col("content")))
    return rows.mapInArrow(_serialise(schemas), "conv_id long, call_id string, position long, name string, level long, status string, valid boolean, errors array<string>, json string")
