"""Tool-call linking for chat data.

Messages are rows (conv_id, turn, role, text). A message of role assistant
whose text is a JSON object with ``tool_calls`` holds calls ``{id, name,
arguments}``; a message of role tool whose text is a JSON object with
``tool_call_id`` is a result. Everything else is a plain message. An argument
that is exactly ``$<id>`` stands for the result of that call.

Calls and results are hash-joined on (conv_id, call id). Calls are ordered
topologically by Kahn's rounds. A conversation of at most ``most`` references is
ordered in one task, together with others up to about as many references again. One with more is ordered by
rounds of joins, each between the calls placed in the round before and those
that wait for them, so a conversation of any size is never in one task; it takes
as many rounds as its longest chain of references. Every event gets ``at`` (a
turn no smaller than that of anything it needs) and ``level`` (greater than that
of anything it needs): (conv_id, at, level, turn, idx) is an order in which
results follow their calls and calls the results they use.

Arguments are validated against the tool's JSON schema (type, properties,
required, additionalProperties, items, enum, minimum, maximum, minLength,
maxLength); a type that is none of JSON's holds for no value. Each event is
serialised as canonical JSON: sorted keys, no spaces, integers without a
fraction, UTF-8 as it is, halves of surrogate pairs as escapes.

status: message, ok, duplicate (a later call or result of an id already used),
unanswered, orphan (a result without a call), malformed (no id or name, an id or
name that is no valid Unicode, arguments that are no object; a message nested
deeper than ``DEPTH``, which stays one event with its text as a string),
unknown_tool, invalid (see errors), dangling (an argument names no call), cyclic.
Null text: an empty message. Very long texts are parsed whole; one that is no
JSON object is a plain message. Null conv_id or turn: a conversation or turn of
its own, first; null ids are no ids. Ties: of calls (or results) with one id the
one with the smallest turn, place and JSON digest counts. Repeated rows: their
calls and results are duplicates of the first. Empty table: empty result. Other
columns are not read.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, drop_cut, partitions

_EVENT = "conv_id long, turn long, idx int, role string, kind string, call_id string, name string, errors array<string>, status string, deps array<string>, json string"
#: Levels of nesting that a message may have.
DEPTH = 100
#: References of a conversation that one task may order.
MOST = 100_000
_HALF = re.compile("[\ud800-\udfff]")
_TYPES = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "integer": lambda x: not isinstance(x, bool) and (isinstance(x, int) or isinstance(x, float) and x.is_integer()),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
}


def canonical(value) -> str:
    """Canonical JSON: equal values have equal texts."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            return None if not math.isfinite(x) else int(x) if x.is_integer() and abs(x) < 2**53 else x
        return x

    return escaped(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def escaped(text: str) -> str:
    """Half surrogate pairs, which no UTF-8 text can hold, as JSON escapes."""
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def too_deep(value, most: int = DEPTH) -> bool:
    layer = [value]
    for _ in range(most + 1):
        layer = [y for x in layer if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if not layer:
            return False
    return True


def violations(value, schema: dict, path: str = "") -> list[str]:
    """What of ``schema`` a value breaks, in a fixed order."""
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(k in _TYPES and _TYPES[k](value) for k in kinds):
        return [f"{path or '/'}: not {'|'.join(kinds)}"]
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        out.append(f"{path or '/'}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}/{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}/{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}/{k}: not allowed")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}/{i}")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            out.append(f"{path or '/'}: length")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            out.append(f"{path or '/'}: range")
    return out


def references(value) -> list[str]:
    """Ids that arguments refer to, sorted."""
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, list):
        return sorted({r for x in value for r in references(x)})
    return [value[1:]] if isinstance(value, str) and len(value) > 1 and value[0] == "$" else []


def _object(text: str, key: str):
    """The object that a text is, if it has the key; the text itself where it is nested too deep; or nothing."""
    if key not in text or not text.lstrip().startswith("{"):
        return None
    try:
        found = json.loads(text)
    except ValueError:
        return None
    except RecursionError:
        return text
    if not isinstance(found, dict) or key not in found:
        return None
    return text if too_deep(found) else found


def _name(x) -> str | None:
    return x if isinstance(x, str) and x and not _HALF.search(x) else None


def events_of(role, text, schemas: dict) -> list[tuple]:
    """(kind, call id, name, errors, status, references, canonical JSON) of the events of one message."""
    text = text or ""
    if role == "assistant" and (found := _object(text, "tool_calls")) is not None:
        if isinstance(found, str):
            return [("message", None, None, [], "malformed", [], canonical({"role": role, "content": text}))]
        if isinstance(found["tool_calls"], list):
            out = []
            if found.get("content") not in (None, ""):
                out.append(("message", None, None, [], "message", [], canonical({"role": role, "content": found["content"]})))
            return out + [_call(x, schemas) for x in found["tool_calls"]]
    if role == "tool" and (found := _object(text, "tool_call_id")) is not None:
        if isinstance(found, str):
            return [("message", None, None, [], "malformed", [], canonical({"role": role, "content": text}))]
        cid = _name(found["tool_call_id"])
        return [("result", cid, None, [], None if cid else "malformed", [], canonical(found | {"role": "tool"}))]
    return [("message", None, None, [], "message", [], canonical({"role": role, "content": text}))]


def _call(call, schemas: dict) -> tuple:
    call = call if isinstance(call, dict) else {}
    args = call.get("arguments", {})
    if isinstance(args, str):
        try:
            inner = json.loads(args)
            args = args if too_deep(inner) else inner
        except (ValueError, RecursionError):
            pass
    cid, name = _name(call.get("id")), _name(call.get("name"))
    good = bool(cid and name) and isinstance(args, dict)
    errors = [escaped(x) for x in violations(args, schemas[name])] if good and name in schemas else []
    status = "malformed" if not good else "unknown_tool" if name not in schemas else "invalid" if errors else None
    told = canonical({"id": call.get("id"), "name": call.get("name"), "arguments": args})
    return "call", cid, name, errors, status, [escaped(x) for x in references(args)] if good else [], told


def parse(messages: DataFrame, schemas: dict) -> DataFrame:
    """One row for each event of every message."""
    bound_batches(messages.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.string()]
    names = [x.split()[0] for x in _EVENT.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for conv, turn, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text"))):
                for i, (kind, cid, name, errors, status, deps, told) in enumerate(events_of(role, text, schemas)):
                    out.append((conv, turn, i, role, kind, cid, name, errors, status, deps, told))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    return messages.select("conv_id", "turn", "role", "text").mapInArrow(run, _EVENT)


def _order(rows: pa.Table) -> pa.Table:
    """Kahn's rounds over the references of some conversations; rows are calls with one thing that they need."""
    need: dict[tuple, set[tuple]] = {}
    turns: dict[tuple, tuple] = {}
    for conv, call, dep, c, r, dc, dr in zip(*(rows.column(k).to_pylist() for k in ("conv_id", "call_id", "dep", "c_turn", "r_turn", "dep_c", "dep_r"))):
        need.setdefault((conv, call), set()).add((conv, dep))
        turns[conv, call], turns[conv, dep] = (c, r), (dc, dr)
    waiting: dict[tuple, list[tuple]] = {}
    for call, deps in need.items():
        for dep in deps:
            waiting.setdefault(dep, []).append(call)
    open_ = {call: len(deps) for call, deps in need.items()}
    level, at, done = {}, {}, {}

    def place(call: tuple, lv: int, after: int) -> None:
        c, r = turns[call]
        level[call], at[call] = lv, max(after, -1 if c is None else c)
        done[call] = max(at[call], -1 if r is None else r)

    wave = [x for x in turns if x not in need]
    for x in wave:
        place(x, 0, -1)
    while wave:
        ready = []
        for x in wave:
            for call in waiting.get(x, ()):
                open_[call] -= 1
                if not open_[call]:
                    ready.append(call)
        for call in ready:
            place(call, max(level[d] for d in need[call]) + 2, max(done[d] for d in need[call]))
        wave = ready
    stuck = {call for call in need if call not in level}
    for call in stuck:
        place(call, 0, -1)
    names = list(need)
    columns = [pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.string())]
    columns += [pa.array([x[k] for k in names], t) for x, t in ((level, pa.int32()), (at, pa.int64()), (done, pa.int64()))]
    return pa.Table.from_arrays([*columns, pa.array([k in stuck for k in names], pa.bool_())], names=["conv_id", "call_id", "level", "at", "done_at", "cyclic"])


_PLACED = "conv_id long, call_id string, level int, at long, done_at long, cyclic boolean"


def _rounds(edges: DataFrame) -> DataFrame:
    """The same by joins, for conversations of any size. Each round the calls placed last meet the
    references to them; a call is placed when as many as it has are met."""
    key = ["conv_id", "call_id"]

    def on(a, b):
        return a["conv_id"].eqNullSafe(b["_conv"]) & (a["call_id"] == b["_call"])

    def placed(df, cyclic=False):
        at = F.greatest(F.coalesce("c_turn", F.lit(-1)), "need_at")
        return df.select(*key, F.col("need_level").cast("int").alias("level"), at.cast("long").alias("at"), F.greatest(at, F.coalesce("r_turn", F.lit(-1))).cast("long").alias("done_at"), F.lit(cyclic).alias("cyclic"))

    first = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n_open"), F.first("c_turn").alias("c_turn"), F.first("r_turn").alias("r_turn"))
    state = cut(first.withColumn("need_level", F.lit(0)).withColumn("need_at", F.lit(-1).cast("long")))
    names = state.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"))
    free = edges.select("conv_id", F.col("dep").alias("call_id"), F.col("dep_c").alias("c_turn"), F.col("dep_r").alias("r_turn")).dropDuplicates(key)
    wave = cut(placed(free.join(names, on(free, names), "left_anti").withColumn("need_level", F.lit(0)).withColumn("need_at", F.lit(-1).cast("long"))))
    waves, old = [], [wave]
    while wave.limit(1).count():
        w = wave.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), "level", "done_at")
        met = edges.join(w, edges["conv_id"].eqNullSafe(w["_conv"]) & (edges["dep"] == w["_call"]))
        met = met.groupBy(*key).agg(F.count(F.lit(1)).alias("met"), (F.max("level") + 2).alias("new_level"), F.max("done_at").alias("new_at"))
        m = met.withColumnRenamed("conv_id", "_conv").withColumnRenamed("call_id", "_call")
        new = state.join(m, on(state, m), "left").select(*key, (F.col("n_open") - F.coalesce("met", F.lit(0))).alias("n_open"), "c_turn", "r_turn", F.greatest("need_level", F.coalesce("new_level", F.lit(0))).alias("need_level"), F.greatest("need_at", F.coalesce("new_at", F.lit(-1))).alias("need_at"))
        new = cut(new)
        wave = cut(placed(new.where("n_open = 0")))
        waves.append(wave)
        drop_cut(state)
        state = cut(new.where("n_open > 0"))
        old += [new]
    out = placed(state.withColumn("need_level", F.lit(0)).withColumn("need_at", F.lit(-1).cast("long")), True)
    for x in waves:
        out = out.unionByName(x)
    out = cut(out)
    for x in (*waves, *old, state):
        drop_cut(x)
    return out


def link(messages: DataFrame, schemas: dict, most: int = MOST) -> DataFrame:
    """conv_id, turn, idx, role, kind, call_id, name, status, errors, at, level and json of every event."""
    everything = cut(parse(messages, schemas))
    key = ["conv_id", "call_id"]
    # events at one place are told apart by a digest, so texts stay out of the joins
    place = F.struct(F.col("turn").alias("turn"), F.col("idx").alias("idx"), F.md5("json").alias("tag"))

    def first(kind, c):
        return everything.where((F.col("kind") == kind) & F.col("call_id").isNotNull()).groupBy(*key).agg(F.min(place).alias(c))

    def on(a, b):
        return a["conv_id"].eqNullSafe(b["_conv"]) & (a["call_id"] == b["_call"])

    def renamed(df):
        return df.withColumnRenamed("conv_id", "_conv").withColumnRenamed("call_id", "_call")

    calls, results = first("call", "c"), renamed(first("result", "r"))
    pair = cut(calls.join(results, on(calls, results), "left").select(*key, "c", "r"))

    # the calls with references, and which of those exist
    used = everything.where("kind = 'call' AND call_id IS NOT NULL AND size(deps) > 0")
    p2 = renamed(pair)
    used = used.join(p2, on(used, p2)).where("turn <=> c.turn AND idx = c.idx AND md5(json) = c.tag").select(*key, "deps", F.col("c.turn").alias("c_turn"), F.col("r.turn").alias("r_turn")).dropDuplicates(key)
    edges = used.select(*key, "c_turn", "r_turn", F.explode("deps").alias("dep"))
    known = pair.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.col("c.turn").alias("dep_c"), F.col("r.turn").alias("dep_r"), F.lit(True).alias("there"))
    edges = cut(edges.join(known, edges["conv_id"].eqNullSafe(known["_conv"]) & (edges["dep"] == known["_call"]), "left").select(*key, "c_turn", "r_turn", "dep", "dep_c", "dep_r", F.coalesce("there", F.lit(False)).alias("there")))
    dangling = edges.where(~F.col("there")).select(*key).distinct().withColumn("dangles", F.lit(True))
    open_edges = edges.where("there").drop("there")

    # conversations by their number of references: most are ordered in tasks of about ``most`` of them, the others by rounds
    counted = cut(open_edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = counted.where(F.col("n") > most).select(F.col("conv_id").alias("_conv"))

    def dealt(df):
        task = F.pmod(F.xxhash64("conv_id"), F.lit(max(partitions(everything.sparkSession), total // max(most, 1))))
        return df.withColumn("task", task).groupBy("task").applyInArrow(_order, _PLACED)

    if large.limit(1).count():
        is_large = open_edges["conv_id"].eqNullSafe(large["_conv"])
        ordered = dealt(open_edges.join(large, is_large, "left_anti")).unionByName(_rounds(cut(open_edges.join(large, is_large, "left_semi"))))
    else:
        ordered = dealt(open_edges)
    ordered = cut(ordered)
    drop_cut(counted)
    o = renamed(ordered.select(*key))
    at = F.coalesce("c.turn", F.lit(-1)).cast("long")
    free = pair.join(o, on(pair, o), "left_anti").select(*key, F.lit(0).alias("level"), at.alias("at"), F.greatest(at, F.coalesce("r.turn", F.lit(-1))).cast("long").alias("done_at"), F.lit(False).alias("cyclic"))
    levels = ordered.unionByName(free)

    a, b = renamed(levels), renamed(dangling)
    facts = pair.join(a, on(pair, a)).select(*key, "c", "r", "level", "at", "done_at", "cyclic")
    facts = facts.join(b, on(facts, b), "left").select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), "c", "r", F.col("level").alias("_level"), "at", "done_at", "cyclic", F.coalesce("dangles", F.lit(False)).alias("dangles"))
    # equal events at one place: a hash of nothing tells them apart, so all but one count as duplicates
    tied = everything.groupBy("conv_id", "turn", "idx", "role", "kind", "call_id", "name", "errors", "status", "deps", "json").agg(F.count(F.lit(1)).alias("n"))
    each = tied.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n", "deps")
    e = each.alias("e")
    j = e.join(facts.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f._conv")) & (F.col("e.call_id") == F.col("f._call")), "left")
    own = F.when(F.col("e.kind") == "call", F.col("f.c")).otherwise(F.col("f.r"))
    is_first = (F.col("e.copy") == 1) & F.col("e.turn").eqNullSafe(own["turn"]) & (F.col("e.idx") == own["idx"]) & (F.md5(F.col("e.json")) == own["tag"])
    status = (
        F.when(F.col("e.status").isin("message", "malformed"), F.col("e.status"))
        .when((F.col("e.kind") == "result") & F.col("f._call").isNull(), "orphan")
        .when(~is_first, "duplicate")
        .when(F.col("e.status").isNotNull(), F.col("e.status"))
        .when(F.col("e.kind") == "result", "ok")
        .when(F.col("f.cyclic"), "cyclic")
        .when(F.col("f.dangles"), "dangling")
        .when(F.col("f.r").isNull(), "unanswered")
        .otherwise("ok")
    )
    linked = ~status.isin("message", "malformed", "orphan", "duplicate")
    at = F.when(linked & (F.col("e.kind") == "call"), F.col("f.at")).when(linked, F.col("f.done_at")).otherwise(F.coalesce("e.turn", F.lit(-1)))
    level = F.when(linked, F.col("f._level") + F.when(F.col("e.kind") == "result", 1).otherwise(0)).otherwise(F.lit(-1))
    return j.select(*(F.col(f"e.{c}").alias(c) for c in ("conv_id", "turn", "idx", "role", "kind", "call_id", "name")), status.alias("status"), F.col("e.errors").alias("errors"), at.cast("long").alias("at"), level.cast("int").alias("level"), F.col("e.json").alias("json"))


#: The tool that the conversations table is read as using: each user turn calls it, the turn after it is its result.
REPLY = {
    "reply": {
        "type": "object",
        "required": ["prompt"],
        "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "opening": {"type": "string"}},
    }
}


def as_tool_traffic(conversations: DataFrame) -> DataFrame:
    """Conversations as tool traffic: a user turn is a call named after it, which refers
    to the first user turn (0, or 1 behind a system turn); an assistant turn is the result of the turn before."""
    turn = F.col("turn").cast("string")
    opening = F.when(F.col("turn") > 1, F.concat(F.lit("$t"), F.pmod("turn", F.lit(2)).cast("string")))
    arguments = F.struct(F.coalesce("text", F.lit("")).alias("prompt"), opening.alias("opening"))
    call = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("t"), turn).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.concat(F.lit("t"), (F.col("turn") - 1).cast("string")).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content")))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select("conv_id", "turn", F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"), F.when(user, call).when(assistant, result).otherwise(F.col("text")).alias("text"))
