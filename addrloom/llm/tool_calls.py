"""Tool calls in conversations: linked to their results, ordered, validated, and written as canonical JSON.

A message's text may be a JSON object: of an assistant with "tool_calls" (objects with "id", "name" and "arguments"), or of a
tool with "tool_call_id" and "content". Everything else is plain content. Every message gets a row key, by which its calls come
back to it. Calls and results are hash-joined on (conversation, identifier); of several calls with one identifier the first by
turn and place counts and the others are duplicates; of several results the first after the call counts. A call depends on the
calls whose identifiers its arguments name as {"$ref": id}. Its level is one more than the deepest of them: chains of calls with
one dependency each are contracted by pointer doubling, so their rounds grow with the logarithm of their length; only calls
with several dependencies on each other cost a round a level. Calls on a cycle or behind one get no level. Nothing is gathered
by conversation or identifier, so a hot one is no hot task.

Null texts are null content; null conversation ids or identifiers link with nothing; repeated rows are messages of their own;
of tied calls (same turn and place) the first by name, arguments and its message's hash counts, equal ones are interchangeable; extra columns are ignored; an empty
table gives no row. Texts are read whole, however long. JSON nested deeper than ``DEPTH`` levels, with NaN, an infinity or a
number that becomes one is not read: a message stays plain content, arguments given as such a string stay a string with the
status "bad arguments". Lone surrogates become U+FFFD.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import finished, slices, staged, table

#: GRAPH_EDGES: a conversation's calls are ordered by one worker up to so many dependencies.
DEPTH, GRAPH_EDGES = 200, 100_000
_KINDS = {
    "string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict,
    "null": type(None)
}
CALL = "array<struct<at:int,id:string,name:string,arguments:string,status:string,needs:array<string>>>"
_SURROGATE = re.compile("[\ud800-\udfff]")


def plain(text: str | None) -> str | None:
    return None if text is None else _SURROGATE.sub("�", text)


def canonical(value) -> str:
    """Keys sorted, no white space, no escapes that JSON does not need."""
    return plain(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(text: str) -> float:
    if not math.isfinite(value := float(text)):
        raise ValueError(text)
    return value


def _refused(text: str):
    raise ValueError(text)


def read(text: str):
    """The JSON value of a text; ValueError if there is none that can be written again."""
    try:
        value = json.loads(text, parse_constant=_refused, parse_float=_finite)
    except RecursionError as deep:
        raise ValueError("nested too deep") from deep
    level, depth = [value], 0
    while level := [
        x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)
    ]:
        depth += 1
        if depth > DEPTH:
            raise ValueError("nested too deep")
    return value


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _KINDS[kind]) or kind == "integer" and isinstance(value, float) and value.is_integer()


def fault(value, schema: dict, path: str = "$") -> str | None:
    """The first violation of a schema (type, enum, required, properties, additionalProperties, items), or None."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(_is(value, k) for k in kinds):
            return f"{path}: not {'/'.join(kinds)}"
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return f"{path}: not in enum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{path}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if found := fault(value[name], known[name], f"{path}.{name}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{path}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := fault(item, schema["items"], f"{path}[{i}]"):
                return found
    return None


def references(value) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return [value["$ref"]]
        return [x for v in value.values() for x in references(v)]
    return [x for v in value for x in references(v)] if isinstance(value, list) else []


def _call(at: int, call: dict, schemas: dict) -> dict:
    name, arguments, bad = call.get("name"), call.get("arguments", {}), False
    if isinstance(arguments, str):
        try:
            arguments = read(arguments)
        except ValueError:
            bad = True
    known = isinstance(name, str) and name in schemas
    status = "unknown tool" if not known else "bad arguments" if bad else fault(arguments, schemas[name]) or "valid"
    own = call.get("id")
    return {
        "at": at, "id": plain(own) if isinstance(own, str) else None, "name": plain(name) if isinstance(name, str) else None,
        "arguments": canonical(arguments), "status": plain(status), "needs": sorted(
            set(map(plain, references(arguments)))
        ),
    }


def parse(role: str | None, text: str | None, schemas: dict) -> tuple:
    """(content, calls, id of the call that this is a result of)."""
    if text and role in ("assistant", "tool") and text.lstrip()[:1] == "{":
        try:
            message = read(text)
        except ValueError:
            return text, [], None
        content = message.get("content")
        content = plain(content) if isinstance(content, str) or content is None else canonical(content)
        if role == "tool" and isinstance(message.get("tool_call_id"), str):
            return content, [], plain(message["tool_call_id"])
        if role == "assistant" and isinstance(message.get("tool_calls"), list):
            calls = [x for x in message["tool_calls"] if isinstance(x, dict)]
            return content, [_call(at, call, schemas) for at, call in enumerate(calls)], None
    return text, [], None


def parsed(conversations: DataFrame, schemas: dict) -> DataFrame:
    """row (a key of its own for each message), conv_id, turn, role, content, calls, answers."""
    call = pa.struct(
        [
            ("at", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()),
            ("status", pa.string()), ("needs", pa.list_(pa.string()))
        ]
    )
    names = ["conv_id", "turn", "role", "content", "calls", "answers"]

    def run(batches):
        for batch in slices(batches):
            rows = [
                parse(role, text, schemas) for role,
                text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            content, calls, answers = zip(*rows) if rows else ((), (), ())
            made = [pa.array(content, pa.string()), pa.array(calls, pa.list_(call)), pa.array(answers, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *made], names)

    kinds = dict(conversations.dtypes)
    made = conversations.select("conv_id", "turn", "role", "text").mapInArrow(
        run,
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, content string, calls {CALL}, answers string"
    )
    # Written at once, so that a row keeps its key whatever is computed again later.
    return staged(made.withColumn("row", F.monotonically_increasing_id()))


def _ordered(batches):
    """Edges (graph, node, need), sorted by graph, to the levels of each graph's nodes: those without open needs go first."""
    now, edges, out = None, [], []

    def settled():
        needs, wait, level = {}, {}, {}
        for node, need in edges:
            needs.setdefault(need, []).append(node)
            wait[node] = wait.get(node, 0) + 1
        ready = [n for n in needs if n not in wait]
        level.update((n, 0) for n in ready)
        while ready:
            need = ready.pop()
            for node in needs.get(need, ()):
                level[node] = max(level.get(node, 0), level[need] + 1)
                wait[node] -= 1
                if not wait[node]:
                    ready.append(node)
        edges.clear()
        return [(n, x) for n, x in level.items() if not wait.get(n)]

    for batch in batches:
        out = []
        for graph, node, need in zip(*(batch.column(c).to_pylist() for c in ("graph", "node", "need"))):
            if graph != now:
                out += settled()
                now = graph
            edges.append((node, need))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["node", "level"]
        )
    out = settled()
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["node", "level"]
    )


def levels(edges: DataFrame, most: int = GRAPH_EDGES) -> DataFrame:
    """(node, level) of the nodes (strings) with edges (graph, node, need) to distinct nodes that they depend on, within a graph:
    one more than the deepest need; a need without edges is of level 0. Nodes on a cycle, or with a need that is or is behind
    one, are absent. A graph of at most so many edges is ordered by one worker, a larger one by all of them, in rounds."""
    edges = staged(edges)
    sizes = edges.groupBy("graph").agg(F.count("*").alias("n"))
    large = staged(sizes.where(F.col("n") > most).select(F.col("graph").cast("string").alias("large")))
    on = F.col("graph").cast("string") == F.col("large")
    small = edges.join(large, on, "left_anti").repartition("graph").sortWithinPartitions("graph").select("graph", "node", "need")
    found = small.mapInArrow(_ordered, "node string, level long")
    if large.isEmpty():
        return staged(found)
    return staged(found.unionByName(_levels_in_rounds(edges.join(large, on, "left_semi"))))


def _levels_in_rounds(edges: DataFrame) -> DataFrame:
    """The same for edges (node, need): chains of single needs are followed by doubling, the rest goes level by level."""
    text = lambda c: F.col(c).cast("string")
    left = staged(edges.select("node", F.col("need").alias("to"), F.lit(1).cast("long").alias("w")))
    ground = left.select(F.col("to").alias("node")).distinct().join(left.select("node").distinct(), "node", "left_anti")
    done = staged(ground.withColumn("level", F.lit(0).cast("long")))
    found = []
    while True:
        degree = left.groupBy("node").agg(F.count("*").alias("n"))
        single = staged(
            left.join(
                degree.where("n = 1").select(F.col("node").alias("one")), text("node") == text("one"), "left_semi"
            )
        )
        rounds = single.count().bit_length()
        for _ in range(rounds):  # after as many, what still points to a single node goes around a cycle
            jump = single.select(F.col("node").alias("via"), F.col("to").alias("far"), F.col("w").alias("more"))
            jumped = staged(
                single.join(jump, text("to") == text("via"), "left").select(
                    "node", F.coalesce("far", "to").alias("to"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"),
                    F.col("far").isNotNull().alias("moved")
                )
            )
            moved, single = not jumped.where("moved").isEmpty(), jumped.drop("moved")
            if not moved:
                break
        ends = single.select(F.col("node").alias("via"), F.col("to").alias("far"), F.col("w").alias("more"))
        many = left.join(
            degree.where("n > 1").select(F.col("node").alias("one")), text("node") == text("one"), "left_semi"
        )
        many = many.join(ends, text("to") == text("via"), "left").select(
            "node", F.coalesce("far", "to").alias("to"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")
        )
        left = single.unionByName(many.groupBy("node", "to").agg(F.max("w").alias("w")))
        known = done.select(F.col("node").alias("d"), "level")
        judged = left.join(known, text("to") == text("d"), "left").groupBy("node").agg(
            F.max(F.col("level") + F.col("w")).alias("level"), F.count_if(F.col("level").isNull()).alias("open")
        )
        now = staged(judged.where("open = 0").select("node", "level"))
        if now.isEmpty():
            break
        found.append(now)
        done = staged(done.unionByName(now))
        left = staged(left.join(now.select(F.col("node").alias("d")), text("node") == text("d"), "left_anti"))
        if left.isEmpty():
            break
    return done


def linked(messages: DataFrame) -> DataFrame:
    """A row per call of parsed messages: row, conv_id, turn, at, id, name, arguments, status, level, result_turn, result."""
    calls = staged(
        messages.where("size(calls) > 0").select(
            "row", "conv_id", "turn", F.xxhash64("role", "content", "calls").alias("tie"), F.explode("calls").alias("x")
        ).select("row", "conv_id", "turn", "tie", "x.*").withColumn("node", F.concat_ws(":", "row", "at"))
    )
    place = F.struct("turn", "at", "name", "arguments", "status", "tie", "node")
    named = calls.where("conv_id is not null and id is not null")
    first = staged(
        named.groupBy("conv_id", "id").agg(F.min(place).alias("x")).select(
            F.col("conv_id").alias("c"), F.col("id").alias("i"), F.col("x.node").alias("first"),
            F.col("x.turn").alias("t")
        )
    )
    # The first of each identifier, by its node; keys are cast so that both sides of these joins are dealt anew and can be split.
    key = lambda c, i: F.concat(
        F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"), F.col(i)
    )
    own = first.select(key("c", "i").alias("k"), "first")
    needs = named.select(F.col("node"), "conv_id", F.explode("needs").alias("need")).join(
        first.select(F.col("first").alias("f")), F.col("node") == F.col("f"), "left_semi"
    )
    edges = needs.select(
        F.col("conv_id").cast("string").alias("graph"), "node", key("conv_id", "need").alias("k0")
    ).join(own, F.col("k0") == F.col("k")).select("graph", "node", F.col("first").alias("need")).distinct()
    order = levels(edges)
    results = messages.where("answers is not null and conv_id is not null").select(
        key("conv_id", "answers").alias("k0"), F.col("turn").alias("result_turn"), F.col("content").alias("result")
    )
    results = results.join(
        first.select(key("c", "i").alias("k"), "first", "t"), F.col("k0") == F.col("k")
    ).where("result_turn > t")
    results = results.groupBy("first").agg(
        F.min(F.struct("result_turn", "result")).alias("r")
    ).select(F.col("first").alias("answered"), "r.*")
    level = F.when(F.col("deep").isNotNull(), F.col("deep")).when(F.col("waits").isNull(), F.lit(0).cast("long"))
    out = calls.join(first.select(F.col("first").alias("f")), F.col("node") == F.col("f"), "left")
    out = out.join(results, F.col("node") == F.col("answered"), "left")
    out = out.join(
        order.select(F.col("node").alias("o"), F.col("level").alias("deep")), F.col("node") == F.col("o"), "left"
    )
    out = out.join(edges.select(F.col("node").alias("waits")).distinct(), F.col("node") == F.col("waits"), "left")
    known = F.col("conv_id").isNotNull() & F.col("id").isNotNull()
    status = F.when(known & F.col("f").isNull(), "duplicate").otherwise(F.col("status"))
    return out.select(
        "row", "conv_id", "turn", "at", "id", "name", "arguments", status.alias("status"),
        F.when(F.col("f").isNotNull(), level).alias("level"), "result_turn", "result"
    )


def formatted(conversations: DataFrame, schemas: dict | None = None) -> DataFrame:
    """conv_id, turn, role, message (canonical JSON), n_calls, n_linked: calls of a message by level, then as they stood."""
    messages = parsed(conversations, schemas or {})
    quoted = lambda c: F.expr(
        f"coalesce(substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2), 'null')"
    )
    body = F.concat(
        F.lit('{"arguments":'), "arguments", F.lit(',"id":'), quoted("id"), F.lit(',"name":'), quoted("name"),
        F.lit(',"result":'), quoted("result"), F.lit(',"status":'), quoted("status"), F.lit("}")
    )
    # What is gathered by row came from that one message.
    place = F.struct(F.coalesce("level", F.lit((1 << 62) - 1)).alias("level"), "at", body.alias("json"))
    per = linked(messages).groupBy("row").agg(
        F.array_sort(F.collect_list(place)).alias("listed"), F.count("result_turn").alias("n_linked")
    )
    rows = messages.join(per.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")

    def run(batches):
        for batch in slices(batches):
            out = []
            for role, content, answers, listed in zip(
                *(batch.column(c).to_pylist() for c in ("role", "content", "answers", "listed"))
            ):
                fields = [f'"content":{canonical(content)}', f'"role":{canonical(role)}']
                if answers is not None:
                    fields.append(f'"tool_call_id":{canonical(answers)}')
                if listed:
                    fields.append('"tool_calls":[' + ",".join(x["json"] for x in listed) + "]")
                out.append("{" + ",".join(fields) + "}")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(out, pa.string()),
                    batch.column("n_calls"), batch.column("n_linked")
                ],
                ["conv_id", "turn", "role", "message", "n_calls", "n_linked"]
            )

    kinds = dict(conversations.dtypes)
    rows = rows.select(
        "conv_id", "turn", "role", "content", "answers", "listed", F.size("calls").cast("long").alias("n_calls"),
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked")
    )
    return rows.mapInArrow(
        run,
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, message string, n_calls long, n_linked long"
    )


#: The tools of `traffic`.
SCHEMAS = {
    "measure": {
        "type": "object", "required": ["chars"],
        "properties": {"chars": {"type": "integer"}, "after": {"type": "object"}}, "additionalProperties": False
    },
    "lookup": {
        "type": "object", "required": ["chars", "page"],
        "properties": {"chars": {"type": "integer"}, "page": {"enum": [0, 1, 2]}}
    },
}
TOOLS = ["measure", "lookup", "forecast"]


def traffic(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool traffic, a rule of its own for tables without calls: conv_id, turn, role, text.

    An assistant's text becomes the content of a message with a call "call-<turn>" to one of ``TOOLS``, chosen by the text's
    length, that depends on the call of two turns before; a text of odd length has a call "call-<turn>-b" before it that
    depends on it. A user's message becomes the result of the call of the turn before. Other messages, and those of no turn, stay
    as they are."""
    turn, size = F.col("turn"), F.coalesce(F.length("text"), F.lit(0))
    name = F.element_at(F.array(*map(F.lit, TOOLS)), (size % len(TOOLS) + 1).cast("int"))
    id_ = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    ref = lambda x: F.struct(x.alias("$ref"))
    main = F.struct(
        id_(turn).alias("id"), name.alias("name"),
        F.to_json(
            F.struct(size.alias("chars"), (size % 5).alias("page"), ref(id_(turn - 2)).alias("after"))
        ).alias("arguments")
    )
    small = F.struct(
        id_(turn).alias("id"), name.alias("name"),
        F.to_json(F.struct(size.alias("chars"), ref(id_(turn - 2)).alias("after"))).alias("arguments")
    )
    later = F.struct(
        F.concat(id_(turn), F.lit("-b")).alias("id"), F.lit("measure").alias("name"),
        F.to_json(F.struct(size.alias("chars"), ref(id_(turn)).alias("after"))).alias("arguments")
    )
    own = F.when(size % 2 == 0, F.array(main)).otherwise(F.array(later, small))
    asked = F.to_json(F.struct(F.col("text").alias("content"), own.alias("tool_calls")))
    answer = F.to_json(F.struct(id_(turn - 1).alias("tool_call_id"), F.col("text").alias("content")))
    role = F.when(F.col("role") == "user", "tool").otherwise(F.col("role"))
    text = F.when(turn.isNull(), F.col("text")).when(
        F.col("role") == "assistant", asked
    ).when(F.col("role") == "user", answer).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, lambda: formatted(traffic(table(spark, sf_dir, "conversations")), SCHEMAS))


#: The same rule and its outcome, from the table.
SQL = """
WITH RECURSIVE t AS (SELECT row_number() OVER () AS mid, conv_id, turn, CASE role WHEN 'user' THEN 'tool' ELSE role END AS role, text, coalesce(length(text), 0) AS chars FROM conversations),
k AS (SELECT *, (['measure', 'lookup', 'forecast'])[CAST(chars % 3 + 1 AS INTEGER)] AS tool FROM t WHERE role = 'assistant' AND turn IS NOT NULL),
c AS (
  SELECT mid, conv_id, turn, CAST(chars % 2 AS INTEGER) AS place, 'call-' || turn AS id, tool AS name,
    '{"after":{"$ref":"call-' || (turn - 2) || '"},"chars":' || chars || CASE WHEN chars % 2 = 0 THEN ',"page":' || (chars % 5) ELSE '' END || '}' AS arguments,
    CASE tool WHEN 'forecast' THEN 'unknown tool' WHEN 'measure' THEN CASE WHEN chars % 2 = 0 THEN '$.page: unknown' ELSE 'valid' END
      ELSE CASE WHEN chars % 2 = 1 THEN '$.page: missing' WHEN chars % 5 > 2 THEN '$.page: not in enum' ELSE 'valid' END END AS status, 'call-' || (turn - 2) AS need FROM k
  UNION ALL
  SELECT mid, conv_id, turn, 0, 'call-' || turn || '-b', 'measure', '{"after":{"$ref":"call-' || turn || '"},"chars":' || chars || '}', 'valid', 'call-' || turn FROM k WHERE chars % 2 = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, place, name, arguments, status, mid) AS nth FROM c),
f AS (SELECT * FROM n WHERE nth = 1 AND conv_id IS NOT NULL),
lv(conv_id, id, level) AS (
  SELECT conv_id, id, CAST(0 AS BIGINT) FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.conv_id = f.conv_id AND g.id = f.need)
  UNION ALL SELECT f.conv_id, f.id, lv.level + 1 FROM lv JOIN f ON f.conv_id = lv.conv_id AND f.need = lv.id),
r AS (SELECT conv_id, 'call-' || (turn - 1) AS answers, turn, text FROM t WHERE role = 'tool' AND turn IS NOT NULL),
x AS (SELECT f.mid, f.place, min(r.turn) AS result_turn, arg_min(r.text, (r.turn, r.text)) AS result FROM f JOIN r ON f.conv_id = r.conv_id AND f.id = r.answers AND r.turn > f.turn GROUP BY ALL),
j AS (SELECT n.mid, n.place, lv.level, x.result_turn, '{"arguments":' || n.arguments || ',"id":"' || n.id || '","name":"' || n.name || '","result":' || coalesce(CAST(to_json(x.result) AS VARCHAR), 'null')
    || ',"status":"' || CASE WHEN n.nth > 1 AND n.conv_id IS NOT NULL THEN 'duplicate' ELSE n.status END || '"}' AS json
  FROM n LEFT JOIN x ON n.mid = x.mid AND n.place = x.place LEFT JOIN lv ON n.nth = 1 AND n.conv_id = lv.conv_id AND n.id = lv.id),
p AS (SELECT mid, count(*) AS n_calls, count(result_turn) AS n_linked, string_agg(json, ',' ORDER BY coalesce(level, 4611686018427387903), place) AS listed FROM j GROUP BY mid)
SELECT conv_id, turn, role, '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null')
    || CASE WHEN role = 'tool' AND turn IS NOT NULL THEN ',"tool_call_id":"call-' || (turn - 1) || '"' ELSE '' END || CASE WHEN listed IS NOT NULL THEN ',"tool_calls":[' || listed || ']' ELSE '' END || '}' AS message,
  coalesce(n_calls, 0) AS n_calls, coalesce(n_linked, 0) AS n_linked FROM t LEFT JOIN p USING (mid)
"""
