import json
import random

import brute

from addrloom.llm import tool_calls


def _frame(spark, rows):
    return spark.createDataFrame(
        [(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, row string"
    ).repartition(4)


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


def test_against_brute_force(spark):
    r = random.Random(7)
    schemas = {
        "add": {
            "type": "object", "required": ["a"],
            "properties": {"a": {"type": ["integer", "object"]}, "b": {"enum": [1, 2, "x"]}}
        }
    }
    rows, turn = [], {}
    for i in range(260):
        conv = r.choice([0, 0, 0, 1, 2, None])
        turn[conv] = turn.get(conv, 0) + 1
        ids = [f"c{r.randint(0, 40)}" for _ in range(r.randint(0, 3))] + [None] * r.randint(0, 1)
        call = lambda x: {
            "id": x, "name": r.choice(["add", "none", 5]),
            "arguments": r.choice(
                [
                    {"a": 1}, {"a": {"$ref": f"c{r.randint(0, 40)}"}, "b": [{"$ref": f"c{r.randint(0, 40)}"}]},
                    {"b": True}, '{"a":1.0}', '"NaN"', "NaN", "1e999", "[" * 100_000, "\ud800", {"\ud800": "\udfff"}
                ]
            )
        }
        text = r.choice(
            [
                json.dumps(
                    {"content": r.choice(["x", None, {"k": [1]}]), "tool_calls": [*map(call, ids), "not a call"]}
                ),
                json.dumps({"tool_call_id": f"c{r.randint(0, 40)}", "content": f"r{i}"}), "plain",
                '{"content": "\\ud800"', '{"tool_calls": NaN}', None,
                '{"tool_call_id":"c1","content":"\\ud83d\\ude00 \\ud800"}'
            ]
        )
        rows.append(
            (
                conv, turn[conv],
                r.choice(["assistant", "assistant", "tool", "user"]) if text and "tool_call_id" not in text else "tool",
                text
            )
        )
    rows += [x for x in rows[:30] if not x[3] or "tool_calls" not in x[3]]  # repeated rows
    rows += [(9, 1, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "add", "arguments": {"a": 1}}]}))] * 2
    got = tool_calls.formatted(_frame(spark, rows), schemas)
    assert _sorted(got.collect()) == _sorted(brute.messages(rows, schemas))
    twice = [x for x in got.collect() if x.conv_id == 9]
    assert [x.n_calls for x in twice] == [1, 1] and sorted(
        json.loads(x.message)["tool_calls"][0]["status"] for x in twice
    ) == ["duplicate", "valid"]
    assert tool_calls.formatted(_frame(spark, rows).limit(0)).collect() == []


def test_levels(spark):
    """A chain of a thousand, a ladder in which each has two needs, a cycle with a tail, and diamonds."""
    edges = [(f"c{i + 1}", f"c{i}") for i in range(1000)] + [
        (f"l{i + 2}", f"l{i + d}") for i in range(5) for d in (0, 1)
    ]
    edges += [
        ("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("tail", "z1"), ("late", "tail"), ("late", "c3"), ("self", "self")
    ]
    edges += [
        e for i in range(4)
        for e in ((f"b{i}", f"d{i}"), (f"e{i}", f"d{i}"), (f"d{i + 1}", f"b{i}"), (f"d{i + 1}", f"e{i}"))
    ]
    rows = [("g" if n[0] in "czts" or n == "late" else "h", n, m) for n, m in edges]
    df = spark.createDataFrame(rows, "graph string, node string, need string").repartition(3)
    at_once, mixed = ([tuple(x) for x in tool_calls.levels(df, most).collect()] for most in (10**6, 500))
    assert sorted(at_once) == sorted(mixed) and len(dict(at_once)) == len(at_once)
    got = dict(at_once)
    want = {f"c{i}": i for i in range(1001)} | {
        f"l{i}": max(0, i - 1) for i in range(7)
    } | {f"d{i}": 2 * i for i in range(5)} | {
        f"{x}{i}": 2 * i + 1 for x in "be" for i in range(4)
    }
    assert got == want


def test_a_ladder_of_a_thousand_levels(spark):
    edges = [("g", f"l{i + 2}", f"l{i + d}") for i in range(1000) for d in (0, 1)]
    df = spark.createDataFrame(edges, "graph string, node string, need string")
    assert {x.node: x.level for x in tool_calls.levels(df).collect()} == {f"l{i}": max(0, i - 1) for i in range(1002)}


def test_traffic_links(spark):
    rows = [
        (c, t, ["user", "assistant"][t % 2], f"text {c} {'x' * (t * c % 7)}") for c in range(3) for t in range(9)
    ] + [(3, None, "assistant", "t"), (4, 0, "system", "s"), (None, 1, "assistant", None)]
    made = tool_calls.traffic(_frame(spark, rows))
    want = brute.messages([tuple(x) for x in made.collect()], tool_calls.SCHEMAS)
    got = tool_calls.formatted(made, tool_calls.SCHEMAS).collect()
    assert _sorted(got) == _sorted(want) and sum(x.n_linked for x in got) == 12
    assert len({s for x in got for c in json.loads(x.message).get("tool_calls", ()) for s in [c["status"]]}) >= 4
