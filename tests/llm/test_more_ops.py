import collections
import json
import random

import pytest

from addrloom.llm import exact_search, line_templates, piece_lattice, sharding, tool_calls, toxicity


def test_top_k_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-1, 1]) * r.random() if r.random() < 0.9 else 0.25 for _ in range(8)]) for i in range(400)]
    rows += [
        (500, None), (501, []), (502, [1.0, None] * 4), (550, [float("nan")] * 8), (600, [float("inf")] * 8),
        (None, [0.5] * 8), (650, [0.5] * 3), (651, [0.25] * 3), (700, rows[0][1]), (701, rows[0][1])
    ]
    df = spark.createDataFrame(
        [(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string"
    ).repartition(4)
    import numpy as np

    good = [
        (i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i,
        v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()
    ]
    want = []
    for i, q in good:
        if i % 50 == 0:
            found = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    for shard_rows, block_rows in ((1000, 1000), (60, 3), (7, 2)):
        got = sorted(
            tuple(x)
            for x in exact_search.top_k(df, 5, 50, shard_rows, block_rows).select(
                "query_id", "rank", "vec_id", "score"
            ).collect()
        )
        assert got == sorted(want)
    assert exact_search.top_k(df.limit(0)).collect() == []


def test_sharding(spark):
    shards = sharding.names(7)
    slots = sharding.lookup(shards, 503)
    counts = collections.Counter(slots)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup(shards[:-1], 503)
    assert sum(a != b for a, b in zip(slots, fewer) if a < 6) < 0.25 * 503
    df = spark.createDataFrame(
        [(i if i else None, "t", i) for i in range(300)] + [(5, "t", 0)], "doc_id long, text string, n int"
    )
    got = sharding.placed(df, shards=shards, size=503).collect()
    assert len(got) == 301 and all(r.shard == slots[r.slot] for r in got) and len(
        {r.shard for r in got if r.doc_id == 5}
    ) == 1
    assert sharding.placed(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        sharding.lookup([])


def test_lines(spark):
    r = random.Random(2)
    rows = []
    for i in range(40):
        own = [
            " ".join(
                f"o{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 25))}{'xyz'[j % 3]}{i}".replace(
                    str(i), chr(97 + i % 26) * (1 + i // 26)
                )
                for j in range(9)
            )
            for _ in range(3)
        ]
        own.insert(1, f"Posted by user{i} on 2021-01-{i % 28} here now")
        own.append("Released under the very same license as always")
        own.append(f"Written for the daily paper by {'abcdefgh'[i % 8] * 5} as we all know it now and then")
        rows.append((i, "\n".join(own)))
    rows += [
        (100, None), (101, ""), (102, "short line"), (103, "Posted by user9 on 2021-01-1 here now"),
        (103, "Posted by user9 on 2021-01-1 here now"),
        (None, "Released under the very same license as always\nrest of it")
    ]
    df = spark.createDataFrame(
        [(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_chars long, line string"
    ).repartition(3)
    got = line_templates.deduped_documents(df).collect()
    assert len(got) == len(rows) and line_templates.deduped_documents(df).columns == df.columns
    by = {x.doc_id: x for x in got}
    lines = [y for x in got for y in (x.text or "").split("\n")]
    assert sum(y.startswith("Posted by") for y in lines) == 1 and sum(y.startswith("Released") for y in lines) == 1
    assert sum(y.startswith("Written") for y in lines) == 1
    assert by[100].text is None and by[101].text == "" and by[102].text == "short line" and by[103].text == ""
    for i in range(1, 40):
        want = [y for y in rows[i][1].split("\n") if not y.startswith(("Posted", "Released", "Written"))]
        assert by[i].text.split("\n") == want and by[i].n_chars == len(by[i].text)
    assert line_templates.deduped_documents(df.limit(0)).collect() == []


def _line_clusters(spark, forms, **kw):
    """The sets of two lines or more that share a template."""
    df = spark.createDataFrame(
        [(1, i, n, f) for i, (f, n) in enumerate(forms)], "leaf long, line long, n long, form string"
    ).repartition(3)
    of = {x.line: x.template for x in line_templates.templates(df, 2, **kw).collect()}
    found = collections.defaultdict(set)
    for i in range(len(forms)):
        found[of.get(i, i)].add(i)
    return sorted(sorted(x) for x in found.values() if len(x) > 1)


def test_line_templates_of_a_shared_leaf(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    first = [
        (f"w w w kept at {word()} this is first", 1) for _ in range(40)
    ] + [("w w w kept at usual this is first", 30)]
    second = [(f"w w w sent out from by {word()} now", 1) for _ in range(40)]
    base = "w w w one two three four five six".split()
    third = [(" ".join(base[:k] + [word()] + base[k + 1 :]), 1) for k in range(3, 9)] + [(" ".join(base), 1)]
    prose = [("w w w " + " ".join(word() for _ in range(6)), 1) for _ in range(400)]
    forms = first + second + third + prose
    want = [list(range(41)), list(range(41, 81)), list(range(81, 88))]
    assert _line_clusters(spark, forms) == want
    assert _line_clusters(spark, first + prose, leaf_most=50) == want[:1]
    assert _line_clusters(spark, first, leaf_most=10) == want[:1]


def test_lines_of_two_documents(spark):
    rows = [
        (1, "All rights are reserved here\nonly in the first one"),
        (2, "all of it is new\nAll rights are reserved here"), (3, "twice in this text alone\ntwice in this text alone")
    ]
    got = line_templates.deduped_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in got} == {1: rows[0][1], 2: "all of it is new", 3: rows[2][1]}


def test_short_lines(spark):
    rows = [
        (1, "Read more\n\nLes.\n12 of 40\n你好世界\nown"), (2, " Read  more\n\nLes.\n12 of 40\n你好世界"),
        (3, "12 of 41\nPage 7\n\nLes."), (4, "Page 8")
    ]
    got = line_templates.deduped_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in got} == {1: rows[0][1], 2: "", 3: "12 of 41\nPage 7\n", 4: "Page 8"}


def test_lexicon():
    lexicon = toxicity.Lexicon(["scum", "trashy", "moron"], ["vequi"])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(1)
    for _ in range(4000):
        base = list(r.choice(["scum", "trashy", "moron", "vequi", "vequitas", "other"]))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(base))
            base[at : at + r.randint(0, 1)] = r.choice([[], [r.choice("scumtrahyonvqi")]])
        word = "".join(base)
        exact = min(
            (
                distance(t, word) for t in lexicon.words if distance(t, word) == 0 or len(t) >= toxicity.FUZZY_LEAST
                and distance(t, word) == 1
            ),
            default=9
        )
        stem = min((d for k in range(1, len(word) + 1) if (d := distance("vequi", word[:k])) <= 1), default=9)
        assert lexicon.match(word) == (exact, stem), word


def test_toxicity(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("bdfgkl") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(r.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randint(0, len(w)), r.choice(["stupidx", "wurstkopf", "xylonaut", "zerbalius" + word()]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "stupidx stupidx")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, marks)
    got = {x.doc_id: x.score for x in toxicity.scored(docs, scorer).collect()}
    import zlib

    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and sum((got[i] >= 0.3) == bool(y) for i, y in held) >= 0.97 * len(held)
    assert got[2000] == got[2001] < 0.3 <= got[None]
    none = toxicity.fit(docs, marks.limit(0))
    assert all(0 <= x.score <= 1 for x in toxicity.scored(docs, none).collect())
    assert toxicity.scored(docs.limit(0), scorer).collect() == []


def test_tool_calls(spark):
    schemas = {
        "add": {
            "type": "object", "required": ["a"],
            "properties": {"a": {"type": ["integer", "object"]}, "b": {"enum": [1, 2]}}, "additionalProperties": False
        }
    }
    call = lambda i, **a: {"id": i, "name": "add", "arguments": a}
    rows = [
        (1, 0, "user", "hä \"x\"\n\x01"),
        (
            1, 1, "assistant",
            json.dumps(
                {"tool_calls": [call("c", a={"$ref": "b"}), call("a", a=1), call("b", a={"$ref": "a"}, b=2), {"id": "n", "name": "none", "arguments": "{\"z\": 1}"}, call("a", a=5)]}
            )
        ),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"y": 1, "x": "é"}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "orphan"})),
        (
            2, 0, "assistant",
            json.dumps(
                {"content": "t", "tool_calls": [call("a", b=3), call("q", a={"$ref": "r"}), call("r", a={"$ref": "q"})]}
            )
        ),
        (2, 1, "assistant", "{not json"), (2, 2, None, None), (
            None, None, "assistant", json.dumps({"tool_calls": [call(None, a=1)]})
        ), (2, 1, "assistant", "{not json"),
    ]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn int, role string, text string, level int")
    calls = {(x.conv_id, x.id, x.at): x for x in tool_calls.linked(tool_calls.parsed(df, schemas)).collect()}
    assert {k: (x.status, x.level, x.result_turn) for k, x in calls.items()} == {
        (1, "c", 0): ("valid", 2, None), (1, "a", 1): ("valid", 0, 2), (1, "b", 2): ("valid", 1, None), (1, "n", 3): (
            "unknown tool", 0, None
        ), (1, "a", 4): ("duplicate", None, None),
        (2, "a", 0): (
            "$.a: missing", 0, None
        ), (2, "q", 1): (
            "valid", None, None
        ), (2, "r", 2): ("valid", None, None), (None, None, 0): ("valid", None, None),
    }
    got = tool_calls.formatted(df, schemas).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for x in got:
        by[x.conv_id, x.turn].append(x)
    first = json.loads(by[1, 1][0].message)
    assert [
        c["id"] for c in first["tool_calls"]
    ] == [
        "a", "n", "b", "c", "a"
    ] and first["tool_calls"][0]["result"] == '{"x":"é","y":1}' and by[1, 1][0].n_linked == 1
    assert by[1, 0][0].message == '{"content":"hä \\"x\\"\\n\\u0001","role":"user"}' and by[2, 2][0].message == '{"content":null,"role":null}' and len(by[2, 1]) == 2
    assert all(x.message == tool_calls.canonical(json.loads(x.message)) for x in got)
    plain = tool_calls.formatted(df.where("turn = 0 and conv_id = 1")).collect()
    assert plain[0].n_calls == 0
    assert tool_calls.formatted(df.limit(0)).collect() == []


def test_pieces(spark):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    pieces, sp = piece_lattice.Pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(6)
    texts = [
        "", "a", "  two  spaces ", "line\nbreak\t", "Ünïcode 한국 💩", "anderwhether thtionened, the ofantition"
    ] + [
        "".join(r.choice("the anding ofoution.,é\n  ") for _ in range(r.randint(1, 80))) for _ in range(150)
    ] + ["x" * 3000]
    df = spark.createDataFrame(
        [(i, t, 3) for i, t in enumerate(texts)] + [(None, None, 1)], "doc_id long, text string, ids int"
    ).repartition(3)
    for vocabulary in (20, 400):
        made = piece_lattice.encode(df, pieces, vocabulary)
        got = {x.doc_id: (list(memoryview(bytes(x.ids)).cast("I")), x.exact) for x in made.collect()}
        for i, t in enumerate(texts):
            assert got[i] == (sp.encode(t), True), t
        assert got[None] == ([], None)
    back = {x.doc_id: x.text for x in piece_lattice.decode(made, pieces).collect()}
    assert all(back[i] == t for i, t in enumerate(texts))
    assert piece_lattice.encode(df.limit(0), pieces).collect() == []
    toy = piece_lattice.Pieces(
        [("ab", 1, -1.0), ("b", 2, -0.6), ("a", 3, -0.6), ("bc", 4, -0.5), ("abc", 5, -3.0), ("▁", 6, -0.1)], [], 0,
        "unigram"
    )
    words = spark.createDataFrame([("▁abc",), ("▁abbcx",), ("zz",)], "unit string")
    ends = {x.unit: list(x.ends) for x in piece_lattice.lattice(words, toy).collect()}
    assert ends == {u: toy.cut(u) for u in ends} and ends["▁abc"] == [1, 2, 4]
