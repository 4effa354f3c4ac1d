"""All units go through the lattice, relational or by arrays, and all are counted."""

import collections
import random

from addrloom.llm import piece_lattice


def test_units_met_once_are_counted(spark):
    many = " ".join(f"u{i}" for i in range(12_000))
    df = spark.createDataFrame([(1, many), (2, "u7 often often"), (3, None)], "doc_id long, text string").coalesce(1)
    got = {x.unit: x.n for x in piece_lattice.frequent(df, 20_000).collect()}
    assert len(got) == 12_001 and got["▁u7"] == 2 and got["▁often"] == 2 and got["▁u11999"] == 1
    rows = [" ".join(f"w{i}" for i in range(200) if j % (i + 1) == 0) for j in range(300)]
    want = collections.Counter(u for text in rows for u in piece_lattice.units(text))
    df = spark.createDataFrame([(i, text) for i, text in enumerate(rows)], "doc_id long, text string").repartition(3)
    for most in (1, 7, 60, 500):
        got = [(x.unit, x.n) for x in piece_lattice.frequent(df, most).collect()]
        assert got == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:most]


def test_arrays_fold_as_single_units_do():
    r = random.Random(3)
    rows = [("ab", 1, -1.0), ("bc", 2, -1.0), ("abc", 3, -2.0), ("ca", 4, -1.0), ("cab", 5, -0.5), ("a", 6, -9.0), ("b", 7, -9.0)]
    rows += [("bcabb", 8, -0.1), ("éa", 9, -3.0), ("💩", 10, -9.0), ("💩é", 11, -0.2), ("aa", 12, -4.0), ("aaaa", 13, -5.0)]
    units = ["", "a", "bcabb", "é", "x" * 5000, "a" * 5001, "ab" * 70_000]
    units += ["".join(r.choice("aabbccé💩x") for _ in range(r.randint(1, 130))) for _ in range(1500)]
    for byte_ids in (list(range(100, 356)), []):
        pieces = piece_lattice.Pieces(rows, byte_ids, 0)
        got = piece_lattice.Lattice(pieces).encode(units)
        for unit, ids in zip(units, got):
            if len(unit) < 1000:
                assert memoryview(ids).cast("I").tolist() == pieces.encode(unit), unit
        a, b, x = 6, 7, pieces.letters("x")
        assert memoryview(got[4]).cast("I").tolist() == x * 5000 and memoryview(got[6]).cast("I").tolist()[:2] in ([1, 1], [a, b])
        assert memoryview(got[5]).cast("I").tolist() == [13] * 1250 + [a]
    toy = piece_lattice.Pieces(rows, [], 0, "unigram")
    known = piece_lattice.UnitIds(toy, {})
    known.learn({"abcab", "ca"})
    assert memoryview(known.ids(["ca", "abcab"])).cast("I").tolist() == toy.encode("ca") + toy.encode("abcab")
