"""Term divergence of sources, first places of groups, best-fit packing: against brute force on small fixtures."""

import collections
import math
import random
import re
import zlib

import duckdb
import pytest

from addrloom.llm import best_fit, divergence, group_ranks
from addrloom.llm.packing import tokenizer_path

# Source divergence ------------------------------------------------------------------------------------------------------
KIND = "doc_id long, text string, lang string, source string, value long"


def _docs(seed=3, n=160):
    r = random.Random(seed)
    words = ["alpha", "Beta", "über", "ÜBER", "naïve", "x", "中文", "delta_eps", "a1b", "it's"]
    rows = [
        (i, " ".join(r.choice(words[: 4 + i % 7]) for _ in range(r.randint(0, 12))), r.choice(["en", "de", None]),
         r.choice(["s1", "s2", "s3", "", None]), 1)
        for i in range(n)
    ]
    rows += [(None, None, "en", "s9", 1), (900, "", "fr", "s1", 1), (901, "only once", "fr", "s2", 1)]
    return rows + [rows[0]] * 5 + [(902, "alpha " * 30_000, "en", "s1", 1)]


def _brute_divergence(rows, least=30, top=50):
    group, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source, _ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        group[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in docs.items()}
    whole = collections.defaultdict(collections.Counter)
    for (lang, _), c in group.items():
        whole[lang].update(c)

    def shares(lang, c):
        terms = kept[lang]
        total = sum(c[t] for t in terms)
        return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(terms)) for t in terms}

    out = []
    for (lang, source), c in group.items():
        p, q = shares(lang, c), shares(lang, whole[lang])
        pairs = [
            (-sum(abs(p[t] - o[t]) for t in p), b) for (x, b), d in group.items() if x == lang and b != source
            for o in [shares(lang, d)]
        ]
        terms = [(q[t] - p[t], t) for t in p if c[t] > 0 and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (x[0], x[1].encode()))
            out += [(lang, source, part, item, -v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return sorted(out)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_divergence(spark, monkeypatch):
    rows = _docs()
    df = spark.createDataFrame(rows, KIND).repartition(4)
    want = _brute_divergence(rows)
    assert len({w[2] for w in want}) == 2
    assert _rows(divergence.audit(df)) == want
    monkeypatch.setattr(divergence, "HELD", 3)
    assert _rows(divergence.audit(df, 5_000)) == want


def test_divergence_without_terms(spark):
    df = spark.createDataFrame([(1, "a b", "en", "x", 1), (2, None, "en", "y", 1)], KIND)
    assert _rows(divergence.audit(df)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.audit(df.limit(0)).collect() == []


# First places of groups -------------------------------------------------------------------------------------------------
LINE = "who long, word string, high int, low long, n long, place string"


def _brute_places(rows, most):
    groups = collections.defaultdict(list)
    for who, word, high, low, n, _ in rows:
        groups[who, word].append((high, low, n))
    last = lambda x: (x is None, x or 0)
    order = lambda x: (x[0] is not None, -(x[0] or 0), x[1] is not None, x[1] or 0, last(x[2]))
    out = []
    for key, lines in groups.items():
        tied = collections.Counter(x[:2] for x in lines)
        out += [(*key, *x, i + 1, i + 1, tied[x[:2]]) for i, x in enumerate(sorted(lines, key=order)[:most])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("wide", [False, True])
def test_places(spark, wide, monkeypatch):
    r = random.Random(8)
    far = 2**60 if wide else 7
    rows = [
        (r.choice([None, 1, 2, 3]), r.choice(["a", "b\"", "", None]), r.choice([None, -5, 0, 1, 2, 3, 2**31 - 1]),
         r.choice([None, 0, 1, 2, far, -far]), r.choice([None, 1, 2, 3]), "x")
        for _ in range(500)
    ]
    rows += [(9, "hot", 5, 1, i % 40, "x") for i in range(400)] + [(9, "hot", 5, 1, 7, "x")] * 200 + [(8, "one", None, None, None, None)]
    df = spark.createDataFrame(rows, LINE).repartition(4)
    assert group_ranks.Pair(df, "high", "low").kind == ("decimal(38,0)" if wide else "long")
    for most, hot in ((2, 1000), (1, 10**9), (5, 1), (60, 3)):
        monkeypatch.setattr(group_ranks, "HOT", hot)
        got = group_ranks.leading(df, ["who", "word"], "high", "low", ["n"], most)
        assert sorted((tuple(x) for x in got.collect()), key=repr) == _brute_places(rows, most)
    clash = group_ranks.leading(df.withColumnRenamed("word", "pos"), ["who", "pos"], "high", "low", ["n"])
    assert clash.columns == ["who", "pos", "high", "low", "n", "_pos", "place", "tied"]
    assert group_ranks.leading(df.limit(0), ["who"], "high", "low", ["n"]).collect() == []


@pytest.mark.parametrize("far", [3, 2**62])
def test_places_of_groups_in_numbers(spark, far):
    r = random.Random(3)
    rows = [
        (r.choice([None, -7, 0, 2]), r.choice([None, far, -far, 1]), r.choice([None, 0, 4]), r.choice([None, 0, 1, 2]), r.randint(1, 9), "x")
        for _ in range(300)
    ]
    df = spark.createDataFrame(rows, LINE.replace("word string", "word long")).repartition(3)
    group = group_ranks.Group(df, ["who", "word"], group_ranks.bounds(df, ["who", "word"]))
    assert df.select(group.encoded().alias("g")).dtypes == [("g", "bigint" if far == 3 else "string")]
    got = group_ranks.leading(df, ["who", "word"], "high", "low", ["n"])
    assert got.dtypes[:2] == df.dtypes[:2] and sorted((tuple(x) for x in got.collect()), key=repr) == _brute_places(rows, 2)


def test_checksum_in_sql():
    con = duckdb.connect()
    for text in ("0", "7", "1234567", "-3"):
        assert con.execute(f"SELECT {group_ranks._crc32(chr(39) + text + chr(39))}").fetchall()[0][0] == zlib.crc32(text.encode())


# Best-fit packing -------------------------------------------------------------------------------------------------------
def test_best_fit(spark, monkeypatch):
    from tokenizers import Tokenizer

    r = random.Random(2)
    texts = [" ".join(r.choice(["a", "word", "Fußball", "zzyzx", "1,5"]) for _ in range(r.randint(0, 90))) for _ in range(300)]
    texts += [None, "", " ", "long " * 9000]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(3)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 128)):
            cut = ids[at : at + 128]
            want[i, piece, at, b"".join(x.to_bytes(4, "little") for x in cut), len(ids)] += 1
    tokens = sum(len(k[3]) // 4 * n for k, n in want.items())
    monkeypatch.setattr(best_fit, "BUFFER", 16)
    for node in (4096, 8):
        got = best_fit.pack(df, tokenizer_path(), 128, 0, node).collect()
        assert collections.Counter((p.doc_id, p.piece, p.start, bytes(p.ids), p.doc_tokens) for p in got) == want
        by = collections.defaultdict(list)
        for p in got:
            by[p.sequence_id].append((p.offset, p.length))
        for pieces in by.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 128
        assert len(by) <= 1.05 * math.ceil(tokens / 128) + 1
    assert best_fit.pack(df.limit(0), tokenizer_path()).collect() == []


def test_underfull_sequences_meet_across_partitions(spark):
    docs = spark.createDataFrame([(i, "a " * (90 if i < 10 else 30)) for i in range(20)], "doc_id long, text string")
    got = best_fit.pack(docs.repartitionByRange(20, "doc_id"), tokenizer_path(), 128).collect()
    assert len(got) == 20 and len({p.sequence_id for p in got}) == 10
