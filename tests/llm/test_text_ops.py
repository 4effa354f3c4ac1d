import collections
import hashlib
import random
import re
import struct
import zlib

from pyspark.sql import functions as F

from addrloom.llm import packing, quality, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def texts(seed=1, n=60):
    r = random.Random(seed)
    shared = [[f"p{i}w{j}" for j in range(r.randint(30, 80))] for i in range(6)]
    out = [None, "", " \t\n", "word", "a " * 200, "É x\x1cy " * 5, "x" * 5000]
    for _ in range(n):
        w = [f"w{r.randint(0, 10**6)}" for _ in range(r.randint(0, 90))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            at = r.randint(0, len(w))
            a = r.randint(0, 5)
            w[at:at] = s[a : len(s) - r.randint(0, 5)]
        out.append(r.choice([" ", "\n", "\t "]).join(w))
    out.append(" ".join(f"v{r.randint(0, 30000)}" for _ in range(20000)))
    return out + out[10:14]


def brute_dedup(rows, least):
    words = [WORDS.findall(t or "") for t in rows]
    seen = collections.Counter(tuple(w[i : i + least]) for w in words for i in range(len(w) - least + 1))
    out = []
    for w in words:
        hit = set()
        for i in range(len(w) - least + 1):
            if seen[tuple(w[i : i + least])] > 1:
                hit.update(range(i, i + least))
        kept = " ".join(x for i, x in enumerate(w) if i not in hit)
        out.append((len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup(spark):
    rows = texts()
    df = spark.createDataFrame(
        [(None if i % 17 == 3 else i % 50, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, rk string"
    ).repartition(5)
    got = [
        (r.n_words, r.n_removed, r.s)
        for r in substring_dedup.dedup(df).withColumn("s", F.sha2("kept_text", 256)).collect()
    ]
    assert sorted(got) == sorted(brute_dedup(rows, 35))
    back = substring_dedup.deduped_documents(df)
    assert back.columns == df.columns and back.count() == len(rows)
    assert substring_dedup.dedup(df.limit(0)).collect() == []


def test_automaton(spark):
    r = random.Random(5)
    refs = [[r.choice("abc") for _ in range(r.randint(0, 40))] for _ in range(6)]
    sam = substring_dedup.SuffixAutomaton(refs)
    text = [r.choice("abcd") for _ in range(200)]
    has = {tuple(x[i:j]) for x in refs for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    for i, m in enumerate(sam.matching(text)):
        want = max((k for k in range(i + 2) if k == 0 or tuple(text[i - k + 1 : i + 1]) in has))
        assert m == want
    refs = spark.createDataFrame([("b c d e f",), (None,), ("x y z q",)], "text string")
    docs = spark.createDataFrame([(1, "a b c d e g"), (2, None), (3, "x y z x y z q")], "doc_id long, text string")
    got = {x.doc_id: x.kept_text for x in substring_dedup.strip_references(docs, refs, 3, shard_words=5).collect()}
    assert got == {1: "a g", 2: "", 3: ""}


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = texts(2) + ["don't <|endoftext|> İstanbul ΣΑΣ é 한국 $$$!!"] * 2
    df = spark.createDataFrame(
        [(i, t, 5) for i, t in enumerate(rows)], "doc_id long, text string, start int"
    ).repartition(3)
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(rows)}
    pieces = packing.pack(df, packing.tokenizer_path()).collect()
    got = collections.defaultdict(list)
    seqs = collections.defaultdict(list)
    for p in pieces:
        ids = list(struct.unpack(f"<{p.length}I", p.ids))
        assert want[p.doc_id][p.start : p.start + p.length] == ids and p.doc_tokens == len(want[p.doc_id])
        got[p.doc_id].append((p.start, p.length))
        seqs[p.sequence_id].append((p.offset, p.length))
    for i, ids in want.items():
        at = 0
        for start, n in sorted(got[i]):
            assert start == at and n > 0
            at += n
        assert at == len(ids)
    padded = 0
    for x in seqs.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded < 0.03 * sum(map(len, want.values()))
    d = {(r.doc_id, r.start): r.ids_crc32 for r in packing.digest(packing.pack(df, packing.tokenizer_path())).collect()}
    assert all(d[p.doc_id, p.start] == zlib.crc32(bytes(p.ids)) for p in pieces)


def brute_quality(t):
    w = WORDS.findall(t or "")
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(spark):
    rows = texts(3) + ["one two\none two\n\n one two\n###", "UP UP | UP " * 40, "z\x0bz\x0cz\n\x0b\nz\x0bz\x0cz"]
    df = spark.createDataFrame(
        [(i, t, 0) for i, t in enumerate(rows)], "doc_id long, text string, n_words int"
    ).repartition(3)
    got = {r.doc_id: r for r in quality.judged(quality.ledger(df), "strict-2").collect()}
    for i, t in enumerate(rows):
        r = got[i]
        m = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert m == brute_quality(t), t
        assert bool(r.rule_bits & quality.mask("base-1")) == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert r.kept == (r.rule_bits == 0)
    kept = quality.kept_documents(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    bits = [r.rule_bits for r in got.values()]
    for r in quality.ablations(quality.ledger(df), "strict-2").collect():
        b = quality.bit(r.rule)
        assert (r.n_failed, r.n_kept_without, r.n_kept) == (
            sum(x & b > 0 for x in bits), sum(x == b for x in bits), bits.count(0)
        )
    assert quality.ledger(df.limit(0)).collect() == []
