"""Clashing names, repeated rows and hot groups."""

import random
import time
from collections import Counter

import brute
import pytest

from addrloom.llm import exact_search, line_templates, ngram_join, packing, quality, sharding, substring_dedup, toxicity

CLASH = "n_dropped n_words kept_text spans N_LINES _text _rk rk row k d _slot _shard slot shard at owner hash sid h key gone firsts sizes n_removed rule_bits kept _row".split()


def _docs(spark, rows):
    names = ["doc_id long", "text string", "n_chars long", *(f"`{c}` string" for c in CLASH), "`odd `` name.x` int"]
    return spark.createDataFrame(
        [(d, t, len(t or ""), *("mine" for _ in CLASH), 5) for d, t in rows], ", ".join(names)
    ).repartition(3)


def _texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    shared = " ".join(word() for _ in range(60))
    rows = [
        (
            i,
            "\n".join(
                [" ".join(word() for _ in range(70)), "The same line in all of them", shared if i % 3 == 0 else word()]
            )
        )
        for i in range(12)
    ]
    return rows + rows[:2] + [
        (50, None), (51, ""), (None, "The same line in all of them"), (52, " ".join(word() for _ in range(30_000)))
    ]


def test_names_that_clash(spark):
    rows = _texts()
    docs = _docs(spark, rows)
    for kept in (
        line_templates.deduped_documents, substring_dedup.deduped_documents, quality.kept_documents,
        ngram_join.kept_documents
    ):
        made = kept(docs)
        assert made.columns == docs.columns
        got = made.collect()
        assert got and all(x[c] == "mine" for x in got for c in CLASH) and all(x[-1] == 5 for x in got)
    placed = sharding.placed(docs)
    assert placed.columns == [*docs.columns, "__slot", "__shard"] and all(
        x["slot"] == "mine" and 0 <= x["__shard"] < 64 for x in placed.collect()
    )
    assert sharding.placed(docs.limit(0)).collect() == []
    lines = line_templates.dedup_lines(docs)
    assert lines.columns[-3:] == ["_kept_text", "_n_lines", "_n_dropped"] and sum(
        x["_n_dropped"] for x in lines.collect()
    ) > 10
    cut = substring_dedup.dedup(docs)
    assert cut.columns[-4:] == ["_kept_text", "_n_words", "_n_removed", "_spans"]
    assert sorted(x["_n_removed"] for x in cut.collect()) == sorted(
        x[1] for x in brute.removed([t for _, t in rows], 35)
    )
    assert packing.pack(docs, packing.tokenizer_path()).count() > 0 and quality.ledger(docs).count() == len(rows)
    assert ngram_join.jaccard_components(docs).count() == len(rows)


def test_equal_rows_cost_little(spark):
    text = " ".join(f"w{i}" for i in range(80))
    began = time.time()
    docs = spark.range(100_000).selectExpr("1L as doc_id", f"'{text}' as text")
    got = substring_dedup.dedup(docs).groupBy("n_words", "n_removed").count().collect()
    assert [tuple(x) for x in got] == [(80, 80, 100_000)] and time.time() - began < 120


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_hot_groups_with_outliers(spark, monkeypatch, k, percent):
    """Drifting copies of one text (neighbours link, ends do not), in blocks of a few sets, beside texts that share much of it."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 900)
    r = random.Random(percent)
    base, rows = [f"b{i}" for i in range(150)], []
    now = list(base)
    for i in range(60):  # a chain
        for _ in range(2):
            now[r.randrange(len(now))] = f"n{i}x{r.randint(0, 99)}"
        rows.append((len(rows), " ".join(now)))
    for i in range(60):  # around the threshold from the base
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"m{r.randint(0, 9999)}"
        rows.append((len(rows), " ".join(w)))
    for i in range(30):  # half of it
        rows.append((len(rows), " ".join(base[:75] + [f"o{i}y{j}" for j in range(75)])))
    for i in range(40):  # around the boundary between light and heavy
        w = [f"s{j}" for j in range(r.randint(8, 34))]
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"t{r.randint(0, 3)}"
        rows.append((len(rows), " ".join(w)))
    sets, root = brute.components([t for _, t in rows], k, percent)
    low = {}
    for i, x in enumerate(root):
        low[x] = min(low.get(x, i), i)
    want = [(i, len(sets[i]), low[root[i]]) for i in range(len(rows))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, ngram_join.jaccard_components(docs, k, percent).collect())) == want


def test_chain_of_parts_that_does_not_link(spark):
    """Each text shares a third with the next one: parts chain them, no pair links."""
    rows = [(i, " ".join(f"u{i * 40 + j}" for j in range(120))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(x.component_id == x.doc_id for x in ngram_join.jaccard_components(docs, 3, 90).collect())


def test_boundary_follows_the_data(spark):
    kind = "sid long, n_shingles long, prefix array<long>"
    short = spark.createDataFrame([(i, 25, [1, 2, 3]) for i in range(400)], kind)  # lists of 400 entries
    rare = spark.createDataFrame([(i, 25, [3 * i, 3 * i + 1, 3 * i + 2]) for i in range(400)], kind)
    assert ngram_join.boundary(short, 90) >= 25 and ngram_join.boundary(rare, 90) == 0
    assert ngram_join.boundary(rare.limit(0), 90) == 0


def test_search_of_equal_and_huge_vectors(spark):
    r = random.Random(9)
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(200)] + [
        (200 + i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 3, 6]) for _ in range(3)]) for i in range(150)
    ]
    rows += [
        (1000, [1e300, 0.0, 0.0]), (1050, [-1e300, 1.0, 1.0]), (1100, [3e6, 3e6, 3e6]), (1150, [2.0**22, 1.0, 1.0]),
        (1200, [1e9, 0.0, 0.0]), (1250, [0.0, 1e9, 2.0**60]), (1300, [1e9, 1.0, 0.0]), (1350, [-1e9, 0.5, 0.0])
    ]
    df = spark.createDataFrame(
        [(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, id int"
    ).repartition(3)
    import math

    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    assert sum(sum(x * x for x in v) >= 2**62 for _, v in good) == 6
    want = []
    for i, q in good:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:5]
            want += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(found)]
    for sizes in ((1000, 1000), (20, 3)):
        assert sorted(
            map(tuple, exact_search.top_k(df, 5, 50, *sizes).select("query_id", "rank", "vec_id", "score").collect())
        ) == sorted(want)


def test_lines_against_brute_force(spark):
    r = random.Random(8)
    word = lambda: r.choice("red blue green gold pink".split())
    kinds = [
        lambda: f"Posted by {word()} on 2021-{r.randint(1, 12)} here",
        lambda: f"It was {word()} {word()} {word()} and the rest of it",
        lambda: " ".join(word() for _ in range(r.randint(1, 9))), lambda: "", lambda: f"Page {r.randint(1, 4)}",
        lambda: f"own {r.randint(0, 10**6)} words here only {r.randint(0, 10**6)}"
    ]
    rows = [
        (None if i == 5 else i, "\n".join(r.choice(kinds)() for _ in range(r.randint(0, 9)))) for i in range(50)
    ] + [(90, None)]
    for documents in (2, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = line_templates.dedup_lines(docs, documents).collect()
        assert Counter((x.doc_id, x.kept_text) for x in got) == Counter(
            zip([d for d, _ in rows], brute.without_lines(rows, documents))
        )


def test_copies_keep_their_lines(spark):
    """Lines that only copies of one text share stay; one that other texts have too goes, from all copies."""
    r = random.Random(2)
    prose = lambda n: "\n".join(" ".join(f"w{r.randint(0, 10**6)}" for _ in range(12)) for _ in range(n))
    body, note = prose(5), "All rights are reserved by somebody"
    rows = [(i, body) for i in range(8)] + [(30 + i, prose(3) + "\n" + note) for i in range(3)] + [
        (50 + i, own) for own in [prose(3) + "\n" + note] for i in range(4)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((x.doc_id, x.text) for x in line_templates.deduped_documents(docs).collect())
    assert got == Counter((i, t if i <= 30 else t.removesuffix("\n" + note)) for i, t in rows)


def test_near_copies_can_stay_whole(spark):
    r = random.Random(5)
    line = lambda: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(12))
    lines, note = [line() for _ in range(10)], "All rights are reserved by somebody"
    rows = [
        (i, "\n".join([*lines[:i], line(), *lines[i + 1 :]])) for i in range(4)
    ] + [(9 + i, "\n".join([line(), line(), note])) for i in range(3)] + [(20, None), (21, ""), (22, note)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.text for x in line_templates.deduped_documents(docs, most=0.7).collect()}
    assert [got[i] for i, _ in rows] == brute.without_lines(rows, 2, 0.7)
    assert all(got[i] == t for i, t in rows[:4]) and got[10] == rows[5][1].removesuffix("\n" + note) and got[22] == note
    assert line_templates.deduped_documents(docs).where("doc_id = 1").first().text != rows[1][1]


def test_context_of_a_hit():
    def of(text):
        words = toxicity.tokens(text)
        return toxicity.context(words, next(i for i, w in enumerate(words) if w.startswith("stup")))

    assert of('He wrote "a stup1d thing" there') == (True, False)
    assert of('a stray " mark\nand then stupid " words') == (False, False)
    assert of("« du stupid »") == (True, True) and of("“ closed ” stupid “ again ”") == (False, False)
    assert of("you are st*pid".replace("st*pid", "stup*d")) == (False, True)
    assert of("far " * 50 + "you " + "x " * 7 + "stupid") == (False, False) and of("sagte stupid") == (True, False)
    assert toxicity.tokens("st*pid a$$hole it's x@ 12") == ["st*pid", "asshole", "it's", "x", "12"]


def test_features_against_counts():
    lexicon = toxicity.Lexicon(["scummy", "moron"], [])
    scorer = toxicity.Scorer(lexicon)
    text = 'you scummy lot "a mor0n here" and the scumy m*ron said a moronn ' * 3 + "clean"
    words = toxicity.tokens(text)
    exact = [i for i, w in enumerate(words) if w in lexicon.words]
    near = [i for i, w in enumerate(words) if w in ("scumy", "m*ron", "moronn")]
    import numpy as np

    both = lambda at, j: sum(toxicity.context(words, i)[j] for i in at)
    want = [
        *(
            np.log1p(n)
            for n in (len(exact), 0, len(near), 0, both(exact, 0), both(exact, 1), both(near, 0), both(near, 1))
        ),
        min(1.0, 20 * len(exact) / (len(words) + 20)), 1.0
    ]
    assert len(exact) == 6 and len(near) == 9 and np.allclose(scorer.features(text), want)
    assert scorer.features(None).tolist() == [0.0] * len(toxicity.FEATURES)


def test_labels_of_both_kinds(spark):
    rows = [(i, f"the word {i} is vile" if i % 2 else f"calm text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(
        [(i, i % 2) for i in range(200)] + [(i, 0) for i in range(1, 200, 2)], "doc_id long, toxic int"
    )
    one, two = (toxicity.fit(docs.repartition(n), marks.repartition(5 - n)) for n in (2, 3))
    assert one.lexicon.words == two.lexicon.words and "vile" in one.lexicon.words
    assert (one.weights == two.weights).all() and one.score("so vile") > 0.5 > one.score("calm")


def test_tokenizer_of_another_shape(tmp_path):
    import json

    path = packing.tokenizer_path()
    assert packing.splits_words(path)
    whole = json.load(open(path, encoding="utf-8"))
    whole["normalizer"]["normalizers"].pop()
    (tmp_path / "t.json").write_text(json.dumps(whole), encoding="utf-8")
    ids = packing.WordIds(str(tmp_path / "t.json"))
    texts = ["Hello World  again", None, ""]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(tmp_path / "t.json"))
    assert not ids.by_word and [
        list(memoryview(x).cast("I")) if x else [] for x in ids.ids(texts)
    ] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
