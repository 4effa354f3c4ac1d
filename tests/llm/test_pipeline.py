import collections
import random
import struct

import brute
import corpus_pipeline

from addrloom.llm.packing import tokenizer_path


def _texts():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = [prose(90).split() for _ in range(4)], prose(60)
    out = [None, "", "too short", "UP " * 200, "spam spam spam " * 40, prose(20_000)]
    for i in range(40):
        lines = [prose(30) for _ in range(3)]
        lines.insert(
            r.randint(0, 3),
            r.choice(["Read more", f"Posted by {word()} on 2021-01-{i} here", "All rights are reserved by us"])
        )
        if i % 4 == 0:
            lines.append(passage)
        out.append("\n".join(lines))
    for i in range(30):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out + out[8:12]


def test_stages_against_brute_force(spark, tmp_path):
    rows = list(enumerate(_texts()))
    rows += [rows[20], rows[20]]
    frame = spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), "extra", "e2") for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, row string, rk string"
    )
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    now, docs = rows, spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, folders = docs.columns, []
    for name, work in corpus_pipeline.STAGES[:-1]:
        work(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        folders.append(docs.schema["text"].metadata[corpus_pipeline.STAGED])
        if name == "quality_rules":
            now = [x for x in now if brute.passes(x[1], "strict-2")]
        elif name == "line_dedup":
            now = list(zip([i for i, _ in now], brute.without_lines(now, 2)))
        elif name == "ngram_jaccard_join":
            sets, root = brute.components([t for _, t in now], 5, 80)
            first = {}
            for i in sorted(range(len(now)), key=lambda i: now[i][0]):
                first.setdefault(root[i], i)
            now = [x for i, x in enumerate(now) if not sets[i] or first[root[i]] == i]
        else:
            hits = brute.covered([t for _, t in now], 35)
            now = [
                (i, " ".join(w for j, w in enumerate(brute.words(t)) if j not in hit) if hit else t) for (i, t),
                hit in zip(now, hits)
            ]
        assert docs.columns == columns
        got = docs.collect()
        assert sorted((x.doc_id, x.text) for x in got) == sorted(now), name
        assert all(x.row == "extra" and x.n_chars == len(x.text) for x in got)
    pieces = collections.defaultdict(list)
    for x in corpus_pipeline.packing(spark, docs, str(tmp_path)).collect():
        pieces[x.doc_id].append((x.start, bytes(x.ids)))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == {
        i: struct.pack(f"<{len(ids)}I", *ids) for i,
        text in now for ids in [t.encode(text, add_special_tokens=False).ids + [1]]
    }
    import os

    assert len(set(folders)) == 4 and not any(
        os.path.exists(f.removeprefix("file:").replace("//", "/", 1)) for f in folders
    )
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in whole.select("doc_id").collect()} == {i for i, _ in now}


def test_no_documents(spark, tmp_path):
    spark.createDataFrame(
        [], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_without_a_table_between(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(
        [(i, f"one line of words number {i}\nthe same line in all of them\n", "en", "s", 9) for i in range(6)],
        "doc_id long, text string, lang string, source string, n_chars long"
    )
    cut = corpus_pipeline.line_dedup(spark, docs, "")
    assert cut.schema["text"].metadata[corpus_pipeline.STAGED]

    def packed(rows):
        ids = collections.defaultdict(list)
        for x in corpus_pipeline.packing(spark, rows, "").collect():
            ids[x.doc_id].append((x.start, bytes(x.ids)))
        return {i: b"".join(part for _, part in sorted(parts)) for i, parts in ids.items()}

    lazily = packed(cut)
    cut.write.parquet(path := f"{tmp_path}/cut")
    assert len(lazily) == 6 and packed(spark.read.parquet(path)) == lazily
