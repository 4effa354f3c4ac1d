from addrloom.llm.ngram_join import kept_documents


def test_one_row_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [
        (1, base), (2, base.replace("w7 ", "x7 ")), (2, base), (3, None), (3, None), (4, ""), (4, ""),
        (None, "only once"), (None, "only once"), (5, "a b c d e f"), (5, "a b c d e f"), (6, base.upper()),
        (7, "x " + base)
    ]
    docs = spark.createDataFrame(
        [(d, t, "clash", 0) for d, t in rows], "doc_id long, text string, row string, h int"
    ).repartition(4)
    got = sorted(kept_documents(docs, 5, 80).select("doc_id", "text").collect(), key=str)
    want = [(1, base), (3, None), (3, None), (4, ""), (4, ""), (None, "only once"), (5, "a b c d e f")]
    assert [tuple(x) for x in got] == sorted(want, key=str)
    assert kept_documents(docs, 5, 80).columns == ["doc_id", "text", "row", "h"]


def test_no_rows(spark):
    assert kept_documents(spark.createDataFrame([], "doc_id long, text string"), 5, 80).collect() == []
