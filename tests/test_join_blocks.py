"""Keys of many pairs are met in blocks."""

from collections import Counter

from addrloom.operators import join


def test_join_meets_large_keys_in_blocks(spark):
    a = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3) for i in range(90)] + [(90, 7), (91, 8)], "x long, k int")
    b = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3) for i in range(30)] + [(i, 7) for i in range(60)], "y long, k int")
    got = join.inner(a, b, "k", "k", most=50)
    want = Counter((x, k, y) for x, k in a.collect() for y, l in b.collect() if k == l)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert got.columns == ["[A]x", "【关联A】k", "[B]y"] and got.rdd.getNumPartitions() > 4
    other = join.inner(a, b.withColumnRenamed("k", "l"), "k", "l", most=50)
    assert other.columns == ["[A]x", "【关联A】k", "[B]y", "【关联B】l"] and other.count() == sum(want.values())


def test_join_copies_rows_in_proportion_to_them(spark):
    a = spark.createDataFrame([(i, None) for i in range(600)], "x long, k int")
    b = spark.createDataFrame([(i, None) for i in range(60)] + [(60, 1)], "y long, k int")
    got = join.inner(a, b, "k", "k", most=10)  # blocks of ten pairs would be 3,600, with 60 rows copied to each
    assert got.rdd.getNumPartitions() < 250
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 36_000 and set(rows) == {(x, None, y) for x in range(600) for y in range(60)}
    other = join.inner(b, a, "k", "k", most=10)
    assert other.rdd.getNumPartitions() < 250 and {tuple(r) for r in other.collect()} == {(y, k, x) for x, k, y in rows}
