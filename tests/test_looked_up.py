"""What many rows share is computed once and looked up where the rows are."""

import numpy as np

from addrloom.operators import match, nearest
from addrloom.sources import shared


def test_few_keys_are_looked_up_where_the_rows_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, table = spark.range(100).selectExpr("id", "id % 2 as k"), spark.range(2).selectExpr("id as k", "id * 5 as v")
        few, many = shared.looked_up(rows, table, "k"), shared.looked_up(rows, table, "k", few=1)
        plans = [x._jdf.queryExecution().toString() for x in (few, many)]
        assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]
        assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 100
        texts = rows.selectExpr("concat('t', k) as poi")
        encoded = match.embedded(texts, "poi", lambda t: t.selectExpr("text", "array(1D) as v"))
        assert "BroadcastHashJoin" in encoded._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_vector_of_many_rows_is_normed_once(spark, monkeypatch):
    normed, unit = [], nearest._unit
    monkeypatch.setattr(nearest, "_unit", lambda df, *more: normed.append(df.count()) or unit(df, *more))
    left = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0])], "rid long, v array<double>")
    right = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(5, 25)], "rid long, v array<double>")
    got = {r.rid: (r.target_rid, r.similarity) for r in nearest.search(left, right).collect()}
    want = {i: (6, 1.0) if i % 3 == 0 else (5, 1.0) if i % 3 == 1 else (5, float(np.round(3 / np.sqrt(10), 6))) for i in range(60)}
    assert got == want | {60: (5, None), 61: (5, None)}
    assert sorted(normed) == [2, 4]
