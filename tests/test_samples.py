"""Samples of common values meet by value."""

import re

from addrloom.operators import profile


def test_samples_never_gather_a_column(spark):
    long = profile.values({
        "p": spark.range(300).selectExpr("id as a", "id % 7 as b"), "q": spark.range(100, 500).selectExpr("id as c")
    })
    edges = profile.pairs(long).select("file_a", "field_a", "file_b", "field_b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = profile.sample_values(long, edges, 3)
        plan = found._jdf.queryExecution().toString()
        assert {r.samples for r in found.collect()} == {"100|101|102"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(file_[ab]#\d+, field_[ab]#\d+(, value#\d+)?, \d+", plan)
