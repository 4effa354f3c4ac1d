"""Which file was made of which: an append-only table of edges, and what follows from it.

An edge says that a step has made a child of a parent. ``closure`` follows edges in rounds from what the last round has found,
each pair once, so diamonds and cycles cost no more than the pairs they join; every round is written before the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import drop, home, kept

EDGES = "parent string, child string, step string, at timestamp"


def record(edges: DataFrame, folder: str) -> None:
    """Adds edges (parent, child, step) with the time; what is there is never written again."""
    edges.select("parent", "child", "step", F.current_timestamp().alias("at")).write.mode("append").parquet(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """All edges, once each: the first time they were recorded counts."""
    return spark.read.schema(EDGES).parquet(folder).groupBy("parent", "child", "step").agg(F.min("at").alias("at"))


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth): every file that another one comes from, by the fewest steps. A file in a cycle comes from
    itself too. Edges with a null end, and loops, say nothing."""
    spark, work = edges.sparkSession, f"{home(edges.sparkSession)}/{uuid.uuid4().hex}"
    one = kept(edges.where("parent <> child").select("parent", "child").distinct(), work)
    found = kept(one.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth")), work)
    parts, latest, depth = [found], found, 1
    while latest.limit(1).count():
        depth += 1
        seen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        on = latest.join(one, F.col("descendant") == F.col("parent")).select("ancestor", F.col("child").alias("descendant")).distinct()
        latest = kept(on.join(seen, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth)), work)
        parts = [seen if depth % 8 else kept(seen, work), latest]
    result = kept(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    drop(spark, work)
    return result


def originals(pairs: DataFrame) -> DataFrame:
    """(descendant, ancestor, depth): of each file those it comes from that come from none themselves."""
    made = pairs.select(F.col("descendant").alias("ancestor")).distinct()
    return pairs.join(made, "ancestor", "left_anti").select("descendant", "ancestor", "depth")
