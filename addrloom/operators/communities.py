"""Louvain communities of a weighted graph, in rounds over DataFrames.

A round reckons, for every node, the gain in modularity of moving to each community that it has a link to, and takes each
node's best one. Few moves are taken as an independent set: those that are the best of all moves that touch the community they
leave or the one they reach, so their gains add up exactly. Of many moves, those from communities that give in this round to
communities that take (by a hash of name and round) are tried at once and kept if modularity rises; else the independent set is
taken. When no move gains, communities become the nodes of a smaller graph. At last the first graph's nodes may move once more,
from where they are, until nothing gains.

All weights are whole numbers, so sums are exact and the result is the same on every run. The driver gets counts and the round's
quality; no node's links meet in one task but as sums by community.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import drop, home, kept

FEW = 32


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _links(edges: DataFrame) -> DataFrame:
    """(a, b, w) in both directions, without loops."""
    one = edges.where("a <> b and w > 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("long"))
    one = one.groupBy("a", "b").agg(F.sum("w").alias("w"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _moves(links: DataFrame, state: DataFrame, total: int) -> DataFrame:
    """(node, k, c, d, gain): each node's best move from community c to d that gains; gain in units of modularity times total
    squared over two."""
    tot = state.groupBy("c").agg(F.sum("k").alias("tot"))
    near = links.join(state.select(F.col("node").alias("b"), F.col("c").alias("d")), "b").groupBy("a", "d").agg(F.sum("w").alias("w"))
    rows = near.withColumnRenamed("a", "node").join(state, "node")
    own = rows.where("d = c").select("node", F.col("w").alias("own"))
    rows = rows.where("d <> c").join(own, "node", "left").join(tot.withColumnRenamed("tot", "tot_c"), "c").join(
        tot.select(F.col("c").alias("d"), F.col("tot").alias("tot_d")), "d"
    )
    nearer = F.col("w") - F.coalesce("own", F.lit(0))
    gain = F.lit(total).cast("decimal(19,0)") * _exact(nearer) - _exact(F.col("k")) * _exact(F.expr("tot_d - tot_c + k"))
    best = rows.withColumn("gain", gain).where("gain > 0").groupBy("node", "k", "c").agg(
        F.max_by(F.struct("d", "gain"), F.struct("gain", "d")).alias("x")
    )
    return best.select("node", "k", "c", "x.d", "x.gain")


def _independent(moves: DataFrame) -> DataFrame:
    """The moves that are the best of all that touch either of their communities."""
    key = F.struct("gain", "node").alias("key")
    touched = moves.select(F.col("c").alias("at"), key).unionByName(moves.select(F.col("d").alias("at"), key))
    best = touched.groupBy("at").agg(F.max("key").alias("best"))
    rows = moves.withColumn("key", key)
    for side in "cd":
        top = best.select(F.col("at").alias(side), F.col("best").alias(f"best_{side}"))
        rows = rows.join(top, side).where(F.col("key") == F.col(f"best_{side}"))
    return rows.select("node", "d")


def _dealt(moves: DataFrame, turn: int) -> DataFrame:
    side = lambda c: F.pmod(F.xxhash64(F.lit(turn), F.col(c)), F.lit(2))
    return moves.where((side("c") == 0) & (side("d") == 1)).select("node", "d")


def _moved(state: DataFrame, taken: DataFrame) -> DataFrame:
    return state.join(taken, "node", "left").select("node", "k", F.coalesce("d", "c").alias("c"))


def _quality(links: DataFrame, state: DataFrame, total: int):
    """Modularity times total squared, less what lies within the nodes themselves."""
    at = lambda n, c: state.select(F.col("node").alias(n), F.col("c").alias(c))
    inner = links.join(at("a", "ca"), "a").join(at("b", "cb"), "b").where("ca = cb").agg(F.sum("w").alias("inner"))
    outer = state.groupBy("c").agg(F.sum("k").alias("tot")).agg(F.sum(_exact(F.col("tot")) * _exact(F.col("tot"))).alias("outer"))
    found = inner.crossJoin(outer).first()  # one row each
    return total * int(found.inner or 0) - int(found.outer or 0)


def _settled(links: DataFrame, state: DataFrame, total: int, keep, turn: int) -> tuple[DataFrame, int]:
    """state after all moves that gain, and the rounds so far."""
    quality = None
    while True:
        turn += 1
        moves = keep(_moves(links, state, total))
        if not (count := moves.count()):
            return state, turn
        taken = None
        if count > FEW:
            quality = _quality(links, state, total) if quality is None else quality
            tried = keep(_moved(state, _dealt(moves, turn)))
            reached = _quality(links, tried, total)
            if reached > quality:
                taken, quality = tried, reached
        if taken is None:
            taken, quality = keep(_moved(state, _independent(moves))), None
        state = taken


def louvain(edges: DataFrame) -> DataFrame:
    """(node, community) of undirected edges (a, b, w whole and positive; repeated ones add up, loops do not count): a community
    is named by its least node. Nodes without edges are absent."""
    spark, work = edges.sparkSession, f"{home(edges.sparkSession)}/{uuid.uuid4().hex}"
    keep = partial(kept, folder=work)
    base = keep(_links(edges))
    first = keep(base.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")))
    total = int(first.agg(F.sum("k")).first()[0] or 0)
    state, turn = first.withColumn("c", F.col("node")), 0
    while True:
        links, level = base, state
        # Up: settle, then communities become nodes, until a level moves nothing.
        before = turn
        level, turn = _settled(links, level, total, keep, turn)
        moved, whole = turn > before + 1, level.select("node", "c")
        while True:
            at = lambda n: level.select(F.col("node").alias(n), F.col("c").alias(f"c{n}"))  # noqa: E731, B023
            up = keep(links.join(at("a"), "a").join(at("b"), "b").where("ca <> cb").groupBy(
                F.col("ca").alias("a"), F.col("cb").alias("b")
            ).agg(F.sum("w").alias("w")))
            nodes = keep(level.groupBy(F.col("c").alias("node")).agg(F.sum("k").alias("k")))
            links, before = up, turn
            level, turn = _settled(links, nodes.withColumn("c", F.col("node")), total, keep, turn)
            if turn == before + 1:
                break
            moved = True
            whole = keep(whole.withColumnRenamed("c", "up").join(
                level.select(F.col("node").alias("up"), "c"), "up"
            ).select("node", "c"))
        state = keep(first.join(whole, "node"))
        if not moved:
            break
    least = state.groupBy("c").agg(F.min("node").alias("community"))
    result = kept(state.join(least, "c").select("node", "community"))
    drop(spark, work)
    return result


def modularity(edges: DataFrame, found: DataFrame) -> DataFrame:
    """One row: modularity of communities (node, community) of the edges."""
    links = _links(edges)
    degree = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).join(found, "node")
    outer = degree.groupBy("community").agg(F.sum("k").cast("double").alias("k")).agg(
        F.sum("k").alias("total"), F.sum(F.col("k") * F.col("k")).alias("squares")
    )
    at = lambda n: found.select(F.col("node").alias(n), F.col("community").alias(f"c{n}"))
    inner = links.join(at("a"), "a").join(at("b"), "b").where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("inner"))
    return outer.join(F.broadcast(inner)).select(
        (F.col("inner") / F.col("total") - F.col("squares") / F.col("total") / F.col("total")).alias("modularity")
    )
