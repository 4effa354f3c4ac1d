"""Exact nearest embeddings through an index of cells.

The right side's different vectors are dealt to cells around centres of spherical k-means. A cell's bound for a query is
cos(max(0, angle to the centre - radius)), radius being the largest angle of a member: nothing in the cell can be nearer. Every
query visits the cell of its best bound, then in each round twice as many of the next best ones, and stops when no cell that is
left can beat, or tie with, what it has. The centres are fitted to a bounded sample; they decide the cost, never the result.

Equal vectors are searched once. A visit meets blocks of a bounded number of queries and of members, however many queries want
one cell and however large that is. Broadcast are the centres alone, of which there are at most ``CELLS``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import drop, home, kept, looked_up

#: Vectors that centres are fitted to, most centres of a width, and their rounds of fitting.
SAMPLE, CELLS, FITS = 20_000, 1024, 8
#: Similarities count at six places, so a cell may be passed over when its bound is lower by more than that rounding.
MARGIN = 1.5e-6


def _hashed(df: DataFrame) -> DataFrame:
    """rid, v, h0 and h1: two hashes that name the vector as it is given."""
    return df.select("rid", "v", F.xxhash64("v").alias("h0"), F.xxhash64(F.lit("again"), "v").alias("h1"))


def _unit(df: DataFrame, *more: str) -> DataFrame:
    """v (of unit length), k0 and k1 (two hashes that name the vector), and more; rows with a null in the vector are left out."""
    v = F.transform("v", lambda x: x.cast("double"))
    rows = df.select(*more, v.alias("v")).where(F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null)"))
    rows = rows.withColumn("n", F.expr("sqrt(aggregate(v, 0D, (s, y) -> s + y * y))")).where("n > 0")
    return rows.select(
        *more, F.expr("transform(v, x -> x / n)").alias("v"), F.xxhash64("v").alias("k0"),
        F.xxhash64(F.lit("again"), "v").alias("k1")
    )


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if len(column) else 0)


def centres(sample: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means; a centre that loses its last vector stays where it is."""
    r = np.random.default_rng(seed)
    found = sample[r.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(FITS):
        near = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1)
        found[length > 0] = sums[length > 0] / length[length > 0, None]
    return found


class Cells:
    """Centres of one width with the radii of their cells; one more cell is for vectors that are not finite."""

    def __init__(self, centres: np.ndarray, radius: np.ndarray, size: np.ndarray):
        self.centres, self.radius, self.size = centres, radius, size

    @staticmethod
    def angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(np.nan_to_num(vectors @ centres.T, nan=1.0, posinf=1.0, neginf=-1.0), -1, 1))

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """The highest similarity that each cell can have with each vector; 2 where nothing is known of it."""
        whole = np.isfinite(vectors).all(axis=1)
        out = np.full((len(vectors), len(self.size)), 2.0)
        out[np.ix_(whole, np.arange(len(self.centres)))] = np.cos(
            np.maximum(0, self.angles(vectors[whole], self.centres) - self.radius[:-1])
        )
        out[:, self.size == 0] = -2.0  # nothing to visit
        return out


def _sampled(right: DataFrame, width: int, rows: int) -> np.ndarray:
    """At most SAMPLE vectors of one width, those of the least hashes among about so many."""
    share = min(1.0, 2 * SAMPLE / rows)
    some = right.where((F.size("v") == width) & (F.pmod("k1", F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)))
    finite = F.expr("forall(v, x -> not isnan(x) and abs(x) <= 1D)")
    return _matrix(some.where(finite).orderBy("k0", "k1").limit(SAMPLE).select("v").toArrow().column("v"))


def _dealt(right: DataFrame, all_centres: dict[int, np.ndarray]) -> DataFrame:
    """right with its cell and the angle to that cell's centre."""
    def run(batches):
        for batch in batches:
            cell, angle = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            widths = pc.list_value_length(batch.column("v")).to_numpy()
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                vectors = _matrix(batch.column("v").take(pa.array(at)))
                held, whole = all_centres[int(width)], np.isfinite(vectors).all(axis=1)
                cell[at] = len(held)
                if len(held):
                    away = Cells.angles(vectors[whole], held)
                    cell[at[whole]] = away.argmin(axis=1)
                    angle[at[whole]] = away.min(axis=1)
            yield batch.append_column("cell", pa.array(cell)).append_column("angle", pa.array(angle))

    return right.mapInArrow(run, right.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("angle")).schema)


def _asked(left: DataFrame, cells: dict[int, Cells], first: int, many: int) -> DataFrame:
    """k0, k1, v, cell: the cells of ranks first to first + many that can still beat what a query has, by their bounds."""
    def run(batches):
        for batch in batches:
            widths = pc.list_value_length(batch.column("v")).to_numpy()
            has = batch.column("similarity").to_numpy(zero_copy_only=False)
            rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for width in np.unique(widths):
                if int(width) not in cells:
                    continue
                at = np.flatnonzero(widths == width)
                bounds = cells[int(width)].bounds(_matrix(batch.column("v").take(pa.array(at))))
                order = np.argsort(-bounds, axis=1, kind="stable")[:, first : first + many]
                held = np.take_along_axis(bounds, order, axis=1)
                best = has[at][:, None]
                row, col = np.nonzero((held > -2) & ~(held + MARGIN < best))
                rows.append(at[row])
                found.append(order[row, col])
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("k0", "k1", "v")] + [pa.array(np.concatenate(found).astype(np.int32))],
                ["k0", "k1", "v", "cell"]
            )

    return left.mapInArrow(run, "k0 long, k1 long, v array<double>, cell int")


def best_of_block() -> Callable:
    """The best member (side 1) for each query (side 0) of a block, by the similarity at six places, the first on ties."""
    def run(key, group):
        left, right = (group.filter(pc.equal(group.column("side"), i)) for i in (0, 1))
        right = right.take(pc.sort_indices(right, [("rid", "ascending")]))
        rows, at, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(left) and len(right):
            a, b = _matrix(left.column("v")), _matrix(right.column("v"))
            for i in range(0, len(a), 256):
                s = a[i : i + 256] @ b.T
                most = s.max(axis=1)
                row, col = np.nonzero((s >= (most - 2e-6)[:, None]) | np.isnan(s))
                rounded, top = np.round(s[row, col], 6), np.round(most, 6)[row]
                same = (rounded == top) | (np.isnan(rounded) & np.isnan(top))
                row, first = np.unique(row[same], return_index=True)
                rows.append(row + i)
                at.append(col[same][first])
                value.append(rounded[same][first])
        take = pa.array(np.concatenate(rows))
        return pa.table({
            "k0": left.column("k0").take(take), "k1": left.column("k1").take(take),
            "target_rid": right.column("rid").take(pa.array(np.concatenate(at))),
            "similarity": pa.array(np.concatenate(value), pa.float64(), from_pandas=False)
        })

    return run


def _visited(asked: DataFrame, right: DataFrame, sizes: dict[tuple[int, int], int], left_rows: int, right_rows: int) -> DataFrame:
    """(k0, k1, target_rid, similarity, cells) of the queries that visit cells now; cells counts what each has visited.

    A cell of many members or with many queries is met in blocks: members lie in one of its shards and are copied to every
    block of queries, queries lie in one block and go to every shard."""
    spark, kind = right.sparkSession, right.schema["rid"].dataType.simpleString()
    wanted = asked.groupBy(F.size("v").alias("width"), "cell").agg(F.count("*").alias("n")).collect()  # at most CELLS a width
    if not wanted:
        return None
    plan = spark.createDataFrame(
        [(r.width, r.cell, -(-r.n // left_rows), -(-sizes[r.width, r.cell] // right_rows)) for r in wanted],
        "width int, cell int, blocks long, shards long"
    )
    place = lambda n: F.pmod(F.xxhash64("k0", "k1"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = lambda df: df.withColumn("width", F.size("v")).join(F.broadcast(plan), ["width", "cell"])
    columns = ["width", "cell", "block", "shard", "side", "k0", "k1", "rid", "v"]
    a = met(asked).withColumn("block", place("blocks")).withColumn("shard", every("shards")).withColumns(
        {"side": F.lit(0), "rid": F.lit(None).cast(kind)}
    )
    b = met(right).withColumn("shard", place("shards")).withColumn("block", every("blocks")).withColumn("side", F.lit(1))
    found = a.select(*columns).unionByName(b.select(*columns)).groupBy("width", "cell", "block", "shard").applyInArrow(
        best_of_block(), f"k0 long, k1 long, target_rid {kind}, similarity double"
    )
    counts = asked.groupBy("k0", "k1").agg(F.count("*").alias("cells"))
    return _best(found).join(counts, ["k0", "k1"])


def _best(found: DataFrame) -> DataFrame:
    return found.groupBy("k0", "k1").agg(
        F.max_by(F.struct("target_rid", "similarity"), F.struct("similarity", -F.col("target_rid"))).alias("x")
    ).select("k0", "k1", "x.*")


def search(left: DataFrame, right: DataFrame, cell_rows: int = 4096, left_rows: int = 4096, right_rows: int = 16_384) -> DataFrame:
    """(rid, target_rid, similarity, cells) of left and right rows (rid, v): the most similar right vector by the cosine at six
    places, the first rid on ties, and how many cells the row's query has visited.

    Vectors with a null, without length, or of a width that no right row has, are like none: they get the first right row, no
    similarity and no visit. Without right rows there is no result."""
    spark, work = left.sparkSession, f"{home(left.sparkSession)}/{uuid.uuid4().hex}"
    keep = lambda df: kept(df, work)
    if (kinds := {df.schema["rid"].dataType.simpleString() for df in (left, right)}) and len(kinds) > 1:
        raise TypeError(f"rid is {' and '.join(sorted(kinds))}")
    asking = _hashed(left)
    same = lambda df: df.where("v is not null").groupBy("h0", "h1")
    named = keep(_unit(same(asking).agg(F.first("v").alias("v")), "h0", "h1"))  # a vector's length is taken once
    queries = keep(named.groupBy("k0", "k1").agg(F.first("v").alias("v")).withColumns(
        {"target_rid": F.lit(None).cast(kinds.pop()), "similarity": F.lit(None).cast("double"), "cells": F.lit(0).cast("long")}
    ))
    held = same(_hashed(right)).agg(F.min("rid").alias("rid"), F.first("v").alias("v"))
    members = keep(_unit(held, "rid").groupBy("k0", "k1").agg(F.min("rid").alias("rid"), F.first("v").alias("v")))
    widths = {r.width: r.n for r in members.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).collect()}
    fitted = {}
    for width, n in widths.items():
        k = min(CELLS, -(-n // cell_rows))
        fitted[width] = centres(_sampled(members, width, n), k) if k > 1 else np.zeros((0, width))
    dealt = members if all(not len(c) for c in fitted.values()) else keep(_dealt(members, fitted))
    if dealt is members:  # one cell has them all, whatever they are
        dealt = members.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)})
    stats = dealt.groupBy(F.size("v").alias("width"), "cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()
    cells, sizes = {}, {(s.width, s.cell): s.n for s in stats}
    for width, held in fitted.items():
        radius, size = np.full(len(held) + 1, np.pi), np.zeros(len(held) + 1, np.int64)
        for s in stats:
            if s.width == width:
                size[s.cell] = s.n
                radius[s.cell] = np.pi if s.cell == len(held) else s.angle + 1e-7
        cells[width] = Cells(held, radius, size)
    first, many, most = 0, 1, max([len(c.size) for c in cells.values()], default=0)
    while first < most:
        asked = keep(_asked(queries, cells, first, many)) if most > 1 else _asked(queries, cells, first, many)
        found = _visited(asked, dealt, sizes, left_rows, right_rows)
        if found is None:
            break
        both = queries.join(
            found.select("k0", "k1", F.struct("target_rid", "similarity").alias("new"), F.col("cells").alias("more")),
            ["k0", "k1"], "left"
        )
        better = F.expr(
            "new is not null and (target_rid is null or new.similarity > similarity"
            " or (new.similarity = similarity and new.target_rid < target_rid))"
        )
        queries = keep(both.select(
            "k0", "k1", "v", *[F.when(better, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("target_rid", "similarity")],
            (F.col("cells") + F.coalesce("more", F.lit(0))).alias("cells")
        ))
        first, many = first + many, 2 * many
    answers = queries.where("target_rid is not null").select("k0", "k1", "target_rid", "similarity", "cells")
    answers = named.select("h0", "h1", "k0", "k1").join(answers, ["k0", "k1"]).drop("k0", "k1")
    first_row = right.agg(F.min("rid").alias("_first"), F.count("*").alias("_n")).where("_n > 0")
    found = looked_up(asking.drop("v"), answers, ["h0", "h1"], "left").join(F.broadcast(first_row))
    result = kept(found.select(
        "rid", F.coalesce("target_rid", "_first").alias("target_rid"), "similarity", F.coalesce("cells", F.lit(0)).alias("cells")
    ))
    drop(spark, work)
    return result
