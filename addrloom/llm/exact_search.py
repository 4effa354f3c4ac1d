"""Exact top-k by inner product: a KD-tree per shard of the candidates, searched best-first.

Shards are cells of space: median splits of a bounded sample place every vector, and a cell with more rows than a shard may have
(equal vectors, or more cells wanted than the sample can split) is dealt out to several shards. A box's bound for a query is the
sum over the dimensions of the larger of q * low and q * high. Queries go to shards in rounds: to the one of the best bound, then
to the eight next ones, and so on by eights, each time only to shards whose cell's bound reaches the query's k-th score so far.
A shard's rows and its queries meet sorted in one stream: the tree is built once, queries pass by in batches. Trees split at the
median of the widest dimension down to small leaves with tight bounding boxes, and are opened best-first, no box that cannot
reach the k-th score. Ties go to the smaller id, so a box that reaches the k-th score exactly is opened.

Components become floor(256 * x) with x as double. Vectors that are null or empty or hold a null or a non-finite component
take no part (nor those that scaling makes so), nor do rows without an id. Trees hold vectors with a squared length under 2 ** 62
after scaling; pairs with a longer one are met in blocks of whole numbers of any size (exact_products). Ranks are by exact scores;
one that a long cannot hold is given as the nearest long. Vectors only meet vectors of their own length. A query finds every row but its own
(rows that share its id are not found); repeated rows are ranked one after the other. Extra columns are ignored, whatever their
names. An empty table gives no row.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import exact_products
from .common import finished, staged, table

LEAF, BLOCK_QUERIES, SAMPLE_VALUES, FEWEST = 128, 65_536, 2_000_000, 16
#: A shard has so many values and rows at most, as its tree is held by a task; small tables are cut finer, down to SHARD_LEAST
#: rows, until there are two shards for each core.
SHARD_VALUES, SHARD_MOST, SHARD_LEAST = 1 << 22, 65_536, 4096
_FOUND = "query_id long, vec_id long, score long"


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query (row) and box (column) no less than the largest score of a point in the box."""
    made = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    # Sums of whole numbers below 2 ** 53 are exact; beyond, what rounding may take off is put on.
    largest = np.abs(queries).sum(axis=1) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))
    return made + np.where(largest < 2.0**53, 0.0, 1e-9 * largest)[:, None]


class Tree:
    """Boxes of all nodes in two matrices; of a node its children, or the rows of a leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.low, self.high, self.nodes, self.most = [], [], [], float(np.abs(vectors).max(initial=0))
        self._grow(ids, vectors)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, ids: np.ndarray, points: np.ndarray) -> int:
        low, high, at = points.min(axis=0), points.max(axis=0), len(self.nodes)
        self.low.append(low)
        self.high.append(high)
        self.nodes.append(None)
        wide = int((high - low).argmax())
        if len(ids) <= LEAF or low[wide] == high[wide]:
            self.nodes[at] = (ids, points)
        else:
            order = np.argpartition(points[:, wide], len(ids) // 2)
            halves = order[: len(ids) // 2], order[len(ids) // 2 :]
            self.nodes[at] = [self._grow(ids[h], points[h]) for h in halves]
        return at

    def search(
        self, owns: list[int], queries: np.ndarray, k: int, floors: list[int | None]
    ) -> list[tuple[int, int, int]]:
        """(query's id, id, score) of the k best of each query that are no less than its floor."""
        out, reach = [], bounds(queries, self.low, self.high)
        for own, query, least, bound in zip(owns, queries, floors, reach.tolist()):
            exact = self.most * float(np.abs(query).sum()) < 2.0**53
            least = -(1 << 63) if least is None else least
            best: list[tuple[int, int]] = []  # a heap of (score, -id)
            heap = [(-bound[0], 0)]
            while heap:
                far, node = heapq.heappop(heap)
                if -far < least:
                    break
                held = self.nodes[node]
                if isinstance(held, list):
                    for child in held:
                        if bound[child] >= least:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                ids, points = held
                # Whole numbers of 64 bits add up rightly as long as the sum fits.
                scores = (
                    points @ query if exact else points.astype(np.int64) @ query.astype(np.int64)
                ).astype(np.int64)
                for i in np.flatnonzero(scores >= least).tolist():
                    if ids[i] != own:
                        item = (int(scores[i]), -int(ids[i]))
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                        if len(best) == k:
                            least = max(least, best[0][0])
            out += [(own, -i, s) for s, i in best]
        return out


def planes(points: np.ndarray, cells: int) -> list[tuple]:
    """Splits of space into at most so many cells, by medians of the points: (dimension, value, left, right), where left and
    right are places of splits, or -1 - c for cell c. Without a split there is one cell."""
    splits: list[list] = []
    heap, number = [(-len(points), 0, np.arange(len(points)), None)], 0
    done = []
    while heap:
        size, _, rows, above = heapq.heappop(heap)
        spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(1)
        wide = int(spread.argmax())
        if len(done) + len(heap) + 1 >= cells or -size < 2 * FEWEST or not spread[wide]:
            done.append(above)
            continue
        value = float(np.median(points[rows, wide]))
        left = points[rows, wide] < value
        if not left.any():
            value = float(np.nextafter(value, np.inf))
            left = points[rows, wide] < value
        splits.append([wide, value, None, None])
        if above:
            splits[above[0]][above[1]] = len(splits) - 1
        for place, part in ((2, rows[left]), (3, rows[~left])):
            number += 1
            heapq.heappush(heap, (-len(part), number, part, (len(splits) - 1, place)))
    for cell, above in enumerate(done):
        if above:
            splits[above[0]][above[1]] = -1 - cell
    return list(map(tuple, splits))


def cells_of(points: np.ndarray, splits: list[tuple]) -> np.ndarray:
    out = np.zeros(len(points), np.int32)
    todo = [(0, np.arange(len(points)))] if splits else []
    while todo:
        at, rows = todo.pop()
        wide, value, left, right = splits[at]
        below = points[rows, wide] < value
        for to, part in ((left, rows[below]), (right, rows[~below])):
            if to < 0:
                out[part] = -1 - to
            elif len(part):
                todo.append((to, part))
    return out


def _matrix(lists, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _by_width(batch):
    """(width, places, matrix) of a batch's vectors (column v)."""
    lists = batch.column("v")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        yield width, at, _matrix(lists if len(at) == len(sizes) else lists.take(pa.array(at)), width)


def _placed(splits):
    def run(batches):
        for batch in batches:
            cell = np.zeros(len(batch), np.int32)
            for width, at, points in _by_width(batch):
                cell[at] = cells_of(points, splits.value.get(width, []))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(cell)], ["id", "v", "cell"]
            )

    return run


def _boxes(batches):
    """A row for each task and cell: width, cell, n, low and high."""
    held: dict = {}
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        for width, at, points in _by_width(batch):
            for c in np.unique(cell[at]).tolist():
                own = points[cell[at] == c]
                n, low, high = held.get((width, c), (0, np.inf, -np.inf))
                held[width, c] = n + len(own), np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0))
    rows = [
        {"width": w, "cell": c, "n": n, "low": low.tolist(), "high": high.tolist()} for (w, c),
        (n, low, high) in held.items()
    ]
    yield pa.RecordBatch.from_pylist(
        rows,
        pa.schema(
            [
                ("width", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.float64())),
                ("high", pa.list_(pa.float64()))
            ]
        )
    )


def _box(key, group):
    bound = lambda name, f: f(np.array(group.column(name).to_pylist()), axis=0).tolist()
    row = {
        "width": key[0].as_py(), "cell": key[1].as_py(), "n": sum(group.column("n").to_pylist()),
        "low": bound("low", np.min), "high": bound("high", np.max)
    }
    return pa.Table.from_pylist([row], group.schema)


def _routed(boxes, start: int, end: int):
    """Queries (id, v, least) for the shards of the places from start to end by bound whose bound reaches the query's floor.

    boxes: width to (low, high, first shard and number of shards of each cell). A cell's shards follow each other, from one that
    depends on the query on."""
    def run(batches):
        for batch in batches:
            ids, floors = batch.column("id").to_numpy(), batch.column("least").to_pylist()
            at, shards = [], []
            for width, rows, points in _by_width(batch):
                low, high, first, number = boxes.value[width]
                for i, bound in zip(rows.tolist(), bounds(points, low, high)):
                    place = 0
                    for c in np.argsort(-bound, kind="stable").tolist():
                        if place >= end or floors[i] is not None and bound[c] < floors[i]:
                            break
                        for n in range(max(start - place, 0), min(int(number[c]), end - place)):
                            at.append(i)
                            shards.append(int(first[c]) + (n + int(ids[i])) % int(number[c]))
                        place += int(number[c])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in ("id", "v", "least")), pa.array(shards, pa.int32())],
                ["id", "v", "least", "shard"]
            )

    return run


def _streamed(k: int):
    """Rows (shard, block, side, id, v, least), sorted by the first three: a shard's vectors, then its queries."""
    def run(batches):
        now, ids, vectors, tree = None, [], [], None
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in ("shard", "block", "side")]
            turns = np.flatnonzero(np.any([np.diff(x) != 0 for x in names], axis=0)) + 1 if len(batch) else []
            found = []
            for a, b in zip([0, *turns], [*turns, len(batch)]):
                if a == b:
                    continue
                part, key = batch.slice(a, b - a), (int(names[0][a]), int(names[1][a]))
                if key != now:
                    now, ids, vectors, tree = key, [], [], None
                lists = part.column("v")
                points = _matrix(lists, len(lists[0]))
                if names[2][a] == 0:
                    ids.append(part.column("id").to_numpy())
                    vectors.append(points)
                elif ids or tree:
                    if tree is None:
                        tree, ids, vectors = Tree(np.concatenate(ids), np.concatenate(vectors)), [], []
                    owns, floors = part.column("id").to_pylist(), part.column("least").to_pylist()
                    for i in range(0, len(owns), 256):
                        found += tree.search(owns[i : i + 256], points[i : i + 256], k, floors[i : i + 256])
            q, v, s = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (q, v, s)], ["query_id", "vec_id", "score"]
            )

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; the rank limit also holds before the shuffle, task by task."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def shards_for(rows: int, width: int, cores: int) -> int:
    """Queries are copied to the shards that they visit, so shards are as large as a task can hold."""
    most = max(1, min(SHARD_MOST, SHARD_VALUES // width))
    return max(-(-rows // most), min(2 * cores, -(-rows // min(most, SHARD_LEAST))))


def scaled(vectors: DataFrame) -> DataFrame:
    """id, v (floor(256 * x) as doubles) of the rows that take part, and whether the vector is too long for a tree."""
    whole = "embedding is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(256D * cast(v as double)) < double('infinity'))"
    # From 2 ** 53 on a double is a whole number as it is, and floor() would cut it to a long.
    x = F.expr("transform(embedding, x -> if(abs(256D * cast(x as double)) < 9007199254740992D, cast(floor(256D * cast(x as double)) as double), 256D * cast(x as double)))")
    return vectors.where(F.col("vec_id").isNotNull() & F.expr(whole)).select(
        F.col("vec_id").cast("long").alias("id"), x.alias("v")
    ).withColumn("long", F.expr("aggregate(v, 0D, (s, x) -> s + x * x) >= 4611686018427387904D"))


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, shard_rows: int | None = None, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score for vectors (vec_id, embedding); queries are the ids divisible by `every`."""
    rows = scaled(vectors)
    found = _by_trees(rows.where("not long").select("id", F.expr("transform(v, x -> cast(x as int))").alias("v")), k, every, shard_rows, block_queries)
    if not rows.where("long").limit(1).count():
        return found
    rows = staged(rows)
    asked, far = rows.where(F.col("id") % every == 0), rows.where("long")
    pairs = exact_products.keyed(found)
    for queries, candidates in ((asked.where("long"), rows), (asked.where("not long"), far)):
        pairs = pairs.unionByName(exact_products.best(queries.select("id", "v"), candidates.select("id", "v"), k))
    order = Window.partitionBy("query_id").orderBy(F.col("key").desc(), F.col("vec_id"))
    return exact_products.scored(pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def _by_trees(rows: DataFrame, k: int, every: int, shard_rows: int | None, block_queries: int) -> DataFrame:
    """The same for rows (id, v) of vectors whose scores are exact in 64 bits.

    Beyond the sample, the driver gets a row for each length of vectors, and for each cell (at most a row of the sample in
    FEWEST, and one for each length)."""
    spark = rows.sparkSession
    counts = {r.width: r.n for r in rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cores = spark.sparkContext.defaultParallelism
    wanted = {w: -(-n // shard_rows) if shard_rows else shards_for(n, w, cores) for w, n in counts.items()}
    splits: dict[int, list] = {}
    if max(wanted.values()) > 1:
        sample = rows.orderBy(F.xxhash64("id", "v")).limit(
            max(1, SAMPLE_VALUES // max(counts))
        ).select("v").toArrow().combine_chunks()
        for batch in sample.to_batches():
            splits |= {w: planes(points, wanted[w]) for w, _, points in _by_width(batch)}
    held = spark.sparkContext.broadcast(splits)
    placed = staged(
        rows.mapInArrow(
            _placed(held), "id long, v array<int>, cell int"
        ).withColumn("salt", F.monotonically_increasing_id())
    )
    parts = placed.select("v", "cell").mapInArrow(
        _boxes, "width int, cell int, n long, low array<double>, high array<double>"
    )
    boxes = parts.groupBy("width", "cell").applyInArrow(_box, parts.schema).orderBy("width", "cell").collect()
    number, first, total, by_width = {}, {}, 0, {}
    for b in boxes:
        number[b.width, b.cell] = max(1, round(b.n * wanted[b.width] / counts[b.width]))
        first[b.width, b.cell] = total
        total += number[b.width, b.cell]
    for w in counts:
        own = [b for b in boxes if b.width == w]
        by_width[w] = tuple(
            np.array([f(b) for b in own])
            for f in (
                lambda b: b.low, lambda b: b.high, lambda b: first[b.width, b.cell], lambda b: number[b.width, b.cell]
            )
        )
    held = spark.sparkContext.broadcast(by_width)
    owner = spark.createDataFrame(
        [(w, c, first[w, c], n) for (w, c), n in number.items()], "width int, own int, first int, number int"
    )
    shards = placed.join(F.broadcast(owner), (F.size("v") == F.col("width")) & (F.col("cell") == F.col("own")))
    shards = shards.select("id", "v", (F.col("first") + F.pmod("salt", "number")).cast("int").alias("shard"))
    queries = placed.where(F.col("id") % every == 0).select("id", "v")
    best, start, end = None, 0, 1
    while start < total:
        if best is None:
            asked = queries.withColumn("least", F.lit(None).cast("long"))
        else:
            floors = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
            asked = queries.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "v", "least")
        asked = asked.mapInArrow(_routed(held, start, end), "id long, v array<int>, least long, shard int")
        # A shard with very many queries is copied for blocks of them.
        loads = staged(
            asked.groupBy("shard").agg(
                F.ceil(F.count("*") / block_queries).cast("int").alias("blocks")
            ).withColumnRenamed("shard", "s")
        )
        here = shards.join(loads, F.col("shard") == F.col("s")).select(
            "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), "id",
            "v", F.lit(None).cast("long").alias("least")
        )
        there = asked.join(loads, F.col("shard") == F.col("s")).select(
            "shard", F.pmod(F.xxhash64("id", "v"), "blocks").cast("int").alias("block"), F.lit(1).alias("side"), "id",
            "v", "least"
        )
        met = here.unionByName(there).repartition("shard", "block").sortWithinPartitions("shard", "block", "side")
        found = met.mapInArrow(_streamed(k), _FOUND)
        best = staged(
            _best(found if best is None else best.select("query_id", "vec_id", "score").unionByName(found), k)
        )
        start, end = end, 8 * end + 1
    return best


def op6_kd_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, lambda: top_k(table(spark, sf_dir, "embeddings")))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
