"""Best inner products of vectors too long for 64-bit sums: in blocks, bounded in floating point and settled in whole numbers.

Of a block's pairs only those that can be among a query's k best by the rounding error's bound are reckoned exactly, so most
cost one multiplication of matrices. Scores are keys of whole numbers of any size, whose bytes sort as the numbers do.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Squares of doubles have at most 2,048 bits before the point, sums a few more; a key has one for the sign.
KEY_BYTES = 264
_ZERO = 1 << (8 * KEY_BYTES - 1)
LONGEST = (1 << 63) - 1


def key_of(score: int) -> bytes:
    return (score + _ZERO).to_bytes(KEY_BYTES, "big")


def score_of(key: bytes) -> int:
    """The score, or the nearest long."""
    return max(-LONGEST - 1, min(LONGEST, int.from_bytes(key, "big") - _ZERO))


def _matrix(lists, width: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(-1, width)


def _exactly(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a, b) if x and y)


def best_of_block(k: int):
    def run(key, group):
        asked, held = (group.filter(pc.equal(group.column("side"), i)) for i in (0, 1))
        out = []
        if len(asked) and len(held):
            q, v = (_matrix(x.column("v"), key[0].as_py()) for x in (asked, held))
            owns, ids = asked.column("id").to_pylist(), held.column("id").to_numpy()
            for i in range(0, len(q), 64):
                with np.errstate(all="ignore"):
                    near = q[i : i + 64] @ v.T
                    error = (np.abs(q[i : i + 64]) @ np.abs(v).T) * (q.shape[1] + 2) * 2.0**-52
                sure = np.isfinite(near) & np.isfinite(error)
                for j, own in enumerate(owns[i : i + 64]):
                    other = ids != own
                    low = np.sort(np.where(sure[j], near[j] - error[j], -np.inf)[other])
                    least = low[-k] if len(low) >= k else -np.inf
                    high = np.where(sure[j], near[j] + error[j], np.inf)
                    at = np.flatnonzero(other & (high >= least))
                    found = ((_exactly(q[i + j], v[n]), -int(ids[n])) for n in at)
                    out += [(own, -n, key_of(s)) for s, n in heapq.nlargest(k, found)]
        q, v, s = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "key": pa.array(s, pa.binary())})

    return run


def best(queries: DataFrame, rows: DataFrame, k: int, query_rows: int = 512, block_rows: int = 8192) -> DataFrame:
    """(query_id, vec_id, key): of each block the k best rows (id, v) for each query (id, v) of the same width but its own."""
    blocks, shards = (max(1, -(-df.count() // n)) for df, n in ((queries, query_rows), (rows, block_rows)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("id", "v", "salt"), F.lit(n)).cast("int")
    columns = [F.size("v").alias("width"), "block", "shard", "side", "id", "v"]
    named = lambda df, side: df.withColumns({"salt": F.monotonically_increasing_id(), "side": F.lit(side)})
    a = named(queries, 0).withColumn("block", place(blocks)).withColumn("shard", every(shards))
    b = named(rows, 1).withColumn("shard", place(shards)).withColumn("block", every(blocks))
    return a.select(*columns).unionByName(b.select(*columns)).groupBy("width", "block", "shard").applyInArrow(
        best_of_block(k), "query_id long, vec_id long, key binary"
    )


def keyed(found: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) with keys in place of long scores."""
    def run(batches):
        for batch in batches:
            keys = pa.array([key_of(s) for s in batch.column("score").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), keys], ["query_id", "vec_id", "key"])

    return found.select("query_id", "vec_id", "score").mapInArrow(run, "query_id long, vec_id long, key binary")


def scored(found: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, key) with scores in place of keys."""
    def run(batches):
        for batch in batches:
            scores = pa.array([score_of(s) for s in batch.column("key").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), batch.column("rank"), batch.column("vec_id"), scores],
                ["query_id", "rank", "vec_id", "score"]
            )

    return found.select("query_id", "rank", "vec_id", "key").mapInArrow(run, "query_id long, rank int, vec_id long, score long")
