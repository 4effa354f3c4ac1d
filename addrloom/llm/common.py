"""Helpers shared by the text operators: table access, staging, worker-side word hashing, components."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..sources.shared import drop, home, shared_dir  # noqa: F401

#: ASCII white space only: the words of every contract are runs of [^\x20\x09-\x0D]; bytes.split() splits exactly there.
WORD = r"[^\x20\x09-\x0D]+"
CACHE_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scope: contextvars.ContextVar[str | None] = contextvars.ContextVar("staging", default=None)


@contextlib.contextmanager
def staging(spark: SparkSession):
    """Gathers what is staged inside it (in this thread) in one folder, which it gives; the caller drops it in time."""
    folder = f"{home(spark)}/{uuid.uuid4().hex}"
    before = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(before)


def staged(df: DataFrame, heavy: bool = False) -> DataFrame:
    """Cuts the lineage: the rows are written once to the shared folder and read back from there.

    Shuffle files of what is no longer needed go when the driver collects its garbage; after heavy ones it is asked to."""
    spark = df.sparkSession
    path = f"{_scope.get() or home(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if heavy:
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make(), written once; what it has staged on its way is deleted before they are handed out."""
    with staging(spark) as folder:
        made = make()
        path = f"{home(spark)}/{uuid.uuid4().hex}"
        made.write.parquet(path)
    drop(spark, folder)
    return spark.read.schema(made.schema).parquet(path)


def column(name: str) -> Column:
    """A column by its very name, whatever letters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(wanted: list[str], taken: list[str]) -> list[str]:
    """The wanted names, with an underscore before those that are taken (Spark does not tell case apart)."""
    out, known = [], {t.lower() for t in taken}
    for name in wanted:
        while name.lower() in known:
            name = "_" + name
        known.add(name.lower())
        out.append(name)
    return out


def carrying(row: DataType, rest: str) -> StructType:
    """The schema of rows that carry an input row (whatever its columns are called) beside the columns of a DDL text."""
    return StructType([StructField("row", row), *StructType.fromDDL(rest)])


def released() -> None:
    """Gives back what numpy's and Arrow's allocators have free: each keeps it otherwise, in every worker of an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, rows: int = 500):
    """Record batches of at most so many rows, which bounds what a worker makes of one at a time, and keeps after it."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)
            released()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """64-bit hash of a word (bytes), kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS and len(word) <= 64:
            self[word] = value
        return value


_hashes = WordHashes()
#: What this worker keeps between tasks, by the operators that use it.
caches: dict[str, dict] = {"hashes": _hashes}


def keep_only(name: str | None = None) -> None:
    """Empties the worker's caches but the one named: a worker outlives its stage, and what one stage has kept must not add to the next one's memory."""
    for cache in [c for n, c in caches.items() if n != name and c]:
        cache.clear()
    released()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mix(out)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles, A-Z lower-cased; a shorter text is one shingle, no word none."""
    words = words_of(text.translate(_LOWER) if text else None)
    if not words:
        return np.zeros(0, np.uint64)
    hashes = hash_words(words)
    return np.unique(
        grams(hashes, min(k, len(words))) if len(words) >= k else mix(grams(hashes, len(words)) + np.uint64(len(words)))
    )


_LOWER = {c: c + 32 for c in range(65, 91)}


def signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def int64_lists(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64, copy=False)))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long edges as (node, root), root the smallest node; nodes without edges are absent.

    Alternating large-star and small-star steps: every step is a group-wise minimum (combined map-side) and a join, so no
    component meets in one task. Each round is staged.
    """
    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(
            e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        ) if large else e.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        # The key is cast so that both sides are dealt anew: then the rows of a node with very many edges can be split.
        linked = both.join(low, F.col("a").cast("string") == F.col("k").cast("string"))
        kept = linked.where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ) if large else linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("k").alias("a"), F.col("m").alias("b"))
        )
        return kept.where("a <> b").distinct()

    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(rounds):
        now = staged(stars(stars(now, True), False))
        last, mark = mark, now.agg(
            F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(20)))")
        ).first()
        if mark == last or not mark[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(
        F.col("a").alias("node"), F.col("b").alias("root")
    ).unionByName(roots.withColumn("root", F.col("node")))


class Bloom:
    """A filter of a fixed number of bits over long keys: it never loses a key, and passes more of the others as keys grow."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - (len(words) * 64).bit_length() + 1)

    @staticmethod
    def places(keys: np.ndarray, shift: np.uint64) -> list[np.ndarray]:
        return [
            (mix(keys.view(np.uint64) ^ np.uint64(seed)) >> shift).astype(np.int64)
            for seed in (0x5BD1E995, 0x1B873593CC9E2D51)
        ]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys, self.shift):
            out &= ((self.words[at >> 6] >> (at & 63)) & 1).astype(bool)
        return out


def bloom_of(keys: DataFrame, bits: int = 1 << 26):
    """A broadcast Bloom filter over the only column of keys; at most bits / 64 longs reach the driver, whatever the keys."""
    shift = np.uint64(64 - bits.bit_length() + 1)

    def run(batches):
        for batch in batches:
            at = np.concatenate(Bloom.places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), shift))
            word = at >> 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int32)), pa.array(np.left_shift(np.int64(1), at & 63))], ["word", "mask"]
            )

    words = keys.mapInArrow(run, "word int, mask long").groupBy("word").agg(
        F.expr("bit_or(mask)").alias("mask")
    ).toArrow()
    full = np.zeros(bits // 64, np.int64)
    full[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(Bloom(full))


def rows_held(rows: DataFrame, found, key: str = "rk") -> DataFrame:
    """The rows whose key (a long) a broadcast filter holds: of a join that touches few rows, only these need to be shuffled."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(found.value.holds(batch.column(key).to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def without_held(batches, found, key: str = "rk"):
    """In a worker, the batches' other rows."""
    for batch in batches:
        yield batch.filter(pa.array(~found.value.holds(batch.column(key).to_numpy())))
