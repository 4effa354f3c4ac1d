"""N-gram Jaccard join: a size-aware heavy-light self join that returns one row per document with its component.

Equal sets fall together first. Sets up to a boundary are light: they emit their subsets of every size that a linked pair can
share, and sharing one decides a link without any verification. Larger sets are heavy: inverted lists are scanned for their
partners. The boundary is chosen by cost, from the data: subsets that light sets would emit against entries of the inverted lists
that they would scan. Candidates of heavy sets come in steps, of which none loses a link:

* Sets that cannot have a partner go: those with too few shingles, in a prefix of the sorted hashes and then in the whole set,
  that any other set has.
* A set is cut by shingle hash into more parts than a linked pair can differ in (pigeonhole): linked sets share whole parts, and
  more than ``spare`` of them. Sets that share fewer with all others together go. Empty parts say nothing and are left out, and
  so are small ones while few enough; a set with more than ``spare`` of such parts is cut anew by another hash, and so is any set
  that it shares only such parts with.
* Each set is compared with one other: of the least sets of its parts the one that it shares most parts with. Parts whose sets
  then are all in one component are done.
* Sets that share one of the other parts form clusters. In a cluster the sets outside its largest component meet one another and
  that component, block against block, by scanning inverted lists of the block's shingles. Blocks are bounded in sets and in
  shingles, and a large group of near copies is one component by then, which is not scanned against itself.

Null, empty and blank texts have no shingle and link with nothing; equal rows link with each other; ties for a component's name
go to the least id; a null doc_id is kept (a component of null ids only has a null id); texts are read whole, however long; an
empty table gives no row. Extra columns are ignored. Sets, shingles and parts are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bloom_of, components, finished, int64_lists, keep_only, mix, rows_held, shingle_hashes, signed, slices, staged, table, without_held

BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 18
#: The most shingles that a light set's partner may lack: beyond it a set has thousands of subsets.
DELETIONS = 2


def need(a: int, b: int, percent: int) -> int:
    """The least overlap of linked sets of sizes a and b: 100 * overlap >= percent * (a + b - overlap)."""
    return -(-percent * (a + b) // (100 + percent))


def lacking(n: int, percent: int) -> int:
    """So many shingles of a set of n at most does a linked partner lack."""
    return n - -(-percent * n // 100)


def light_most(percent: int, deletions: int = DELETIONS) -> int:
    """The largest size whose linked partners lack at most so many of its shingles; no smaller size has one that lacks more."""
    return -(-100 * (deletions + 1) // (100 - percent)) - 1


def bands(percent: int, light: int, most: int) -> list[int]:
    """Lower edges of the heavy sizes' bands: linked sets are in the same band or in neighbouring ones. The first band begins
    with the smallest partners of sets over the boundary."""
    edges = [max(1, -(-percent * (light + 1) // 100))]
    while edges[-1] <= most:
        edges.append(100 * edges[-1] // percent + 1)
    return edges


@functools.cache
def cut(lowest: int, highest: int, percent: int) -> tuple[int, int, int]:
    """(parts, spare, least) for pairs whose smaller set has from lowest to highest shingles: linked ones share more than
    `spare` of the parts; parts of fewer than `least` shingles are left out. At the lowest size, parts that small are rarely
    more than a third of `spare`, if they are not just the empty ones."""
    needed = (100 - percent) * highest // percent + 1
    spare = needed + 2
    parts, least, below = needed + spare, 1, 0.0
    mean = lowest / parts
    for k in range(6):
        below += math.exp(-mean) * mean**k / math.factorial(k)
        expected = parts * below
        if expected + 3 * math.sqrt(expected) > spare / 3:
            break
        least = k + 1
    return parts, spare, least


def prefix(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The smallest hashes of a set. The first tenth (of the smaller set's size) of what linked sets share lies in both prefixes,
    as a set of n shingles misses at most n - ceil(percent * n / 100) of its partner's."""
    n = len(shingles)
    return shingles[: lacking(n, percent) + -(-n // 10)]


def shared_least(n: int, percent: int) -> int:
    """So many shingles of the prefix of n's set does any linked partner have in its own."""
    return -(-(-(-percent * n // 100)) // 10)


def heavy_keys(shingles: np.ndarray, percent: int, edges: list[int]) -> list[tuple[int, int, np.ndarray]]:
    """(band, least, keys) for the pairs in which its band is the lower one and those in which it is the upper one: the lower
    band, how many of the keys a linked set has too at least, and hashes of the set's parts.

    Parts are equal or not, and equal ones are equally small. So sets that share more than `spare` parts, but only small ones,
    both have more than `spare` small parts, and both are cut anew; after the last hash the small parts are used after all."""
    band, found = int(np.searchsorted(edges, len(shingles), "right")) - 1, []
    for group in (band - 1, band):
        if group < 0:
            continue
        parts, spare, least = cut(edges[group], edges[group + 1] - 1, percent)
        made, shared = [], 1
        for salt in range(4):
            part = (mix(shingles + np.uint64(group + (salt << 40))) % np.uint64(parts)).astype(np.int64)
            size = np.bincount(part, minlength=parts)
            sums = np.zeros(len(shingles) + 1, np.uint64)
            np.cumsum(mix(shingles)[np.argsort(part, kind="stable")], out=sums[1:])
            ends = np.cumsum(size)
            name = np.arange(parts, dtype=np.uint64) + np.uint64((group << 32) + (salt << 56))
            keys = mix((sums[ends] - sums[ends - size]) + mix(name))
            small = size < least
            lost = int(small.sum())
            made.append(keys if salt == 3 and lost > spare else keys[~small])
            if lost <= spare:
                shared = 1 if salt else spare + 1 - lost
                break
        found.append((group, shared, np.concatenate(made)))
    return found


def light_keys(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and sizes of the subsets that a linked partner of no smaller size can share in full."""
    mixed, n = mix(shingles), len(shingles)
    total, keys, sizes = mixed.sum(dtype=np.uint64), [], []
    for gone in range(lacking(n, percent) + 1):
        places = list(combinations(range(n), gone))
        at = np.array(places, np.int64).reshape(len(places), gone)
        keys.append(mix(total - mixed[at].sum(axis=1, dtype=np.uint64) + np.uint64(n - gone)))
        sizes.append(np.full(len(at), n - gone, np.int64))
    return np.concatenate(keys), np.concatenate(sizes)


def set_id(shingles: np.ndarray) -> int:
    x = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return x - (1 << 64) * (x >> 63)


def _signatures(k: int, percent: int):
    """Per document the id and size of its set, the whole set where it can be light, and the prefix."""
    light = light_most(percent)

    def run(batches):
        keep_only("hashes")
        for batch in slices(batches):
            sets = [shingle_hashes(t, k) for t in batch.column(1).to_pylist()]
            n, sid = [len(s) for s in sets], [set_id(s) if len(s) else None for s in sets]
            small = int64_lists([signed(s) if len(s) <= light else np.zeros(0, np.int64) for s in sets])
            first = int64_lists([signed(prefix(s, percent)) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), small, first],
                ["doc_id", "hash", "n_shingles", "sid", "small", "prefix"]
            )

    return run


def boundary(small: DataFrame, percent: int) -> int:
    """The light sets' largest size, by cost: what enumeration emits for the sizes up to it and scanning reads for those beyond.

    small has the different sets (sid, n_shingles, prefix) up to the largest size that may be light; a size's scanning cost is
    the length of the inverted lists of its sets' prefixes. Both are sums by size: one row for each, light_most of them."""
    lists = small.select("n_shingles", F.explode("prefix").alias("key"))
    length = lists.groupBy("key").agg(F.count("*").alias("n")).select(F.col("key").cast("string").alias("k"), "n")
    scan = lists.join(
        length, F.col("key").cast("string") == F.col("k")
    ).groupBy("n_shingles").agg(F.sum("n").alias("scan"))
    rows = small.groupBy("n_shingles").agg(F.count("*").alias("sets")).join(scan, "n_shingles", "left").collect()
    costs = {
        r.n_shingles: (
            r.sets * sum(math.comb(r.n_shingles, g) for g in range(lacking(r.n_shingles, percent) + 1)), r.scan or 0
        )
        for r in rows
    }
    total = lambda x: sum(light if n <= x else heavy for n, (light, heavy) in costs.items())
    return min(range(light_most(percent) + 1), key=lambda x: (total(x), x))


def _subsets(percent: int):
    def run(batches):
        keep_only("hashes")
        for batch in slices(batches, 2000):
            lists = batch.column(2)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            sets = np.split(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ends[:-1])
            made = [light_keys(s, percent) for s in sets]
            times = pa.array(np.repeat(np.arange(len(made)), [len(a) for a, _ in made]))
            keys, sizes = (np.concatenate(x) if made else np.zeros(0, np.int64) for x in (list(zip(*made)) or ((), ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(times), batch.column(1).take(times), pa.array(signed(keys)), pa.array(sizes)],
                ["sid", "n_shingles", "key", "o"]
            )

    return run


def _light_links(small: DataFrame, percent: int) -> DataFrame:
    """Sets that share a whole subset are linked, if their sizes allow it: a star around the smallest of them, as whoever links
    by this subset links with that one too."""
    subsets = small.select("sid", "n_shingles", "small").mapInArrow(
        _subsets(percent), "sid long, n_shingles long, key long, o long"
    )
    rank = F.struct(F.col("n_shingles").alias("n"), F.col("sid").alias("s"))
    hubs = subsets.groupBy("key", "o").agg(F.min(rank).alias("hub"), F.max(rank).alias("last")).where("hub <> last")
    hubs = hubs.select(F.col("key").cast("string").alias("hub_key"), F.col("o").alias("hub_o"), "hub.n", "hub.s")
    found = subsets.join(hubs, (F.col("key").cast("string") == F.col("hub_key")) & (F.col("o") == F.col("hub_o")))
    return found.where(
        (F.col("sid") != F.col("s")) & (100 * F.col("o") >= percent * (F.col("n_shingles") + F.col("n") - F.col("o")))
    ).select(F.col("sid").alias("a"), F.col("s").alias("b"))


def _sets(k: int, wanted):
    """The sets of the documents whose text hash the filter holds."""
    def run(batches):
        keep_only("hashes")
        for batch in slices(batches):
            batch = batch.take(pa.array(np.flatnonzero(wanted.value.holds(batch.column(2).to_numpy()))))
            sets = [shingle_hashes(t, k) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([set_id(s) for s in sets], pa.int64()),
                    int64_lists([signed(s) for s in sets])
                ],
                ["id", "hash", "set", "shingles"]
            )

    return run


def _with_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """members (sid, doc_id, hash and more), one row for each set, with the set's shingles instead of doc_id and hash."""
    wanted = bloom_of(members.select("hash"))
    sets = docs.mapInArrow(
        _sets(k, wanted), "id long, hash long, set long, shingles array<long>"
    ).withColumnsRenamed({"hash": "h"})
    found = members.join(
        sets, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sid") == F.col("set")) & (F.col("hash") == F.col("h"))
    )
    return found.select(*(c for c in members.columns if c not in ("doc_id", "hash")), "shingles")


def _promising(found, least, keys: str):
    """The rows of which so many of the keys (a list column) are in the filter as a linked set must have there at least."""
    def run(batches):
        keep_only("hashes")
        for batch in slices(batches, 2000):
            lists = batch.column(keys)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            held = found.value.holds(lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum(lengths)
            sums = np.concatenate([[0], np.cumsum(held)])
            needed = np.array([least(n) for n in batch.column("n_shingles").to_pylist()], np.int64)
            yield batch.filter(
                pa.array(sums[ends] - sums[ends - lengths] >= needed)
            ).drop_columns([keys] if keys == "prefix" else [])

    return run


def _likely_sets(docs: DataFrame, made: DataFrame, k: int, percent: int) -> DataFrame:
    """(sid, n_shingles, shingles) of the heavy sets that can have a partner: enough of their shingles are in other sets too."""
    keys = made.select("sid", F.explode("prefix").alias("key")).groupBy("key").agg(
        F.min("sid").alias("lo"), F.max("sid").alias("hi")
    )
    often = bloom_of(keys.where("lo <> hi").select("key"))
    few = made.select("doc_id", "hash", "n_shingles", "sid", "prefix").mapInArrow(
        _promising(often, lambda n: shared_least(n, percent), "prefix"),
        "doc_id long, hash long, n_shingles long, sid long"
    )
    one = staged(
        few.groupBy("sid", "n_shingles").agg(
            F.min(F.struct("doc_id", "hash")).alias("one")
        ).select("sid", "n_shingles", "one.doc_id", "one.hash"),
        heavy=True
    )
    # Repeated rows have the same id and text, and so bring a set more than once.
    sets = staged(_with_sets(docs, one, k).dropDuplicates(["sid"]))
    again = bloom_of(
        sets.select(F.explode("shingles").alias("key")).groupBy("key").count().where("count > 1").select("key")
    )
    return staged(
        sets.mapInArrow(_promising(again, lambda n: -(-percent * n // 100), "shingles"), sets.schema), heavy=True
    )


def _part_keys(percent: int, light: int):
    def run(batches):
        keep_only("hashes")
        edges = bands(percent, light, 1 << 16)
        for batch in slices(batches):
            lists = batch.column("shingles")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            sets = np.split(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ends[:-1])
            while len(ends) and max(map(len, sets)) >= edges[-1]:
                edges.append(100 * edges[-1] // percent + 1)
            rows = [(i, *found) for i, own in enumerate(sets) for found in heavy_keys(own, percent, edges)]
            times = [len(keys) for *_, keys in rows]
            of = lambda j, kind: pa.array(np.repeat(np.array([r[j] for r in rows], kind), times))
            flat = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sid").take(of(0, np.int64)), of(1, np.int32), of(2, np.int32), pa.array(signed(flat))],
                ["sid", "band", "least", "key"]
            )

    return run


def _held(wanted):
    """The rows whose key the filter holds."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.holds(batch.column("key").to_numpy())))

    return run


def _shared_parts(likely: DataFrame, percent: int, light: int) -> DataFrame:
    """(sid, key, hub): the parts that several sets share, with the least of them, of sets that share enough parts."""
    parts = staged(
        likely.select("sid", "shingles").mapInArrow(
            _part_keys(percent, light), "sid long, band int, least int, key long"
        )
    )
    often = bloom_of(parts.groupBy("key").count().where("count > 1").select("key"))

    def shared(rows: DataFrame) -> DataFrame:
        hubs = rows.groupBy("key").agg(
            F.min("sid").alias("hub"), F.max("sid").alias("last")
        ).where("hub <> last").select(F.col("key").cast("string").alias("k"), "hub")
        return rows.join(hubs, F.col("key").cast("string") == F.col("k")).drop("k")

    rows = staged(shared(parts.mapInArrow(_held(often), parts.schema)).drop("hub"))
    enough = rows.groupBy("sid", "band").agg(
        F.count("*").alias("n"), F.max("least").alias("least")
    ).where("n >= least").select(F.col("sid").alias("s"), F.col("band").alias("b"))
    return staged(
        shared(
            rows.join(enough, (F.col("sid") == F.col("s")) & (F.col("band") == F.col("b")), "left_semi")
        ).select("sid", "key", "hub"),
        heavy=True
    )


def _hub_links(likely: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links of sets with one other: the least set of a part, the one that most of the set's parts name."""
    named = parts.where("sid <> hub").groupBy("sid", "hub").agg(F.count("*").alias("n"))
    pairs = named.groupBy("sid").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    text = lambda c: F.col(c).cast("string")
    left = pairs.join(likely.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), text("sid") == text("a"))
    both = left.join(likely.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), text("hub") == text("b"))
    overlap = F.size(F.array_intersect("x", "y"))
    return both.where(100 * overlap >= percent * (F.size("x") + F.size("y") - overlap)).select("a", "b")


def forest_links(
    left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, left_root=None, right_root=None
) -> list[tuple[int, int]]:
    """Links between two blocks of sets (or within one), by scanning the inverted lists of the one with each set of the other;
    the links that join no new parts of the forest are left out: it begins with the sets of equal roots, if they are given.
    Places count on through both blocks."""
    other = left if right is None else right
    sizes = np.array([len(s) for s in other], np.int64)
    owner = np.repeat(np.arange(len(other)), sizes)
    flat = np.concatenate(other) if other else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    base = 0 if right is None else len(left)
    known: dict = {}
    names = [*(left_root or ()), *(() if right is None else right_root or ())]
    root = [known.setdefault(name, i) for i, name in enumerate(names)] or list(range(base + len(other)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i, s in enumerate(left):
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        counts = hi - lo
        if not (total := int(counts.sum())):
            continue
        at = np.repeat(hi - np.cumsum(counts), counts) + np.arange(total)
        overlap = np.bincount(owner[at], minlength=len(other))
        for j in np.flatnonzero(100 * overlap >= percent * (sizes + len(s) - overlap)):
            if (right is not None or j > i) and (a := top(i)) != (b := top(base + int(j))):
                root[max(a, b)] = min(a, b)
                links.append((i, base + int(j)))
    return links


def _verify(percent: int):
    def run(key, group):
        side = group.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        sids, roots = group.column("sid").to_numpy()[order], group.column("root").to_numpy()[order].tolist()
        lists = group.column("shingles").combine_chunks()
        flat, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        sets = [flat[offsets[i] : offsets[i + 1]] for i in order]
        split = int((side == 0).sum())
        found = []
        if len(set(roots)) > 1:
            two = key[1].as_py() != key[2].as_py()
            found = forest_links(sets[:split], sets[split:] if two else None, percent, roots[:split], roots[split:])
        return pa.table(
            {
                "a": pa.array([int(sids[i]) for i, _ in found], pa.int64()),
                "b": pa.array([int(sids[j]) for _, j in found], pa.int64())
            }
        )

    return run


def _open_links(likely: DataFrame, parts: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links across components of sets that share a part: sets with such parts in common form clusters; of each cluster, the
    sets outside of its largest component meet each other and those inside, in blocks."""
    text = lambda c: F.col(c).cast("string")
    named = parts.join(
        roots.select("node", F.col("root").alias("r")), text("sid") == text("node"), "left"
    ).select("sid", "key", "hub", F.coalesce("r", "sid").alias("root"))
    mixed = named.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi")
    ).where("lo <> hi").select(text("key").alias("k"))
    rows = staged(named.join(mixed, text("key") == F.col("k")).select("sid", "hub", "root").distinct())
    found = components(rows.where("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b")))
    members = rows.select("sid", "root").distinct().join(
        found.select(F.col("node").alias("c"), F.col("root").alias("cluster")), text("sid") == text("c")
    ).select("sid", "root", "cluster")
    members = staged(
        members.join(likely.select(F.col("sid").alias("s"), "n_shingles"), text("sid") == text("s")).drop("s")
    )
    shares = members.groupBy("cluster", "root").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("size"), F.min("n_shingles").alias("low"),
        F.max("n_shingles").alias("high")
    )
    shares = staged(shares)
    whole = shares.groupBy("cluster").agg(
        F.max_by("root", F.struct("n", "root")).alias("main")
    ).select(text("cluster").alias("k"), "main")
    outer = F.col("root") != F.col("main")
    kinds = shares.join(whole, text("cluster") == F.col("k")).groupBy("k", "main").agg(
        F.sum(F.when(outer, F.col("n"))).alias("out_n"), F.sum(
            F.when(outer, F.col("size"))
        ).alias("out_size"), F.min(F.when(outer, F.col("low"))).alias("low"), F.max(
            F.when(outer, F.col("high"))
        ).alias("high"),
        F.sum(F.when(~outer, F.col("n"))).alias("in_n"), F.sum(
            F.when(~outer, F.col("size"))
        ).alias("in_size")).where("out_n > 0")
    blocks = lambda n, size: F.greatest(
        F.ceil(F.col(n) / BLOCK_SETS), F.ceil(F.col(size) / BLOCK_SHINGLES)
    ).cast("int")
    kinds = staged(
        kinds.select(
            "k", "main", "low", "high", blocks("out_n", "out_size").alias("outs"),
            blocks("in_n", "in_size").alias("ins")
        )
    )
    rows = members.join(kinds, text("cluster") == F.col("k")).withColumn("outer", outer)
    # Inside, sets of a size that none outside can link with are left out.
    rows = rows.where("outer").unionByName(
        rows.where(
            ~F.col("outer") & (100 * F.col("n_shingles") >= percent * F.col("low"))
            & (percent * F.col("n_shingles") <= 100 * F.col("high"))
        )
    )
    rows = rows.withColumn(
        "mine", F.pmod(F.xxhash64("sid"), F.when(F.col("outer"), F.col("outs")).otherwise(F.col("ins"))).cast("int")
    )
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    deal = lambda i, j, side: F.struct(
        i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side")
    )
    among = F.transform(
        upto("outs"), lambda x: deal(F.least("mine", x), F.greatest("mine", x), (F.col("mine") > x).cast("int"))
    )
    out = rows.where("outer").select(
        "sid", "root", "cluster",
        F.explode(F.concat(among, F.transform(upto("ins"), lambda x: deal(F.col("mine"), -1 - x, F.lit(0))))).alias("x")
    )
    inside = rows.where(~F.col("outer")).select(
        "sid", "root", "cluster",
        F.explode(F.transform(upto("outs"), lambda x: deal(x, -1 - F.col("mine"), F.lit(1)))).alias("x")
    )
    dealt = out.unionByName(inside).select("sid", "root", "cluster", "x.*")
    dealt = dealt.join(likely.select(F.col("sid").alias("s"), "shingles"), text("sid") == text("s")).drop("s")
    return dealt.groupBy("cluster", "i", "j").applyInArrow(_verify(percent), "a long, b long")


def _linked_sets(docs: DataFrame, made: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of the sets with links."""
    small = staged(
        made.where("size(small) > 0").groupBy("sid", "n_shingles").agg(
            F.min("small").alias("small"), F.min("prefix").alias("prefix")
        )
    )
    light = boundary(small, percent)
    links = _light_links(small.where(F.col("n_shingles") <= light), percent)
    likely = _likely_sets(docs, made.where(F.col("n_shingles") >= bands(percent, light, 1)[0]), k, percent)
    parts = _shared_parts(likely, percent, light)
    first = staged(components(links.unionByName(_hub_links(likely, parts, percent))))
    text = lambda c: F.col(c).cast("string")
    found = staged(_open_links(likely, parts, first, percent))
    for side in "ab":
        names = first.select(F.col("node").alias("n"), F.col("root").alias("r"))
        found = found.join(
            names, text(side) == text("n"), "left"
        ).withColumn(side, F.coalesce("r", side)).drop("n", "r")
    merged = staged(components(found))
    later = merged.select(F.col("node").alias("n"), F.col("root").alias("r"))
    moved = first.join(later, text("root") == text("n"), "left").select("node", F.coalesce("r", "root").alias("root"))
    return moved.unionByName(merged.join(first.select("node"), "node", "left_anti"))


def labelled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, hash (of the text), n_shingles and first: (doc_id, hash) of the component's first row, null without shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    made = staged(
        docs.mapInArrow(
            _signatures(k, percent),
            "doc_id long, hash long, n_shingles long, sid long, small array<long>, prefix array<long>"
        )
    )
    found = _linked_sets(docs, made, k, percent)
    # Nulls sort first in structs, so the id's absence comes before it.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    ids = made.where("sid is not null").groupBy("sid").agg(F.min(place).alias("low"))
    roots = ids.join(found, F.col("sid") == F.col("node"), "left").select(
        "sid", "low", F.coalesce("root", "sid").alias("root")
    )
    lowest = roots.groupBy("root").agg(F.min("low").alias("first")).select(
        F.col("root").cast("string").alias("r"), "first"
    )
    named = roots.join(
        lowest, F.col("root").cast("string") == F.col("r")
    ).select(F.col("sid").cast("string").alias("s"), "first")
    # Rows without a set get keys of their own, so that they are dealt evenly.
    key = F.coalesce(
        F.col("sid").cast("string"), F.concat(F.lit("none "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    )
    return made.select(
        "doc_id", "hash", "n_shingles", key.alias("s0")
    ).join(named, F.col("s0") == F.col("s"), "left").select("doc_id", "hash", "n_shingles", "first")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text); sets link when 100 * overlap >= percent * union."""
    return labelled(docs, k, percent).select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _others(found):
    def run(batches):
        yield from without_held(batches, found, "key")

    return run


def kept_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the first row of each component; rows without any shingle all stay. Only rows that a filter of the
    links' rows holds are joined, so that most texts are not shuffled."""
    found = staged(labelled(docs, k, percent).where("n_shingles > 0"))
    here = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    gone = found.where(here != F.col("first")).select(F.col("doc_id").alias("d0"), F.col("hash").alias("h0")).distinct()
    again = found.where(here == F.col("first")).groupBy("doc_id", "hash").count().where("count > 1").select(
        F.col("doc_id").alias("d0"), F.col("hash").alias("h0")
    )
    touched = bloom_of(gone.unionByName(again).select(F.xxhash64("d0", "h0").alias("key")))
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h")
    ).withColumn("key", F.xxhash64("d", "h"))
    same = F.col("d").eqNullSafe(F.col("d0")) & (F.col("h") == F.col("h0"))
    left = staged(rows_held(rows, touched, "key").join(gone, same, "left_anti"))
    parts = [
        rows.mapInArrow(_others(touched), rows.schema), left.join(again, same, "left_anti"),
        left.join(again, same, "left_semi").dropDuplicates(["d", "h"])
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("row.*")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, lambda: jaccard_components(table(spark, sf_dir, "documents")))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
n AS (SELECT r, doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
u AS (SELECT r, unnest(g) AS x FROM s),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM u a JOIN u b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(r, other) AS (SELECT r, r FROM n UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.other)
SELECT n.doc_id, n.n AS n_shingles, min(x.doc_id) AS component_id FROM n JOIN c ON n.r = c.r JOIN n x ON x.r = c.other GROUP BY n.r, n.doc_id, n.n
"""
