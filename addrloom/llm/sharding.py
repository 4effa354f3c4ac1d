"""Placement of documents by a permutation-filled lookup table: shards take turns claiming slots of a prime-sized table, each
by its own order of preference, so shards get nearly equal numbers of slots, and one that comes or goes moves few documents.

The table is a broadcast side of `size` rows, whatever the documents: a placement is one hash and one look-up. The main path
is DataFrame functions only. A null id is placed by the empty key; equal ids go to the same shard, however many; texts are not
read, so their length does not matter; an empty table gives no row. Other columns are kept by ``placed``, whatever their names:
where slot or shard is taken, the added column gets an underscore before its name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import column, free_names, table

SIZE, SHARDS = 65_537, 64


def _number(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest()[:15], 16)


def lookup(shards: list[str], size: int = SIZE) -> list[int]:
    """For each slot the place of its shard in shards; size is a prime larger than their number."""
    if not shards:
        raise ValueError("no shards")
    at = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    slots, left = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while slots[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            slots[at[i]] = i
            left -= 1
            if not left:
                return slots


def names(n: int) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def slot_of(key, size: int = SIZE):
    """The slot of a key column: the first 15 hexadecimal digits of its MD5, modulo the table's size."""
    return F.pmod(
        F.conv(
            F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10
        ).cast("long"),
        F.lit(size)
    ).cast("int")


def placed(docs: DataFrame, key: str = "doc_id", shards: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """docs with slot and shard (its place in shards)."""
    slots = ",".join(map(str, lookup(shards or names(SHARDS), size)))
    slot, shard, at, owner = free_names(["slot", "shard", "at", "owner"], docs.columns)
    spread = docs.sparkSession.range(1, numPartitions=1).select(
        F.posexplode(F.split(F.lit(slots), ",")).alias(at, owner)
    )
    spread = spread.select(at, F.col(owner).cast("int").alias(owner))
    rows = docs.withColumn(slot, slot_of(column(key), size))
    return rows.join(F.broadcast(spread), F.col(slot) == F.col(at)).withColumn(shard, F.col(owner)).drop(at, owner)


def op7_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_chars", "slot", "shard")


SQL = f"""
WITH t AS (SELECT CAST(unnest(range(0, {SIZE})) AS INTEGER) AS slot, CAST(unnest(string_split('{{slots}}', ',')) AS INTEGER) AS shard),
d AS (SELECT doc_id, source, n_chars, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SIZE} AS INTEGER) AS slot FROM documents)
SELECT d.doc_id, d.source, d.n_chars, d.slot, t.shard FROM d JOIN t USING (slot)
""".replace("{slots}", ",".join(map(str, lookup(names(SHARDS)))))
