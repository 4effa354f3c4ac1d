"""Best-fit packing: whole documents into as few sequences as possible, by workers first and then up a tree of merges.

Only documents over the capacity are cut, into whole sequences and a last piece. In the first round each worker fits the
pieces at hand, longest first, each into the open sequence that it leaves least room in; sequences that are nearly full are
handed out, and those that stay underfull go on as items, with what lies in them. In each further round the underfull
sequences of all workers are dealt at random over nodes of at most ``node`` items, fitted again by the same rule, and so on
until one node holds the rest or a round saves less than one in a hundred: what is then left is as full as it gets.

A node's items are bounded (``node`` sequences of the capacity), so is a worker's buffer; no key is grouped by, so no source or
copy matters; a lost task is redone alike from rows that are written. Sequences differ in number by round, task and counter.

A null or empty text is the end token alone; repeated rows are packed as often as they occur; a null doc_id stays null; extra
columns are ignored; a very long text makes many whole sequences; pieces of one length are fitted in the order they come; an
empty table gives no piece.
"""

from __future__ import annotations

import itertools
import math
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import home, table
from .packing import tokenizer_path, word_ids

NEARLY, BUFFER, NODE, SAVES = 4, 4096, 4096, 0.01
PIECE = pa.struct([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("offset", pa.int64())
])
NAMES = ["sequence_id", "used", "pieces", "full"]
SCHEMA = (
    "sequence_id long, used int, "
    "pieces array<struct<doc_id: long, piece: int, start: long, ids: binary, doc_tokens: long, offset: long>>, full boolean"
)


class BestFit:
    """Open sequences by the room they have. An item is (length, pieces)."""

    def __init__(self, capacity: int, nearly: int):
        self.capacity, self.nearly = capacity, nearly
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some open sequence has room r
        self.full: list[tuple[int, list]] = []

    def fit(self, items: list[tuple[int, list]]) -> None:
        for length, pieces in sorted(items, key=lambda x: -x[0]):
            enough = self.rooms >> length
            if enough:
                room = length + (enough & -enough).bit_length() - 1
                held = self.open[room].pop()
                if not self.open[room]:
                    self.rooms ^= 1 << room
                held.extend(pieces)
            else:
                room, held = self.capacity, list(pieces)
            room -= length
            if room <= self.nearly:
                self.full.append((self.capacity - room, held))
            else:
                self.open[room].append(held)
                self.rooms |= 1 << room

    def held(self) -> int:
        return sum(map(len, self.open))

    def take(self, most: int = 0) -> list[tuple[int, list]]:
        """The open sequences beyond so many, fullest first."""
        out, over = [], self.held() - most
        for room, held in enumerate(self.open):
            while held and len(out) < over:
                out.append((self.capacity - room, held.pop()))
            if not held and self.rooms >> room & 1:
                self.rooms ^= 1 << room
        return out


def _batches(found: list[tuple[int, list]], first: int, full: bool, size: int = 500):
    """Sequences, numbered from first on, as batches."""
    for i in range(0, len(found), size):
        part = found[i : i + size]
        offsets = np.zeros(len(part) + 1, np.int32)
        np.cumsum([len(pieces) for _, pieces in part], out=offsets[1:])
        fields = zip(*(p for _, pieces in part for p in _laid(pieces)))
        pieces = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(fields, PIECE)], fields=list(PIECE))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(first + i, first + i + len(part))), pa.array([used for used, _ in part], pa.int32()),
            pa.ListArray.from_arrays(pa.array(offsets), pieces), pa.array([full] * len(part))
        ], NAMES)


def _laid(pieces: list[tuple]) -> list[tuple]:
    """With the places of the pieces in their sequence."""
    at = [0, *itertools.accumulate(len(p[3]) // 4 for p in pieces)]
    return [(*p, offset) for p, offset in zip(pieces, at)]


class _Out:
    """Numbers the sequences of one task."""

    def __init__(self, rounds: int):
        self.next = (rounds << 56) | (TaskContext.get().partitionId() << 32)

    def __call__(self, found: list[tuple[int, list]], full: bool):
        first, self.next = self.next, self.next + len(found)
        yield from _batches(found, first, full)


def first_round(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    def run(batches):
        encoder, end, out = word_ids(tokenizer), struct.pack("<I", end_id), _Out(0)
        fitter, buffer, tokens = BestFit(capacity, NEARLY), [], 0

        def flush():
            nonlocal tokens
            fitter.fit(buffer)
            buffer.clear()
            tokens = 0
            done, fitter.full = fitter.full, []
            yield from out(done, True)
            yield from out(fitter.take(BUFFER), False)

        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1).to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    for piece, at in enumerate(range(0, total, capacity)):
                        cut = ids[4 * at : 4 * (at + capacity)]
                        buffer.append((len(cut) // 4, [(doc_id, piece, at, cut, total)]))
                    tokens += total
                    if len(buffer) >= BUFFER or tokens >= BUFFER * capacity:
                        yield from flush()
        yield from flush()
        yield from out(fitter.take(), False)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def next_round(items: DataFrame, nodes: int, rounds: int, capacity: int) -> DataFrame:
    """Items dealt at random (by their number, so that a task done again gets the same) to nodes, each fitted as a whole."""
    def run(batches):
        fitter, held, out = BestFit(capacity, NEARLY), [], _Out(rounds)
        for batch in batches:
            for used, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((used, [tuple(p.values())[:-1] for p in pieces]))
        fitter.fit(held)
        yield from out(fitter.full, True)
        yield from out(fitter.take(), False)

    return items.repartition(nodes, F.xxhash64("sequence_id")).select("used", "pieces").mapInArrow(run, SCHEMA)


def _written(sequences: DataFrame) -> DataFrame:
    """Written once, full and underfull ones apart, so that a round reads the latter alone."""
    spark, path = sequences.sparkSession, f"{home(sequences.sparkSession)}/{uuid.uuid4().hex}"
    sequences.write.partitionBy("full").parquet(path)
    return spark.read.schema(sequences.schema).parquet(path)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, node: int = NODE) -> DataFrame:
    """docs (doc_id, text) to pieces: doc_id, piece, start, length, ids (binary, little-endian 32-bit), doc_tokens,
    sequence_id, offset. The result reads what the rounds have written, so its ids are written once."""
    now = _written(first_round(docs, tokenizer, capacity, end_id))
    done, rounds, before = now.where("full"), 0, math.inf
    while True:
        left = now.where("not full")
        count = left.count()
        if not count or count > (1 - SAVES) * before or before <= node:
            return _pieces(done.unionByName(left))
        rounds, before = rounds + 1, count
        now = _written(next_round(left, math.ceil(count / node), rounds, capacity))
        done = done.unionByName(now.where("full"))


def _pieces(sequences: DataFrame) -> DataFrame:
    """A row for each piece."""
    return sequences.select("sequence_id", F.explode("pieces").alias("p")).select(
        "p.doc_id", "p.piece", "p.start", (F.octet_length("p.ids") / 4).cast("long").alias("length"), "p.ids",
        "p.doc_tokens", "sequence_id", "p.offset"
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "doc_tokens"
    )


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), tokenizer_path()))
