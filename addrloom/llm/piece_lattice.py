"""SentencePiece encoding and decoding over a piece table.

A text becomes units (white space marks with the letters that follow them; no piece crosses from a letter to a mark). All
units go through a lattice. For the most frequent ones, whose ids all tasks hold, it is relational: their substrings of bounded
length are exploded and equi-joined to the piece table, the edges that match are grouped by unit, and a higher-order aggregate
folds them. With a unigram table the fold is Viterbi. The table at hand is of the BPE kind, for which the best sum of scores is
not what its tokenizer gives; there the fold applies merges, best score first, leftmost on ties, until no edge joins two
neighbours. All other units get the same lattice in the task that meets them, by arrays: every span of theirs meets the piece
table, and the same merges fold its edges. Letters without a piece become byte pieces.

A null text has no ids, an empty one none either; texts and units are encoded whole, however long; repeated rows are encoded
alike; ties of scores go to the leftmost edge; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import re
import struct
import uuid
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import caches, drop, keep_only, mix, slices, staged, staging, table

MARK, VOCABULARY, UNIT_MOST = "▁", 50_000, 24
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHE = 400_000


class Pieces:
    """Piece table: (piece, id, score) of normal pieces, ids of byte pieces, and the kind of model."""

    def __init__(self, rows: list[tuple[str, int, float]], byte_ids: list[int], unknown: int, kind: str = "bpe"):
        self.rows, self.byte_ids, self.unknown, self.kind = rows, byte_ids, unknown, kind
        self.longest = max((len(p) for p, _, _ in rows), default=1)
        self.known = {p: (i, s) for p, i, s in rows}
        self.bytes_of = {i: p.encode() for p, i, _ in rows} | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    @staticmethod
    def load(path: str) -> "Pieces":
        """From a model file of the BPE kind with byte fallback."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [
            i for i in range(p.get_piece_size())
            if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i))
        ]
        return Pieces(
            [(p.id_to_piece(i), i, p.get_score(i)) for i in ids], [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
            p.unk_id()
        )

    def letters(self, text: str) -> list[int]:
        found = self.known.get(text)
        return [found[0]] if found else [
            self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")
        ] if self.byte_ids else [self.unknown]

    def cut(self, unit: str) -> list[int]:
        """Ends of the unit's pieces."""
        n, known = len(unit), self.known
        if self.kind == "unigram":
            worst = min((s for _, s in known.values()), default=0.0) - 10
            best = [(0.0, 0)] + [(float("-inf"), 0)] * n
            for e in range(1, n + 1):
                for s in range(max(0, e - self.longest), e):
                    score = known[unit[s:e]][1] if unit[s:e] in known else worst if e - s == 1 else None
                    if score is not None and best[s][0] + score > best[e][0]:
                        best[e] = (best[s][0] + score, s)
            ends, e = [], n
            while e:
                ends.append(e)
                e = best[e][1]
            return ends[::-1]
        ends = list(range(n + 1))
        while len(ends) > 2:
            found = [(-known[x][1], i) for i in range(len(ends) - 2) if (x := unit[ends[i] : ends[i + 2]]) in known]
            if not found:
                break
            del ends[min(found)[1] + 1]
        return ends[1:]

    def encode(self, unit: str) -> list[int]:
        out, start = [], 0
        for end in self.cut(unit):
            out += self.letters(unit[start:end])
            start = end
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(self.bytes_of.get(i, b"") for i in ids).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class Lattice:
    """The lattice of many units at once, by arrays in a task: their spans meet the piece table by hash, and letter by letter where
    a hash is met, and the edges found are folded by merges. A round takes the best edge of each unit; a unit of more than LONG
    letters, which takes as many rounds, gets its merges from a queue instead."""

    LONG, LETTERS = 64, 1 << 15

    def __init__(self, pieces: Pieces):
        self.pieces, rows = pieces, [row for row in pieces.rows if len(row[0]) > 1]
        text = _codes("".join(p for p, _, _ in rows))
        self.text, self.size = text, np.array([0, *(len(p) for p, _, _ in rows)], np.int64)  # the first row is none
        self.at = np.concatenate([[0, 0], np.cumsum(self.size[1:])])[:-1]
        self.id = np.array([0, *(i for _, i, _ in rows)], np.int64)
        order = {s: k for k, s in enumerate(sorted({s for _, _, s in rows}, reverse=True))}
        self.order = np.array([0, *(order[s] for _, _, s in rows)], np.int64)
        self.letter = np.full(0x110000, -1, np.int32)
        for p, i, _ in pieces.rows:
            if len(p) == 1:
                self.letter[ord(p)] = i
        self.power = self.inverse = np.ones(1, np.uint64)
        sums = self._sums(text)
        self.hash = (sums[self.at + self.size] - sums[self.at]) * self.inverse[self.at]
        self.tables, self.next = {}, np.zeros(len(self.size), np.int32)
        for n in set(self.size[1:].tolist()):  # by length: from a hash's first bits to a piece, and on to others with these bits
            own = np.flatnonzero(self.size == n)
            shift = np.uint64(64 - max(6, (len(own) * 16).bit_length()))
            table = np.zeros(1 << (64 - int(shift)), np.int32)
            for piece, slot in zip(own.tolist(), (self.hash[own] >> shift).tolist()):
                self.next[piece], table[slot] = table[slot], piece
            self.tables[n] = shift, table
        self.bare: dict[int, np.ndarray] = {}

    def _sums(self, codes: np.ndarray) -> np.ndarray:
        """Sums of letters times powers, up to each place; a span's difference over the power of its start is its hash."""
        if len(self.power) <= len(codes):
            n = max(len(codes) + 1, self.LETTERS)
            self.power, self.inverse = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]))
                for x in (_BASE, pow(_BASE, -1, 1 << 64))
            )
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64)) * self.power[: len(codes)])])

    def edges(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all spans of two letters or more that are pieces; ends: where each letter's unit ends."""
        sums, starts, found = self._sums(codes), np.arange(len(codes)), [(np.zeros(0, np.int64),) * 3]
        room = ends - starts
        for n in range(2, self.pieces.longest + 1):
            left = np.flatnonzero(room >= n)
            starts, room, letters = starts[left], room[left], np.arange(n)
            if n not in self.tables:
                continue
            shift, table = self.tables[n]
            hashes = (sums[starts + n] - sums[starts]) * self.inverse[starts]
            piece = table[hashes >> shift]
            hit = np.flatnonzero(piece)
            s, piece, hashes = starts[hit], piece[hit], hashes[hit]
            while len(piece):
                met = np.flatnonzero(self.hash[piece] == hashes)
                at, own = s[met], piece[met]
                same = (codes[at[:, None] + letters] == self.text[self.at[own][:, None] + letters]).all(1)
                found.append((at[same], at[same] + n, own[same]))
                piece = self.next[piece]
                more = np.flatnonzero(piece)
                s, piece, hashes = s[more], piece[more], hashes[more]
        return tuple(np.concatenate(x) for x in zip(*found))

    def fold(self, codes: np.ndarray, ends: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places are boundaries once no edge joins two neighbours, and the id of the piece that starts at each."""
        open_, ids = np.ones(len(codes) + 1, bool), self.letter[codes]
        s, e, piece = self.edges(codes, ends)
        u, key = unit[s], self.order[piece] << 32 | s
        best = np.empty(unit[-1] + 1, np.int64)
        while True:
            counts = np.cumsum(open_)
            inside = counts[e] - counts[s]
            near = np.flatnonzero(inside == 2)
            if not len(near):
                return open_, ids
            best.fill(np.iinfo(np.int64).max)
            np.minimum.at(best, u[near], key[near])
            near = near[key[near] == best[u[near]]]
            ids[s[near]] = self.id[piece[near]]
            open_[np.flatnonzero(open_)[counts[s[near]]]] = False
            left = np.flatnonzero(open_[s] & open_[e] & (inside > 1))
            s, e, piece, u, key = s[left], e[left], piece[left], u[left], key[left]

    def fold_long(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for a single unit: edges wait in a queue from when they join two neighbours."""
        n, ids = len(codes), self.letter[codes]
        s, e, piece = self.edges(codes, np.full(n, n))
        known = {(i, j): (k, p) for i, j, k, p in zip(s.tolist(), e.tolist(), self.order[piece].tolist(), piece.tolist())}
        after, before, queue = list(range(1, n + 2)), list(range(-1, n)), []

        def joins(i):
            if 0 <= i and after[i] < n and (i, j := after[after[i]]) in known:
                heapq.heappush(queue, (known[i, j][0], i, j))

        open_ = np.ones(n + 1, bool)
        for i in range(n):
            joins(i)
        while queue:
            _, i, j = heapq.heappop(queue)
            if open_[i] and open_[j] and after[i] < j and after[after[i]] == j:
                open_[after[i]], after[i], before[j], ids[i] = False, j, i, self.id[known[i, j][1]]
                joins(i)
                joins(before[i])
        return open_, ids

    def _bare(self, code: int) -> np.ndarray:
        if code not in self.bare:
            self.bare[code] = np.array(self.pieces.letters(chr(code)), np.int32)
        return self.bare[code]

    def encode(self, units: list[str]) -> list[bytes]:
        """Packed ids of the units, in order."""
        out: list[bytes] = [b""] * len(units)
        sizes = np.array([len(u) for u in units], np.int64)
        order = np.argsort(sizes, kind="stable")
        total = np.cumsum(sizes[order])
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + self.LETTERS, "right")))
            if sizes[order[at]] <= self.LONG < sizes[order[to - 1]]:
                to = at + int(np.searchsorted(sizes[order[at:to]], self.LONG, "right"))
            elif sizes[order[at]] > self.LONG:
                to = at + 1
            group = order[at:to]
            at, size = to, sizes[group]
            codes, last = _codes("".join([units[i] for i in group.tolist()])), np.cumsum(size)
            if size[0] > self.LONG:
                open_, ids = self.fold_long(codes)
            else:
                open_, ids = self.fold(codes, np.repeat(last, size), np.repeat(np.arange(len(group)), size))
            places = np.flatnonzero(open_[:-1])
            ids, bounds = ids[places], np.concatenate([[0], np.searchsorted(places, last)])
            if len(bare := np.flatnonzero(ids < 0)):  # letters without a piece
                instead = [self._bare(x) for x in codes[places[bare]].tolist()]
                more = np.ones(len(ids), np.int64)
                more[bare] = [len(x) for x in instead]
                at_ids = np.concatenate([[0], np.cumsum(more)])
                ids, bounds = np.repeat(ids, more), at_ids[bounds]
                ids[np.repeat(at_ids[bare], more[bare]) + np.concatenate([np.arange(len(x)) for x in instead])] = np.concatenate(instead)
            packed, bounds = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
            for i, start, end in zip(group.tolist(), bounds, bounds[1:]):
                out[i] = packed[start:end]
        return out


_BASE = 0x9E3779B97F4A7C15


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def units(text: str | None) -> list[str]:
    return _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def frequent(docs: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """(unit, n): the units of at most UNIT_MOST letters that occur most often, all occurrences counted. The relational fold takes a
    unit's steps one by one, so it is for short ones; units that are not among these get the lattice of their task."""
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(units(text))
            rows = [(u, n) for u, n in counts.items() if len(u) <= UNIT_MOST]
            yield pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["unit", "n"]
            )

    counted = docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    # Every task hands as many rows as are wanted to the last one, so those that cannot be among them go first.
    counted, held = staged(counted.withColumn("size", F.floor(F.log2("n") * 8))), 0
    for size, units_ in sorted(counted.groupBy("size").agg(F.count("*")).collect(), reverse=True):
        held += units_
        if held >= most:
            counted = counted.where(F.col("size") >= size)
            break
    return counted.drop("size").orderBy(F.col("n").desc(), "unit").limit(most)


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ends): where the pieces of each different unit end, by the relational lattice."""
    spark = words.sparkSession
    known = F.broadcast(spark.createDataFrame([(p, float(s)) for p, _, s in pieces.rows], "piece string, score double"))
    size = F.length("unit")
    starts = words.select("unit").distinct().withColumn("n", size).withColumn(
        "s", F.explode(F.sequence(F.lit(0), size - 1))
    )
    spans = starts.withColumn(
        "e", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("n"), F.col("s") + pieces.longest)))
    )
    spans = spans.withColumn("piece", F.expr("substring(unit, s + 1, e - s)"))
    edges = spans.join(known, "piece").groupBy("unit", "n").agg(
        F.collect_list(F.struct(F.col("score"), F.col("s"), F.col("e"))).alias("edges")
    )
    # A unit of which no substring is a piece has no edge, and is cut letter by letter below.
    edges = words.select("unit").distinct().join(
        edges.select(F.col("unit").alias("u"), "edges"), F.col("unit") == F.col("u"), "left"
    ).select(
        "unit", F.length("unit").alias("n"),
        F.coalesce("edges", F.expr("cast(array() as array<struct<score:double,s:int,e:int>>)")).alias("edges")
    )
    if pieces.kind == "unigram":
        worst = min((s for _, _, s in pieces.rows), default=0.0) - 10
        fold = f"""aggregate(sequence(1, n), array(struct(0D as score, cast(array() as array<int>) as ends)), (best, e) -> array_append(best,
            struct_best(best, e)))"""
        step = f"""array_max(transform(concat(filter(edges, x -> x.e = e), array(struct({worst}D as score, e - 1 as s, e as e))),
            x -> struct(element_at(best, x.s + 1).score + x.score as score, array_append(element_at(best, x.s + 1).ends, e) as ends)))"""
        return edges.select(
            "unit", F.expr(f"element_at({fold.replace('struct_best(best, e)', step)}, -1).ends").alias("ends")
        )
    # A merge is an edge between two boundaries with exactly one boundary inside; the best score goes first, then the leftmost.
    open_edges = "filter(edges, x -> array_contains(b, x.s) and array_contains(b, x.e) and size(filter(b, y -> y > x.s and y < x.e)) = 1)"
    best = f"array_min(transform({open_edges}, x -> struct(-x.score as k, x.s as s, x.e as e)))"
    fold = f"aggregate(sequence(1, n), sequence(0, n), (b, i) -> coalesce(transform(array({best}), m -> case when m is null then b else filter(b, y -> y <= m.s or y >= m.e) end)[0], b))"
    return edges.select("unit", F.expr(f"filter({fold}, y -> y > 0)").alias("ends"))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encode(docs: DataFrame, pieces: Pieces, vocabulary: int = VOCABULARY) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit), n_ids, exact (decoding gives the text back) for docs (doc_id, text)."""
    spark, table_ = docs.sparkSession, {}
    with staging(spark) as folder:  # a bounded vocabulary, counted once
        found = lattice(staged(frequent(docs, vocabulary)), pieces).select("unit", "ends").toArrow()
    drop(spark, folder)
    for unit, ends in zip(found.column("unit").to_pylist(), found.column("ends").to_pylist()):
        start, ids = 0, []
        for end in ends:
            ids += pieces.letters(unit[start:end])
            start = end
        table_[unit] = _packed(ids)
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, pieces, table_))

    def run(batches):
        known = unit_ids(held)
        for batch in slices(batches):
            ids, exact = [], []
            for group in _groups(batch.column(1).to_pylist()):
                known.learn({unit for _, parts in group for unit in parts})
                for text, parts in group:
                    ids.append(known.ids(parts))
                    exact.append(None if text is None else known.exact(text, parts, ids[-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(exact, pa.bool_())
                ],
                ["doc_id", "ids", "n_ids", "exact"]
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, n_ids long, exact boolean"
    )


def _groups(texts: list[str | None], most: int = 50_000):
    """Lists of (text, units), each of so many units or one text more."""
    group, n = [], 0
    for text in texts:
        group.append((text, units(text)))
        n += len(group[-1][1])
        if n >= most:
            yield group
            group, n = [], 0
    if group:
        yield group


class UnitIds:
    """Packed ids of units, kept up to a bound; and which units do not decode to themselves."""

    def __init__(self, pieces: Pieces, hot: dict[str, bytes]):
        self.pieces, self.hot, self.seen, self.changed = pieces, hot, dict(hot), set()
        self.lattice = Lattice(pieces) if pieces.kind == "bpe" else None
        for unit, ids in hot.items():
            self.check(unit, ids)

    def check(self, unit: str, ids: bytes) -> None:
        if b"".join(
            map(self.pieces.bytes_of.get, memoryview(ids).cast("I"), repeat(b""))
        ) != unit.encode("utf-8", "surrogatepass"):
            self.changed.add(unit)

    def learn(self, units: set[str]) -> None:
        fresh = list(units.difference(self.seen))
        if len(self.seen) + len(fresh) > CACHE + len(self.hot):
            self.seen = dict(self.hot)
            self.changed.intersection_update(self.seen)
            fresh = list(units.difference(self.seen))
        made = self.lattice.encode(fresh) if self.lattice else [_packed(self.pieces.encode(unit)) for unit in fresh]
        for unit, ids in zip(fresh, made):
            self.seen[unit] = ids
            self.check(unit, ids)

    def ids(self, parts: list[str]) -> bytes:
        """Of units that were learned last."""
        return b"".join(map(self.seen.__getitem__, parts))

    def exact(self, text: str, parts: list[str], ids: bytes) -> bool:
        """Whether decoding gives the text: it does where every unit decodes to itself and no letter stands for white space."""
        if self.changed and not self.changed.isdisjoint(parts):
            return self.pieces.decode(memoryview(ids).cast("I").tolist()) == text
        return MARK not in text


_known: dict[str, UnitIds] = caches.setdefault("pieces", {})


def unit_ids(held) -> UnitIds:
    """The worker's own for a broadcast table, kept from task to task."""
    keep_only("pieces")
    key, pieces, hot = held.value
    if key not in _known:
        _known.clear()
        _known[key] = UnitIds(pieces, hot)
    return _known[key]


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, text for encoded (doc_id, ids)."""
    held = encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        for batch in batches:
            texts = [
                None if x is None else held.value.decode(memoryview(x).cast("I").tolist())
                for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string"
    )


def op9_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = encode(table(spark, sf_dir, "documents"), Pieces.load(str(public_tokenizers.path("piece_bpe_32k.model"))))
    return made.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), "exact")
