"""Substring dedup: words covered by a window of `least` consecutive words that also starts anywhere else are removed.

Two operators. ``strip_references`` streams documents through broadcast suffix automata of a bounded set of reference texts
and removes maximal matching spans. ``repeated_spans`` / ``dedup`` treat the corpus itself as the reference, where automata
of all shards would have to reach all documents: there every window has an anchor (the least of its 16-word hashes, which
equal windows choose alike), the windows between two anchors form a run, and runs are counted by content. Only windows of
runs whose anchor recurs but whose content does not are counted one by one. Counting combines map-side, so a passage in a
third of all documents costs no task more than its map tasks' partial counts.

Windows are judged on the input. A null, empty or short text loses nothing; a text is read whole, however long; equal rows are
each other's repetition, and so are tied ones (all of them lose the words); a null doc_id is a document like any other; an
empty table gives no row. Extra columns are kept, whatever their names: where kept_text, n_words, n_removed or spans is taken,
the added column gets an underscore before its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bloom_of, carrying, column, finished, free_names, hash_words, int64_lists, keep_only, mix, signed, rows_held, slices, staged, table, without_held, words_of

ANCHOR = 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        size = max(1 << 12, 2 * n)
        found = np.full(size, base, np.uint64)
        found[0] = 1
        _powers[base] = found = np.multiply.accumulate(found)
    return found[:n]


class Ranges:
    """Hashes of any range of a document's words in constant time."""

    def __init__(self, words: list[bytes]):
        hashes = hash_words(words)
        self.n = len(words)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * _power(_BASE, self.n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(
            (self.sums[end] - self.sums[start]) * _power(_INVERSE, self.n + 1)[start] + (end - start).astype(np.uint64)
        )


def runs(ranges: Ranges, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each run of windows with the same anchor."""
    starts = np.arange(ranges.n - ANCHOR + 1)
    hashes = ranges.of(starts, starts + ANCHOR)
    width = least - ANCHOR + 1
    low = np.lib.stride_tricks.sliding_window_view(hashes, width).argmin(axis=1) + np.arange(len(hashes) - width + 1)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return hashes[low[first]], first, np.diff(np.append(first, len(low)))


def _anchors(least: int):
    def run(batches):
        keep_only("hashes")
        for batch in slices(batches):
            out = []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                out.append(signed(runs(Ranges(words), least)[0]) if len(words) >= least else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([int64_lists(out)], ["anchor"])

    return run


def _runs(least: int, wanted):
    def run(batches):
        keep_only("hashes")
        for batch in slices(batches):
            at, ctx, ws, size, windows = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = words_of(text)
                if len(words) < least:
                    continue
                ranges = Ranges(words)
                anchor, first, count = runs(ranges, least)
                held = np.flatnonzero(wanted.value.holds(signed(anchor)))
                if not len(held):
                    continue
                first, count = first[held], count[held]
                at.append(np.full(len(held), i))
                ctx.append(signed(ranges.of(first, first + count + least - 1)))
                ws.append(first)
                size.append(count)
                inner = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                windows.append(signed(ranges.of(inner, inner + least)))
            if not at:
                continue
            size = np.concatenate(size)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            rows = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(ctx)),
                    pa.array(np.concatenate(ws).astype(np.int32)), pa.array(size.astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(windows)))
                ],
                ["doc_id", "rk", "ctx", "first", "size", "windows"]
            )

    return run


def repeated_spans(docs: DataFrame, least: int = 35) -> DataFrame:
    """(doc_id, rk, first, size): runs of windows, by first window and number, that occur elsewhere; docs has doc_id, rk, text."""
    anchors = docs.select("text").mapInArrow(
        _anchors(least), "anchor array<long>"
    ).select(F.explode("anchor").alias("anchor"))
    often = bloom_of(anchors.groupBy("anchor").count().where("count > 1").select("anchor"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = staged(
        docs.select("doc_id", "rk", "text").mapInArrow(
            _runs(least, often), f"doc_id {kind}, rk long, ctx long, first int, size int, windows array<long>"
        ),
        heavy=True
    )
    place = F.struct("doc_id", "rk", "first", "windows")
    distinct = staged(
        found.groupBy("ctx").agg(
            F.count("*").alias("n"), F.min_by(place, F.struct("rk", "first")).alias("at")
        ).select("ctx", "n", "at.*"),
        heavy=True
    )
    whole = distinct.where("n > 1").select(F.col("ctx").cast("string").alias("c"))
    whole = found.select(
        "doc_id", "rk", "first", "size", F.col("ctx").cast("string").alias("c0")
    ).join(whole, F.col("c0") == F.col("c")).select("doc_id", "rk", "first", "size")
    windows = distinct.select(F.explode("windows").alias("w"), F.least("n", F.lit(2)).alias("n"))
    twice = windows.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("w").cast("string").alias("w2"))
    alone = distinct.where("n = 1").select("doc_id", "rk", "first", F.posexplode("windows").alias("i", "w"))
    parts = alone.join(twice, F.col("w").cast("string") == F.col("w2")).select(
        "doc_id", "rk", (F.col("first") + F.col("i")).cast("int").alias("first"), F.lit(1).alias("size")
    )
    return whole.unionByName(parts)


def _cut(least: int, whole=None, joined: bool = True):
    """Cuts the spans (firsts, sizes) out of texts; with a filter, of the rows that it does not hold, which have none. What is
    kept is joined by spaces; if not `joined`, a text that loses nothing stays as it is."""
    def run(batches):
        keep_only("hashes")
        for batch in slices(without_held(batches, whole) if whole else batches):
            texts, n_words, n_removed, spans = [], [], [], []
            none = [None] * len(batch)
            places = (none, none) if whole else (batch.column("firsts").to_pylist(), batch.column("sizes").to_pylist())
            for text, firsts, sizes in zip(batch.column("text").to_pylist(), *places):
                words, cover, found = words_of(text), None, []
                if firsts:
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, firsts, 1)
                    np.add.at(edge, np.array(firsts) + np.array(sizes) + least - 1, -1)
                    cover = np.cumsum(edge[:-1]) > 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
                    found = [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])]
                n_words.append(len(words))
                n_removed.append(int(cover.sum()) if firsts else 0)
                if cover is None and not joined:
                    texts.append(text)
                else:
                    kept = words if cover is None else [w for w, c in zip(words, cover.tolist()) if not c]
                    texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                spans.append(found)
            spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()), spans
                ],
                ["row", *ADDED]
            )

    return run


ADDED = ["kept_text", "n_words", "n_removed", "spans"]
_KINDS = "kept_text string, n_words long, n_removed long, spans array<struct<start:int,end:int>>"


def _removed(docs: DataFrame, least: int, joined: bool = True) -> DataFrame:
    """row (all columns but the text in one, so that a text is carried once) and what is added."""
    carried = [column(c) for c in docs.columns if c != "text"]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", "text", F.struct(*carried).alias("row"))
    # Equal rows have the same spans: each span is gathered once, however often its row occurs.
    found = repeated_spans(keyed.select("rk", "doc_id", "text"), least)
    per = found.groupBy("rk", "doc_id").agg(F.collect_set(F.struct("first", "size")).alias("x")).select(
        F.col("rk").alias("k"), F.col("doc_id").alias("d"), F.col("x.first").alias("firsts"),
        F.col("x.size").alias("sizes")
    )
    per = staged(per, heavy=True)
    touched = bloom_of(per.select("k"))
    met = rows_held(keyed, touched).join(
        per, (F.col("rk") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left"
    ).select("row", "text", "firsts", "sizes")
    made = carrying(keyed.schema["row"].dataType, _KINDS)
    return met.mapInArrow(_cut(least, joined=joined), made).unionByName(
        keyed.select("rk", "text", "row").mapInArrow(_cut(least, touched, joined), made)
    )


def dedup(docs: DataFrame, least: int = 35) -> DataFrame:
    """The other columns of docs with kept_text (kept words joined by a space), n_words, n_removed and spans (removed ranges)."""
    columns = [c for c in docs.columns if c != "text"]
    own = [F.col(a).alias(free) for a, free in zip(ADDED, free_names(ADDED, columns))]
    return _removed(docs, least).select(*(F.col("row").getField(c).alias(c) for c in columns), *own)


def deduped_documents(docs: DataFrame, least: int = 35) -> DataFrame:
    """The same columns as docs; a text that loses nothing stays as it is (n_chars follows the texts)."""
    own = lambda c: F.col("row").getField(c)
    cut = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long"))
    return _removed(docs, least, joined=False).select(
        *(
            F.col("kept_text").alias(c) if c == "text" else cut.otherwise(own(c)).alias(c) if c == "n_chars"
            else own(c).alias(c) for c in docs.columns
        )
    )


class SuffixAutomaton:
    """Of several word sequences, one after the other (a match never runs over a sequence's end)."""

    def __init__(self, sequences):
        self.next, self.link, self.length = [{}], [-1], [0]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)

    def _new(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word) -> int:
        if (q := self.next[last].get(word)) is not None:  # the sequence so far is a substring of an earlier one
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def matching(self, words) -> list[int]:
        """For each word, the length of the longest reference substring that ends there."""
        state, size, out = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if (to := self.next[state].get(word)) is not None:
                state, size = to, size + 1
            out.append(size)
        return out


def strip_references(
    docs: DataFrame, references: DataFrame, least: int = 35, shard_words: int = 50_000, most_words: int = 2_000_000
) -> DataFrame:
    """docs (doc_id, text) with kept_text, n_words, n_removed, spans: maximal spans of at least `least` words that occur in a
    reference text are removed. References are read up to most_words words; beyond it this raises, as automata are broadcast."""
    shards, size = [[]], 0
    total = references.select(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if total > most_words:
        raise ValueError(f"references have {total} words; at most {most_words} are broadcast")
    for (text,) in references.select("text").toLocalIterator():
        words = words_of(text)
        if size + len(words) > shard_words and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(words)
        size += len(words)
    automata = docs.sparkSession.sparkContext.broadcast([SuffixAutomaton(s) for s in shards])

    def spans(batches):
        cut = _cut(least)

        def fed():
            for batch in batches:
                firsts, sizes = [], []
                for text in batch.column("text").to_pylist():
                    words, ends = words_of(text), set()
                    for automaton in automata.value:
                        ends.update(i for i, m in enumerate(automaton.matching(words)) if m >= least)
                    firsts.append([i - least + 1 for i in sorted(ends)])
                    sizes.append([1] * len(ends))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"), batch.column("text"), pa.array(firsts, pa.list_(pa.int32())),
                        pa.array(sizes, pa.list_(pa.int32()))
                    ],
                    ["row", "text", "firsts", "sizes"]
                )

        yield from cut(fed())

    rows = docs.select(F.struct("doc_id").alias("row"), "text")
    made = rows.mapInArrow(spans, carrying(rows.schema["row"].dataType, _KINDS))
    return made.select("row.doc_id", *ADDED)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return finished(
        spark,
        lambda: dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
c AS (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(w[i : i + 34], ' ')) AS times FROM g),
h AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM c WHERE times > 1),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT u.r, string_agg(x, ' ' ORDER BY u.i) FILTER (h.i IS NULL) AS kept, count(h.i) AS n_removed FROM u LEFT JOIN h ON u.r = h.r AND u.i = h.i GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
