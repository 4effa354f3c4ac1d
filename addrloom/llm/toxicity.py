"""Toxicity: a lexicon learned from labelled documents, matched with its misspellings, and weighed by the words around it.

Terms are whole words or stems that labelled toxic documents hold and clean ones do not. They form a trie; the Levenshtein
automaton of one edit is intersected with it lazily: a state is a set of (trie node, edits), made once per worker and kept, so
a word costs one look-up per letter until no term is in reach. Symbols between letters belong to the word, so a masked letter
is an edit like any other. Each hit, misspelled or not, is read in its window of words: inside quotation marks (that open and
close near it in its line) or next to a reporting word it counts as quoted, next to a second-person word as direct. A logistic
regression on these counts gives the score.

The model is fitted on at most ``SAMPLE`` labelled texts (those with the least hashes of their id; never held-out ones): counts
by term and features are made by the workers, the driver gets at most ``TERMS`` terms and a row of features for each text. Every
text is scored whole, however long. A null or empty text scores as one without hits. Repeated rows score alike; a text labelled
both ways counts as toxic; extra columns are ignored; without labelled rows of both kinds the lexicon is empty and every score
is the smoothed share of toxic rows. An empty table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import drop, slices, staged, staging, table

SAMPLE, TERMS, WINDOW, QUOTE, EDITS = 12_000, 20_000, 6, 40, 1
#: Shorter terms are matched as they are: at one edit, most words of two to four letters are another one.
FUZZY_LEAST = 5
STEMS = range(4, 9)
_WORD = re.compile(r"[^\W_]+(?:['’*@#$]+[^\W_]+)*|[\"“”«»„]|\n")
OPENING, MARKS = frozenset("“«„"), frozenset("\"“”«»„")
#: Words that report what others said, and words that address the reader.
REPORTING = frozenset(
    "said says say wrote quoted quote quotes reported called calls quoting cited dit écrit cité appelé sagte schrieb zitiert nannte dijo escribió citó llamó".split()
)
DIRECT = frozenset("you your yours you're u are tu te du dich vous sie usted".split())
_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})


def tokens(text: str | None) -> list[str]:
    """Words in lower case, quotation marks and line ends."""
    return [
        w.translate(_LOOKALIKE) if not w.isalpha() and any(map(str.isalpha, w)) else w
        for w in _WORD.findall(text.lower())
    ] if text else []


def context(words: list[str], i: int) -> tuple[bool, bool]:
    """Whether the word at i is quoted, and whether it is direct."""
    left, right = words[max(0, i - QUOTE) : i][::-1], words[i + 1 : i + 1 + QUOTE]
    left, right = (x[: x.index("\n")] if "\n" in x else x for x in (left, right))
    before = [w for w in left if w in MARKS]
    inside = bool(before) and not MARKS.isdisjoint(right) and (
        before[0] in OPENING or before[0] == '"' and before.count('"') % 2 == 1
    )
    around = words[max(0, i - WINDOW) : i + WINDOW + 1]
    return inside or not REPORTING.isdisjoint(around), not DIRECT.isdisjoint(around)


@dataclass
class Lexicon:
    words: list[str]
    stems: list[str]
    trie: list[dict] = field(default_factory=list)
    ends: dict = field(default_factory=dict)

    def __post_init__(self):
        self.trie = [{}]
        self.ends = defaultdict(list)
        for stem, terms in ((False, self.words), (True, self.stems)):
            for term in terms:
                node = 0
                for c in term:
                    if c not in self.trie[node]:
                        self.trie.append({})
                        self.trie[node][c] = len(self.trie) - 1
                    node = self.trie[node][c]
                self.ends[node].append((stem, len(term)))
        self.ends = dict(self.ends)
        self.letters = {c for node in self.trie for c in node}
        self.reset()

    def reset(self):
        self.number, self.sets, self.moves, self.found = {}, [], [], []
        self.start = self._state(self._closed({0: 0}))

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems}

    def __setstate__(self, state):
        self.__init__(state["words"], state["stems"])

    def _closed(self, places: dict) -> dict:
        """With the letters of a term that the text leaves out."""
        todo = list(places.items())
        while todo:
            node, edits = todo.pop()
            if edits < EDITS:
                for child in self.trie[node].values():
                    if places.get(child, EDITS + 1) > edits + 1:
                        places[child] = edits + 1
                        todo.append((child, edits + 1))
        return places

    def _state(self, places: dict) -> int:
        key = frozenset(places.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(places)
            self.moves.append({})
            ends = [
                (stem, edits) for node, edits in places.items() for stem,
                size in self.ends.get(node, ()) if edits == 0 or size >= FUZZY_LEAST
            ]
            self.found.append(
                (min((e for s, e in ends if not s), default=9), min((e for s, e in ends if s), default=9))
            )
        return self.number[key]

    def _move(self, state: int, letter: str) -> int:
        places: dict[int, int] = {}
        for node, edits in self.sets[state].items():
            for c, child in self.trie[node].items():
                cost = edits + (c != letter)
                if cost <= EDITS and cost < places.get(child, 9):
                    places[child] = cost
            if edits < EDITS and edits + 1 < places.get(node, 9):
                places[node] = edits + 1
        to = self._state(self._closed(places)) if places else -1
        self.moves[state][letter] = to
        return to

    def match(self, word: str) -> tuple[int, int]:
        """(edits to the nearest word, edits to the nearest stem at the start), 9 if none is in reach."""
        if len(self.sets) > 50_000:
            self.reset()
        state, stem = self.start, 9
        for letter in word:
            letter = letter if letter in self.letters else "\0"
            to = self.moves[state].get(letter)
            state = self._move(state, letter) if to is None else to
            if state < 0:
                return 9, stem
            stem = min(stem, self.found[state][1])
        return self.found[state][0], stem


FEATURES = [
    "exact", "stem", "fuzzy", "fuzzy_stem", "quoted", "direct", "quoted_fuzzy", "direct_fuzzy", "exact_share", "any"
]


class Scorer:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None = None, bias: float = 0.0):
        self.lexicon, self.weights, self.bias, self.known = lexicon, weights, bias, {}

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights, "bias": self.bias, "known": {}}

    def features(self, text: str | None) -> np.ndarray:
        words = tokens(text)
        known, match = self.known, self.lexicon.match
        if len(known) > 500_000:
            known.clear()
        counts = Counter()
        for word in set(words).difference(known):
            a, b = match(word)
            known[word] = 1 if a == 0 else 2 if b == 0 else 3 if a == 1 else 4 if b == 1 else 0
        for i in [i for i, word in enumerate(words) if known[word]]:
            kind = known[words[i]]
            quoted, direct = context(words, i)
            counts[kind] += 1
            counts["quoted" if kind <= 2 else "quoted_fuzzy"] += quoted
            counts["direct" if kind <= 2 else "direct_fuzzy"] += direct
        strong = counts[1] + counts[2]
        logs = [np.log1p(counts[c]) for c in (1, 2, 3, 4, "quoted", "direct", "quoted_fuzzy", "direct_fuzzy")]
        return np.array([*logs, min(1.0, 20 * strong / (len(words) + 20)), float(strong > 0)])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights + self.bias, -30, 30))))


def _terms(batches):
    """(kind, term, toxic, n): in how many texts of a task a word (w) or a start of words (s) occurs, by label."""
    counts: Counter = Counter()
    for batch in slices(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w for w in tokens(text) if len(w) >= 3 and w.isalpha()}
            counts.update(("w", w, toxic) for w in words)
            counts.update(("s", s, toxic) for s in {w[:k] for w in words for k in STEMS if len(w) > k})
    rows = list(counts)
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        kinds, terms, toxic = zip(*part)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kinds), pa.array(terms), pa.array(toxic, pa.int32()),
                pa.array([counts[x] for x in part], pa.int64())
            ],
            ["kind", "term", "toxic", "n"]
        )


def lexicon_of(texts: DataFrame, toxic: int) -> Lexicon:
    """Of (text, toxic) rows: terms that many toxic texts hold and hardly any clean one; stems are starts of four different words
    or more, the shortest that tells, and take the place of the words that begin with them."""
    enough = max(4, toxic // 40)
    n = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0))
    terms = staged(
        texts.mapInArrow(
            _terms, "kind string, term string, toxic int, n long"
        ).groupBy("kind", "term").agg(n(1).alias("bad"), n(0).alias("good")).where("bad > 0")
    )
    starts = F.explode(F.array(*(F.when(F.length("term") > k, F.substring("term", 1, k)) for k in STEMS)))
    tails = terms.where("kind = 'w'").select(starts.alias("start")).where("start is not null").groupBy("start").agg(
        F.count("*").alias("tails")
    ).where("tails >= 4")
    telling = terms.where(
        (F.col("bad") >= enough) & (F.col("bad") >= 30 * F.col("good") + F.when(F.col("good") > 0, enough).otherwise(0))
    )
    telling = telling.join(
        tails, (F.col("kind") == "s") & (F.col("term") == F.col("start")), "left"
    ).where("kind = 'w' or tails is not null")
    found = telling.orderBy(F.col("bad").desc(), "kind", "term").limit(TERMS).select("kind", "term").collect()
    stems: list[str] = []
    for s in sorted((r.term for r in found if r.kind == "s"), key=lambda t: (len(t), t)):
        if not any(s.startswith(x) for x in stems):
            stems.append(s)
    return Lexicon(
        sorted(r.term for r in found if r.kind == "w" and not any(r.term.startswith(x) for x in stems)), stems
    )


def regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's steps with a small ridge; without both labels, the smoothed share alone."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    weights, bias = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    for _ in range(60 if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
        full = np.column_stack([x, np.ones(len(x))])
        gradient = full.T @ (p - y) + 1e-1 * np.append(weights, 0)
        hessian = (full * (p * (1 - p))[:, None]).T @ full + np.diag([1e-1] * len(weights) + [1e-6])
        step = np.linalg.solve(hessian, gradient)
        weights, bias = weights - np.clip(step[:-1], -2, 2), bias - float(np.clip(step[-1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return weights, bias


def held_out(key):
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Scorer:
    """On at most `most` different labelled texts that are not held out."""
    spark = docs.sparkSession
    kept = labels.where(
        F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))
    ).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = kept.where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_id")
    ).where("text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # Ids that occur more than once could bring more texts than ids: the least hashes count. Only hashes meet in one task.
    kept = F.broadcast(rows.select(F.col("h").alias("kept")).distinct().orderBy("kept").limit(most))
    one = rows.join(kept, F.col("h") == F.col("kept"), "left_semi").groupBy("h")
    with staging(spark) as folder:
        texts = staged(one.agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("h").repartition(64))
        toxic = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0))).first()[0]
        scorer = Scorer(lexicon_of(texts, toxic))
        held = spark.sparkContext.broadcast(scorer)

        def run(batches):
            for batch in slices(batches):
                made = [held.value.features(t).tolist() for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"]
                )

        got = texts.mapInArrow(run, "x array<double>, toxic int").toArrow()
    drop(spark, folder)
    x, y = np.array(
        got.column("x").to_pylist()
    ).reshape(-1, len(FEATURES)), got.column("toxic").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # sums of doubles hang on their order
    scorer.weights, scorer.bias = regression(x[order], y[order])
    return scorer


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score for each row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([held.value.score(t) for t in texts], pa.float64())], ["doc_id", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return made.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
