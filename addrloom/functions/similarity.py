"""String similarities as Arrow-batched functions, and the exact candidate generation that keeps them off most pairs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one; windows may hang over its ends.

    As a window moves, the letters that it has in common with the shorter string are counted; it is only compared where these
    would allow more than the best ratio so far."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n, best, common, open_ = len(short), 0.0, 0, {}
    for c in short:
        open_[c] = open_.get(c, 0) + 1
    for i in range(1 - n, len(long)):
        if i + n <= len(long) and (c := long[i + n - 1]) in open_:
            open_[c] -= 1
            common += open_[c] >= 0
        if i > 0 and (c := long[i - 1]) in open_:
            common -= open_[c] >= 0
            open_[c] += 1
        window = long[max(0, i) : i + n]
        if 200.0 * common / (n + len(window)) > best:
            best = max(best, ratio(short, window))
    return best


def difflib_score(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return max(0.0, difflib.SequenceMatcher(None, a, b).ratio() - 0.2 * abs(len(a) - len(b)) / max(len(a), len(b)))


def without_repeats(text: str) -> str:
    """Later copies of phrases of 15 to 4 letters go, the longest first.

    A look at all phrases of a length tells where each begins last, so only those that do begin again are looked for. What a
    cut joins can make phrases that were not there before: these are looked for as well."""
    if len({text[i : i + 4] for i in range(len(text) - 3)}) == len(text) - 3:
        return text
    for size in range(15, 3, -1):
        last = {text[i : i + size]: i for i in range(len(text) - size + 1)}
        if len(last) == len(text) - size + 1:
            continue
        i = 0
        while i + size <= len(text):
            phrase = text[i : i + size]
            again = text.find(phrase, i + size) if last[phrase] >= i + size else -1
            if again < 0:
                i += 1
                continue
            text = text[:again] + text[again + size :]
            for j in range(max(0, again - size + 1), min(again, len(text) - size + 1)):
                last[text[j : j + size]] = max(j, last.get(text[j : j + size], 0))
    return text


def _pairwise(f, kind):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)])

    return F.pandas_udf(run, kind)


fuzz_ratio = _pairwise(ratio, DoubleType())
partial_ratio = _pairwise(partial, DoubleType())
similarity_score = _pairwise(difflib_score, DoubleType())


@F.pandas_udf(StringType())
def dedupe_phrases(text: pd.Series) -> pd.Series:
    return text.map(without_repeats, na_action="ignore")


def _numbered(c: Column) -> Column:
    """Letters with the number of their occurrence, so that multisets meet as sets."""
    letters = F.split(c, "")
    return F.transform(
        letters, lambda x, i: F.concat(x, F.size(F.filter(F.slice(letters, 1, i + 1), lambda y: y == x)).cast("string"))
    )


def _strings(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).where(F.col(name) != "").distinct()


def _by_rarity(strings: DataFrame, name: str, often: DataFrame) -> DataFrame:
    """(name, letters): a string's numbered letters, those that the fewest strings have first."""
    rows = strings.withColumn("letter", F.explode(_numbered(F.col(name)))).join(often, "letter")
    return rows.groupBy(name).agg(
        F.array_sort(F.collect_list(F.struct("n", "letter"))).getField("letter").alias("letters")
    )


def _ranked(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    a, b = _strings(left, "a"), _strings(right, "b")
    both = a.select(F.col("a").alias("s")).unionByName(b.select(F.col("b").alias("s")))
    often = both.select(F.explode(_numbered(F.col("s"))).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    return _by_rarity(a, "a", often), _by_rarity(b, "b", often)


def _posted(rows: DataFrame, name: str, size: Column) -> DataFrame:
    """A row for each of the first `size` letters: name, letters, at, k."""
    return rows.select(
        name, F.col("letters").alias(f"letters_{name}"),
        F.posexplode(F.slice("letters", 1, size)).alias(f"at_{name}", "k")
    )


def overlapping(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Different (a, b) of left (a) and right (b) whose letters in common allow a ratio of `least`: an equi-join on the rarest
    letters, of which any such pair shares one, with bounds by length and by the letters that are left after it."""
    a, b = _ranked(left, right)
    first = lambda name: F.length(name) - F.ceil(
        F.length(name) * least / (200 - least) - 1e-9
    ).cast("int") + 1
    pairs = _posted(a, "a", first("a")).join(_posted(b, "b", first("b")), "k")
    la, lb = F.length("a"), F.length("b")
    needed = F.ceil(least * (la + lb) / 200 - 1e-9)
    pairs = pairs.where((F.least(la, lb) >= needed) & (F.least(la - F.col("at_a"), lb - F.col("at_b")) >= needed))
    return pairs.where(F.size(F.array_intersect("letters_a", "letters_b")) >= needed).select("a", "b").distinct()


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Different (a, b) of left (a) and right (b) with ratio >= least, and the ratio. No such pair is lost; no pair is formed
    without a shared letter among the rarest ones."""
    return overlapping(left, right, least).withColumn("score", fuzz_ratio("a", "b")).where(F.col("score") >= least)


def partial_candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Different (a, b) with partial ratio >= least, and that ratio. The longer string has so many of the shorter one's letters
    that one of its rarest ones is among them."""
    a, b = _ranked(left, right)
    needed = lambda c: F.ceil(F.length(c) * least / (200 - least) - 1e-9).cast("int")
    some = lambda rows, name: _posted(rows, name, F.length(name) - needed(name) + 1)
    every = lambda rows, name: _posted(rows, name, F.length(name))
    short = some(a, "a").join(every(b, "b"), "k").where(F.length("a") <= F.length("b"))
    long = every(a, "a").join(some(b, "b"), "k").where(F.length("a") > F.length("b"))
    shared = F.size(F.array_intersect("letters_a", "letters_b"))
    pairs = short.unionByName(long).where(shared >= F.least(needed("a"), needed("b"))).select("a", "b").distinct()
    return pairs.withColumn("score", partial_ratio("a", "b")).where(F.col("score") >= least)


def difflib_candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Different (a, b) with difflib's score >= least (0 to 1), and the score: its blocks are letters in common."""
    return overlapping(left, right, 100 * least).withColumn(
        "score", similarity_score("a", "b")
    ).where(F.col("score") >= least)
