"""Rule bitmask ledger: every rule is evaluated once per document; failures are bits beside the measurements they rest on.

Policies are versioned masks over the bits: applying another policy, or asking what would be kept without some rule, reads
the ledger alone and never the texts again. Ablations are bitwise aggregates over the bits, combined map-side.

A null, empty or blank text has no words and fails the base; repeated rows get a row each and fare alike; measurements use the
whole text, however long; an empty table gives no row. ``ledger`` ignores extra columns, ``kept_documents`` keeps them, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import carrying, column, keep_only, slices, table, words_of

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_table_words",
    "n_distinct_words"
]
_SYMBOL = b"#*$%&|<>"


#: name -> failed when; over the measurements. Bit i of a ledger is the i-th rule.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "shouting": "2 * n_upper_words > n_words",
    "table_junk": "10 * n_table_words > n_words",
    "dup_lines": "n_lines > 3 and 10 * n_dup_lines > 3 * n_lines",
    "mean_word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    # A tenth of the words; beyond 2000 words the least number of different ones grows with the square root of the length.
    "low_diversity": "n_words >= 50 and 10 * n_distinct_words < n_words and n_distinct_words * n_distinct_words < 20 * n_words",
}
BASE = ["few_words", "repeated_words"]
#: version -> rules that count. A version is never changed once ledgers have been judged by it.
POLICIES = {"base-1": BASE, "strict-2": list(RULES)}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(map(bit, POLICIES[policy]))


def measure(text: str | None) -> tuple[int, ...]:
    words = words_of(text)
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    raw = b" ".join(words)
    shown = raw.decode("utf-8", "surrogatepass")
    chars = len(shown) - n + 1
    symbols = len(raw) - len(raw.translate(None, _SYMBOL))
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = 0
    if n >= 3:
        v = np.int64(len(number))
        _, pair = np.unique(
            ids[:-1] * v + ids[1:], return_inverse=True
        )  # numbered anew, so that three words fit in 64 bits
        _, at, times = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
        again = times[at] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= again
        repeats = int(hit.sum())
    upper = sum(map(str.isupper, shown.split(" ")))
    return (n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines), upper, words.count(b"|"), len(number))


def _measured(docs: DataFrame, carried: Column) -> DataFrame:
    """row (the carried struct), the measurements (long) and rule_bits (long), one row per row of docs."""
    def run(batches):
        keep_only()
        for batch in slices(batches):
            rows = np.array([measure(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], ["row", *MEASURES]
            )

    rows = docs.select(carried.alias("row"), "text")
    made = rows.mapInArrow(run, carrying(rows.schema["row"].dataType, ", ".join(f"{m} long" for m in MEASURES)))
    bits = sum((F.when(F.expr(r), F.lit(bit(name))).otherwise(F.lit(0)) for name, r in RULES.items()), F.lit(0))
    return made.withColumn("rule_bits", bits.cast("long"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and rule_bits, one row per row of docs (doc_id, text)."""
    return _measured(docs, F.struct("doc_id")).select("row.doc_id", *MEASURES, "rule_bits")


def judged(book: DataFrame, policy: str) -> DataFrame:
    """The ledger with kept: no rule of the policy failed."""
    return book.withColumn("kept", F.col("rule_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """A row per rule of the policy: how many fail it, how many fail it alone (kept without it), kept by the policy as it is.

    One aggregate over the distinct bit patterns (at most 2 ** rules of them)."""
    patterns = book.select(
        F.col("rule_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")
    ).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.explode(
        F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]))
    ).alias("x")
    rows = patterns.select("bits", "n", rules).select("bits", "n", "x.rule", "x.bit")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(failed & (F.bit_count("bits") == 1), F.col("n"))), F.lit(0)).alias("n_kept_without"),
        F.coalesce(F.sum(F.when(F.col("bits") == 0, F.col("n"))), F.lit(0)).alias("n_kept"),
    )


def kept_documents(docs: DataFrame, policy: str = "strict-2") -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns: the ledger's rows carry them, so no join is needed."""
    book = judged(_measured(docs, F.struct(*(column(c) for c in docs.columns))), policy)
    return book.where("kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = judged(ledger(table(spark, sf_dir, "documents")), "strict-2")
    base = F.col("rule_bits").bitwiseAND(F.lit(mask("base-1"))) != 0
    return book.select("doc_id", *MEASURES[:5], base.alias("base_failed"), "kept", "rule_bits")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
t AS (SELECT r, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS times FROM t WHERE z IS NOT NULL),
h AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE times > 1) GROUP BY 1),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
v AS (SELECT r, count(*) AS n_words, CAST(sum(length(x)) AS BIGINT) AS word_chars, count(*) FILTER (upper(x) = x AND lower(x) <> x) AS n_upper_words, count(*) FILTER (x = '|') AS n_table_words, count(DISTINCT x) AS n_distinct_words FROM u GROUP BY 1),
m AS (SELECT doc_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in MEASURES if c != "n_symbols")}, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d LEFT JOIN v USING (r) LEFT JOIN h USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, CAST({" + ".join(f"CASE WHEN {rule} THEN {bit(name)} ELSE 0 END" for name, rule in RULES.items())} AS BIGINT) AS rule_bits FROM m)
SELECT doc_id, {", ".join(MEASURES[:5])}, rule_bits & {mask("base-1")} <> 0 AS base_failed, rule_bits & {mask("strict-2")} = 0 AS kept, rule_bits FROM b
"""
