"""How far sources of one language diverge in the terms they use, counted by DuckDB in shards of terms.

Workers count each document's terms and hand out blocks: per shard of a hash of language and term, the counts by source. A
shard holds every count of its terms, so DuckDB sums them, tells which terms enough documents of a language have, and returns
the kept ones. Spark adds up the groups' totals from them. Then each shard meets the totals of the languages it has terms of,
and DuckDB makes its part of all sums over pairs of sources and its first terms of every source; Spark adds up the parts and
ranks. All figures are whole numbers (128 bits in between), so the order of adding does not matter.

Shards are as many as the texts' bytes ask for, and a term that all documents share has one count per source and block, so no
shard grows with the rows; nothing is broadcast. A source with a third of the rows is counted where its rows lie.

Null text, language and source count as empty; an empty language or source is a group like any other; groups without terms
and languages without kept terms have their pairs, with value 0; repeated rows count as often as they occur; a very long text
is counted whole; equal values rank by item; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import duckdb
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import finished, slices, staged, table

LEAST_DOCS, TOP, SCALE, SMOOTH = 30, 50, 1_000_000_000, 5
#: Bytes of text whose terms make a shard, and counts that a worker gathers before it hands them out.
SHARD_BYTES, HELD = 64 << 20, 400_000
#: Terms are runs of letters A-Z and of what lies beyond ASCII; in UTF-8, all bytes of the latter are 128 or more.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())
])


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERMS).split(b" ") if text else []


class Counts:
    """Occurrences and documents of terms, by language and source."""

    def __init__(self, shards: int):
        self.shards, self.groups, self.shard_of = shards, {}, {}

    def add(self, lang: str, source: str, text: str | None) -> None:
        n, docs = self.groups.setdefault((lang, source), (Counter(), Counter()))
        terms = terms_of(text)
        n.update(terms)
        docs.update(set(terms))

    def held(self) -> int:
        return sum(len(n) for n, _ in self.groups.values())

    def blocks(self):
        """(shard, block of counts in Arrow's format); what is held is let go."""
        rows: dict[int, list[tuple]] = {}
        for (lang, source), (n, docs) in self.groups.items():
            n.pop(b"", None)
            salt = hash_of(lang.encode("utf-8", "surrogatepass"))
            for term, count in n.items():
                shard = xxhash.xxh3_64_intdigest(term, salt) % self.shards
                rows.setdefault(shard, []).append((lang, source, term, docs[term], count))
        self.groups = {}
        for shard, found in rows.items():
            lang, source, term, docs, n = zip(*found)
            block = pa.record_batch([
                pa.array(lang), pa.array(source), pa.array(term, pa.binary()).cast(pa.string()), pa.array(docs), pa.array(n)
            ], BLOCK)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, BLOCK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(block)
            yield shard, sink.getvalue().to_pybytes()


def hash_of(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def counted(docs: DataFrame, shards: int) -> DataFrame:
    """shard int, block binary: partial counts as the workers hand them out."""
    def run(batches):
        counts = Counts(shards)

        def out():
            found = list(counts.blocks())
            for i in range(0, len(found), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found[i : i + 64]), (pa.int32(), pa.binary()))], ["shard", "block"]
                )

        for part in slices(batches, 200):
            for row in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                counts.add(*row)
            if counts.held() > HELD:
                yield from out()
        yield from out()

    return _texts(docs).mapInArrow(run, "shard int, block binary")


def _database() -> duckdb.DuckDBPyConnection:
    """In memory, one thread, with a bound beyond which it spills to the worker's own folder."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "preserve_insertion_order": False})


def _arrow(found) -> pa.Table:
    """DuckDB's result as one table, whichever of its forms this version gives."""
    found = found.to_arrow_table() if hasattr(found, "to_arrow_table") else found.arrow()
    return found.read_all() if isinstance(found, pa.RecordBatchReader) else found


KEPT = f"""
WITH c AS (SELECT lang, term, source, sum(docs) AS docs, sum(n) AS n FROM blocks GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS all_n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS})
SELECT lang, term, source, CAST(n AS BIGINT) AS n, CAST(all_n AS BIGINT) AS all_n,
  row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS first FROM c JOIN k USING (lang, term)
"""


def kept_terms(blocks: DataFrame) -> DataFrame:
    """Counts of the kept terms by source: shard, lang, term, source, n, all_n (of the language), first (once for a term)."""
    def run(key, rows):
        con = _database()
        parts = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in rows.column("block")]
        con.register("blocks", pa.concat_tables(parts))
        found = _arrow(con.sql(KEPT))
        con.close()
        return found.add_column(0, "shard", pa.array([key[0].as_py()] * len(found), pa.int32())).cast(KEPT_SCHEMA)

    return blocks.groupBy("shard").applyInArrow(
        run, "shard int, lang string, term string, source string, n long, all_n long, first boolean"
    )


KEPT_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()),
    ("all_n", pa.int64()), ("first", pa.bool_())
])


def totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every occurring group: lang, source, total (its kept terms' occurrences), lang_total, terms (the language's V)."""
    groups = _texts(docs).select("lang", "source").groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select(
        "lang", "source", zero("total"), zero("lang_total"), zero("terms")
    )


def _p(n: str, total: str) -> str:
    return f"1 + ({SCALE}::HUGEINT * ({n} + {SMOOTH})) // ({total}::HUGEINT + {SMOOTH} * terms)"


#: The parts of the sums over pairs of sources (a before b), over every kept term of the shard, in any source or not.
PAIRS = f"""
WITH t AS (SELECT DISTINCT lang, term FROM kept),
d AS (SELECT t.lang, t.term, g.source, CAST({_p('coalesce(k.n, 0)', 'g.total')} AS BIGINT) AS p FROM t JOIN groups g USING (lang)
  LEFT JOIN kept k ON k.lang = t.lang AND k.term = t.term AND k.source = g.source)
SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
FROM d a JOIN d b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
"""
#: The shard's first terms of every source, by how far their share lies above the language's.
FIRST = f"""
WITH d AS (SELECT lang, k.source, term AS item, CAST({_p('n', 'total')} AS BIGINT) - CAST({_p('all_n', 'lang_total')} AS BIGINT) AS value
  FROM kept k JOIN groups g USING (lang, source) WHERE n > 0)
SELECT lang, source, item, value FROM d WHERE value > 0
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP}
"""
PART_SCHEMA = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())
])


def parts(kept: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """Every shard's parts: lang, source, part, item, value. Each shard gets a copy of the groups' totals beside its counts."""
    def run(kept_rows, group_rows):
        if not len(kept_rows):
            return PART_SCHEMA.empty_table()
        con = _database()
        con.register("kept_", kept_rows)
        con.register("groups", group_rows)
        con.execute("CREATE TABLE kept AS FROM kept_")
        found = [
            part.add_column(2, "part", pa.array([name] * len(part), pa.string())).cast(PART_SCHEMA)
            for name, part in (("pair", _arrow(con.sql(PAIRS))), ("term", _arrow(con.sql(FIRST))))
        ]
        con.close()
        return pa.concat_tables(found)

    spread = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return kept.groupBy("shard").cogroup(spread.groupBy("shard")).applyInArrow(
        run, "lang string, source string, part string, item string, value long"
    )


def audit(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs (text, lang, source) to lang, source, part (pair or term), item, value, rank."""
    def make() -> DataFrame:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        shards = max(8, -(-size // shard_bytes))
        kept = staged(kept_terms(counted(docs, shards)))
        groups = staged(totals(docs, kept))
        made = staged(parts(kept, groups, shards))
        half = made.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
        others = groups.select("lang", F.col("source").alias("item"))
        pairs = groups.select("lang", "source").join(others, "lang").where("source <> item").join(
            both, ["lang", "source", "item"], "left"
        ).select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
        terms = made.where("part = 'term'").select("lang", "source", "part", "item", "value")
        best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
        rank = F.row_number().over(best).alias("rank")
        columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value")]
        return pairs.select(*columns, rank).unionByName(terms.select(*columns, rank).where(F.col("rank") <= TOP))

    return finished(docs.sparkSession, make)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
n AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
t AS (SELECT lang, term, sum(n) AS all_n FROM n GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
k AS (SELECT n.* FROM n JOIN t USING (lang, term)),
v AS (SELECT lang, count(*) AS terms, sum(all_n) AS lang_total FROM t GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(s.total, 0) AS total, coalesce(v.terms, 0) AS terms, coalesce(v.lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n) AS total FROM k GROUP BY ALL) s USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, t.term, coalesce(k.n, 0) AS n, CAST({_p('coalesce(k.n, 0)', 'g.total')} AS BIGINT) AS p, CAST({_p('t.all_n', 'lang_total')} AS BIGINT) AS q
  FROM g JOIN t ON g.lang = t.lang LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= {TOP}
"""
