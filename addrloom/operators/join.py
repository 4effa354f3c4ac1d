"""Relational joins of two tables, key matching strategies, and predicates built from typed parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import strip


#: Pairs of one key that a block may have, as far as blocks that small copy the rows at most so many times.
PAIRS, COPIES = 4_000_000, 4
#: Rows of one side that meet as many of the other one at a time.
PACK = 64


def inner(a: DataFrame, b: DataFrame, on_a: str, on_b: str, most: int = PAIRS) -> DataFrame:
    """All pairs with equal keys, null keys included; columns get the prefixes [A] and [B], keys their own names.

    Pairs grow with the product of a key's rows on both sides. A key of more than `most` pairs is met in blocks, each of a part of
    one side's rows and a part of the other's, in the shape that copies the fewest rows. There are as many tasks as blocks, so that
    neither a few keys nor small inputs leave the work to a few tasks. What is shuffled grows no faster than the rows: blocks get
    larger where smaller ones would copy either side to more than COPIES times the rows of both; a larger one takes longer, and no
    more memory. In a block, packs of a few rows meet, so that a result file holds the same values again within a short distance."""
    left = a.select(*(F.col(f"`{c}`").alias(f"【关联A】{c}" if c == on_a else f"[A]{c}") for c in a.columns))
    right = b.select(*(F.col(f"`{c}`").alias(f"【关联B】{c}" if c == on_b else f"[B]{c}") for c in b.columns))
    ka, kb = F.col(f"`【关联A】{on_a}`"), F.col(f"`【关联B】{on_b}`")
    na = left.groupBy(ka.alias("_k")).agg(F.count("*").cast("double").alias("_na"))
    nb = right.groupBy(kb.alias("_kb")).agg(F.count("*").cast("double").alias("_nb"))
    most_of = lambda n: F.floor(COPIES * (F.col("_na") + F.col("_nb")) / F.col(n))
    large = na.join(nb, F.col("_k").eqNullSafe(F.col("_kb"))).drop("_kb").withColumn(
        "_blocks", F.col("_na") * F.col("_nb") / most
    ).where("_blocks > 1").withColumn(
        "_of_b", F.greatest(F.lit(1), F.least(F.round(F.sqrt(F.expr("_blocks * _nb / _na"))), F.ceil("_blocks"), most_of("_na"))).cast("long")
    ).withColumn("_of_a", F.greatest(F.lit(1), F.least(F.ceil(F.expr("_blocks / _of_b")), most_of("_nb"))).cast("long"))
    blocks = large.agg(F.sum(F.expr("_of_a * _of_b"))).first()[0]
    others = left.join(right, ka.eqNullSafe(kb))
    if not blocks:
        return others.drop(f"【关联B】{on_b}") if on_a == on_b else others
    # Keys of so many pairs have 2,000 rows or more on one side, so they are few.
    n = int(blocks) + int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packs(df, key, rows, parts, copies, at, name):
        """(at, name): arrays of a block's rows. A row's part and its pack there are those of a cell, of which a part has many."""
        cells = F.col(parts) * F.ceil(F.col(rows) / (F.col(parts) * PACK))
        cell = F.pmod(F.xxhash64(F.monotonically_increasing_id()), cells)
        # Neither is nullable, so that both sides' blocks are of one type and nothing is dealt anew to compare them.
        place = {
            parts: F.coalesce(F.pmod("_cell", parts), F.lit(0).cast("long")),
            copies: F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1))
        }
        met = df.join(F.broadcast(large), key.eqNullSafe(F.col("_k"))).withColumn("_cell", cell).select(
            F.struct(*(f"`{c}`" for c in df.columns)).alias("_row"), "_k", F.floor(F.col("_cell") / F.col(parts)).alias("_pack"),
            place["_of_a"].alias("_i"), place["_of_b"].alias("_j")
        )
        # Structs of null are equal, and one column is all that rows are dealt by.
        return met.select("_row", "_pack", F.struct("_k", "_i", "_j").alias(at)).repartition(n, at).groupBy(at, "_pack").agg(
            F.collect_list("_row").alias(name)
        ).drop("_pack")

    met = packs(left, ka, "_na", "_of_a", "_of_b", "_at", "_a").join(
        packs(right, kb, "_nb", "_of_b", "_of_a", "_to", "_b").hint("merge"), F.col("_at") == F.col("_to")
    )
    rest = left.join(F.broadcast(large.select("_k")), ka.eqNullSafe(F.col("_k")), "left_anti").join(right, ka.eqNullSafe(kb))
    out = met.select("_b", F.inline("_a")).select(*(f"`{c}`" for c in left.columns), F.inline("_b")).unionByName(rest)
    return out.drop(f"【关联B】{on_b}") if on_a == on_b else out


def left_anti(a: DataFrame, b: DataFrame, on_a: str, on_b: str) -> DataFrame:
    keys = b.select(F.col(f"`{on_b}`").cast("string").alias("_k")).where("_k is not null").distinct()
    return a.join(keys, F.col(f"`{on_a}`").cast("string") == F.col("_k"), "left_anti")


def right_anti(a: DataFrame, b: DataFrame, on_a: str, on_b: str) -> DataFrame:
    return left_anti(b, a, on_b, on_a)


def export(a: DataFrame, b: DataFrame, on_a: str, on_b: str, kind: str) -> DataFrame:
    """inner, left_anti, or else right_anti."""
    return {"inner": inner, "left_anti": left_anti}.get(kind, right_anti)(a, b, on_a, on_b)


def _key(c: Column) -> Column:
    return F.lower(strip(c.cast("string")))


def exact(
    left: DataFrame, right: DataFrame, on_left: str, on_right: str, lid: str = "lid", rid: str = "rid"
) -> DataFrame:
    """(lid, rid, confidence): equal keys without case and outer space; empty ones and nulls match nothing."""
    a = left.select(lid, _key(F.col(on_left)).alias("k")).where("k <> ''")
    b = right.select(rid, _key(F.col(on_right)).alias("k")).where("k <> ''")
    return a.join(b, "k").select(lid, rid, F.lit(1.0).alias("confidence"))


def multi_field(
    left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], lid: str = "lid", rid: str = "rid"
) -> DataFrame:
    """Composite keys, joined by a bar; a row takes part unless all its parts are empty."""
    def keyed(df, names, i):
        parts = [F.coalesce(_key(F.col(n)), F.lit("")) for n in names]
        return df.select(i, F.concat_ws("|", *parts).alias("k"), F.concat(*parts).alias("all")).where("all <> ''")

    return keyed(left, [a for a, _ in pairs], lid).join(
        keyed(right, [b for _, b in pairs], rid), "k"
    ).select(lid, rid, F.lit(1.0).alias("confidence"))


def fuzzy(
    left: DataFrame, right: DataFrame, on_left: str, on_right: str, least: float = 0.7, lid: str = "lid",
    rid: str = "rid"
) -> DataFrame:
    """The best right row of each left one by difflib's score of at least `least`, the first on ties. Only pairs of different
    strings whose letters in common allow that score are compared, whatever the sizes of both sides."""
    from ..functions.similarity import difflib_candidates

    a = left.select(lid, strip(F.col(on_left)).alias("a")).where("a <> ''")
    b = right.select(rid, strip(F.col(on_right)).alias("b")).where("b <> ''").groupBy("b").agg(F.min(rid).alias(rid))
    pairs = difflib_candidates(a, b, least).join(b, "b")
    best = pairs.groupBy("a").agg(F.max_by(F.struct(rid, "score"), F.struct("score", -F.col(rid))).alias("x"))
    return a.join(best, "a").select(lid, f"x.{rid}", F.col("x.score").alias("confidence"))


def batch(results: list[DataFrame], lid: str = "lid", rid: str = "rid") -> DataFrame:
    """Strategies in order: the first match of each left row counts."""
    rows = reduce(
        DataFrame.unionByName,
        (r.select(lid, rid, "confidence", F.lit(i).alias("strategy")) for i, r in enumerate(results))
    )
    first = F.row_number().over(Window.partitionBy(lid).orderBy("strategy", rid))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def predicate(rows: list[tuple[str, str, str, object]]) -> Column:
    """(connective, column, operator, value) rows, from left to right; the first connective is ignored.

    Operators: = != > < >= <= LIKE (contains) IN (a list), IS NULL, IS NOT NULL. Values are typed literals, never SQL text."""
    def one(name, op, value):
        c = F.col(f"`{name}`")
        return {
            "=": lambda: c == F.lit(value), "!=": lambda: c != F.lit(value), ">": lambda: c > F.lit(value), "<": lambda: c < F.lit(value), ">=": lambda: c >= F.lit(value), "<=": lambda: c <= F.lit(value),
            "LIKE": lambda: c.cast("string").contains(str(value)), "IN": lambda: c.isin(*value), "IS NULL": c.isNull, "IS NOT NULL": c.isNotNull,
        }[op]()

    out = None
    for connective, name, op, value in rows:
        p = one(name, op, value)
        out = p if out is None else (out | p if connective == "OR" else out & p)
    return F.lit(True) if out is None else out


def pair_predicate(source: Column, target: Column, kind: str) -> Column:
    return {
        "=": lambda: source == target, "LIKE": lambda: source.contains(target), "包含": lambda: source.contains(target),
        "被包含": lambda: target.contains(source), "前缀": lambda: source.startswith(target),
        "后缀": lambda: source.endswith(target)
    }[kind]()


def remaining(rows: DataFrame, matched: DataFrame, rid: str = "rid") -> DataFrame:
    return rows.join(matched.select(rid).distinct(), rid, "left_anti")


def head(df: DataFrame, n: int, rid: str = "rid") -> DataFrame:
    return df.orderBy(rid).limit(n)


def sample(df: DataFrame, n: int = 1000, seed: int = 42, rid: str = "rid") -> DataFrame:
    """A sample that any engine draws alike: the first by a digest of seed and id."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(rid).cast("string"))), rid).limit(n)


def page(df: DataFrame, number: int, size: int = 100, rid: str = "rid") -> DataFrame:
    return df.orderBy(rid).offset(max(0, number - 1) * size).limit(size)
