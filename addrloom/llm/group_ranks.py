"""First places within groups whose lines tie: a simultaneous binary search for every group's cut, then a sort by ranges.

A line's pair (high: larger first; low: smaller first; nulls come first and are equal) is encoded as one number that rises with
the order. Lines are counted once for each group and pair (``counts``). Every group then searches the pair at which its count
reaches the places wanted: a pass counts, for all groups at once, the lines up to the middle of the group's range of pairs and
keeps the half in which the cut lies, so the passes are as many as the widest range has bits. Lines beyond their group's cut
go. The rest, with equal lines counted as one, is dealt by ranges of (group, pair, ties): a group with very many lines at
its cut lies in many ranges, each of which keeps its first lines only, and those few are ranked.

A group is one long, where its columns are whole numbers of which all combinations fit into one, and else their JSON.

Nothing that grows with the input is broadcast or reaches the driver; that gets two bounds of each column, and after each pass
whether a group is still searching. Groups of more than one in HOT rows, so fewer than HOT, have their cuts broadcast, and
their rows are not dealt by key. Joins deal by a key that no later step groups by, so that Spark can split hot ones.

Null group columns are groups of their own; null ties come last; equal rows are ranked and returned separately; an empty table
gives no row; rows with a place are returned with the columns named in the call, others are ignored. No text is read. A group
column may have any name but those of the result (pos, place, tied).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

from .common import column, finished, free_names, staged, table

#: Places that are returned; a group of over one in so many rows is cut without being dealt by its key.
MOST, HOT = 2, 1000


def bounds(lines: DataFrame, names: list[str]) -> list[tuple[int, int]]:
    """The least and the largest value of each column, by one pass; 0 where there is none."""
    found = [x or 0 for x in lines.agg(*[f(column(c)) for c in names for f in (F.min, F.max)]).first()]
    return list(zip(found[::2], found[1::2]))


class Group:
    """The group's columns as one value called g. sides: the bounds of columns that all are whole numbers, or nothing."""

    def __init__(self, lines: DataFrame, groups: list[str], sides: list[tuple[int, int]]):
        self.columns = [column(c) for c in groups]
        self.key = StructType([StructField(str(i), lines.schema[c].dataType) for i, c in enumerate(groups)])
        self.least, self.wide = [a for a, _ in sides], [b - a + 2 for a, b in sides]
        self.number = bool(sides) and math.prod(self.wide) < 1 << 62

    def encoded(self) -> Column:
        """Null is 0 in a number."""
        if not self.number:
            return F.to_json(F.struct(*[c.alias(str(i)) for i, c in enumerate(self.columns)]))
        part = lambda c, a: F.coalesce(c.cast("long") - F.lit(a) + F.lit(1), F.lit(0))
        return reduce(
            lambda x, y: x * F.lit(y[0]) + y[1], zip(self.wide, map(part, self.columns, self.least)), F.lit(0).cast("long")
        ).cast("long")

    def decoded(self) -> list[Column]:
        if not self.number:
            return [F.from_json("g", self.key).getField(f.name) for f in self.key]
        below = [math.prod(self.wide[i + 1 :]) for i in range(len(self.wide))]
        parts = [F.expr(f"(g div {b}L) % {w}L") for b, w in zip(below, self.wide)]
        return [
            F.when(p > 0, p - F.lit(1) + F.lit(a)).cast(f.dataType) for p, a, f in zip(parts, self.least, self.key)
        ]


class Pair:
    """The pair as one number that rises with the order: null is 0, so it comes first. high is a 32-bit number, low a long."""

    def __init__(self, lines: DataFrame, high: str, low: str, sides: list[tuple[int, int]] | None = None):
        self.high, self.low = column(high), column(low)
        (least, self.most), (self.bottom, top) = sides or bounds(lines, [high, low])
        self.wide = top - self.bottom + 2
        self.kind = "long" if (self.most - least + 2) * self.wide < 1 << 62 and self.wide < 1 << 62 else "decimal(38,0)"

    def number(self, x: int) -> Column:
        return F.lit(str(x)).cast(self.kind)

    def encoded(self) -> Column:
        first = F.coalesce(self.number(self.most + 1) - self.high.cast(self.kind), self.number(0))
        second = F.coalesce(self.low.cast(self.kind) - self.number(self.bottom - 1), self.number(0))
        return (first * self.number(self.wide) + second).cast(self.kind)

    def decoded(self) -> tuple[Column, Column]:
        """high and low of a column called code."""
        by = f"cast('{self.wide}' as {self.kind})"
        first, second = F.expr(f"code div {by}"), F.expr(f"code % {by}")
        return (
            F.when(first > 0, F.lit(self.most + 1) - first).cast("int"),
            F.when(second > 0, second + self.number(self.bottom - 1)).cast("long")
        )


def _meet(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A sort-merge join on the group's key g, dealt by its hash too: no later grouping by g can use that, so Spark may split
    the rows of a hot group; and neither side is broadcast, however small it looks."""
    keyed = lambda df: df.withColumn("deal", F.xxhash64("g"))
    return keyed(left).join(keyed(right).hint("merge"), ["deal", "g"], how).drop("deal")


def cuts(counts: DataFrame, most: int) -> DataFrame:
    """counts (g, code, n) to (g, cut): the least code up to which a group has `most` lines, or its last code."""
    state = staged(counts.groupBy("g").agg(
        F.min("code").alias("lo"), F.max("code").alias("hi"), F.sum("n").alias("n")
    ).select(
        "g", F.when(F.col("n") <= most, F.col("hi")).otherwise(F.col("lo")).alias("lo"), "hi", F.lit(0).cast("long").alias("under")
    ))
    kind = dict(counts.dtypes)["code"]
    while state.where("lo < hi").limit(1).count():
        middle = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / F.lit(2)) if kind != "bigint" else F.expr("lo + (hi - lo) div 2")
        open_ = state.where("lo < hi").withColumn("mid", middle.cast(kind))
        met = _meet(counts, open_).where("code between lo and hi").groupBy("g").agg(
            F.first("under").alias("before"), F.coalesce(F.sum(F.when(F.expr("code <= mid"), F.col("n"))), F.lit(0)).alias("n"),
            F.max(F.when(F.expr("code <= mid"), F.col("code"))).alias("last"),
            F.min(F.when(F.expr("code > mid"), F.col("code"))).alias("next"), F.min("code").alias("lo"), F.max("code").alias("hi")
        )
        reached = F.expr(f"before + n >= {most}")
        halved = met.select(
            "g", F.when(reached, F.col("lo")).otherwise(F.col("next")).alias("lo"),
            F.when(reached, F.col("last")).otherwise(F.col("hi")).alias("hi"),
            F.when(reached, F.col("before")).otherwise(F.expr("before + n")).alias("under")
        )
        state = staged(halved.unionByName(state.where("lo >= hi")))
    return state.select("g", F.col("hi").alias("cut"))


def _near(rows: DataFrame, counts: DataFrame, cut: DataFrame) -> DataFrame:
    """The rows up to their group's cut. Groups of more than a thousandth of all rows, of which there can be no thousand, are
    cut where their rows lie, and their rows are dealt by nothing but their place; the others' are dealt by group."""
    size = counts.groupBy("g").agg(F.sum("n").alias("n"))
    total = size.agg(F.sum("n")).first()[0] or 0
    sized = staged(_meet(size, cut).withColumn("hot", F.col("n") * HOT > F.lit(total)))
    hot = F.broadcast(sized.where("hot").select("g", F.col("cut").alias("top")))
    cold = sized.where("not hot").select("g", "cut").withColumn("deal", F.xxhash64("g"))
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).join(hot, "g", "left").where("top is null or code <= top").withColumn(
        "deal", F.when(F.col("top").isNull(), F.xxhash64("g")).otherwise(F.xxhash64("g", "at"))
    ).drop("at")
    return dealt.join(cold.hint("merge"), ["deal", "g"], "left").where("top is not null or code <= cut").drop("deal", "top", "cut")


def leading(lines: DataFrame, groups: list[str], high: str, low: str, ties: list[str], most: int = MOST) -> DataFrame:
    """The first `most` places of every group: groups, high, low and ties with pos and place (from 1, in the order of the pair,
    then of ties, nulls last) and tied (the group's lines with this pair, returned or not). Group columns are whole numbers,
    texts or booleans."""
    spark = lines.sparkSession

    def make() -> DataFrame:
        pos, place, tied = free_names(["pos", "place", "tied"], [*groups, high, low, *ties])
        whole = groups if all(isinstance(lines.schema[c].dataType, IntegralType) for c in groups) else []
        sides, kept = bounds(lines, [high, low, *whole]), [f"c{i}" for i in range(len(ties))]
        pair, group = Pair(lines, high, low, sides[:2]), Group(lines, groups, sides[2:])
        rows = lines.select(
            group.encoded().alias("g"), pair.encoded().alias("code"), *[column(c).alias(k) for c, k in zip(ties, kept)]
        )
        counts = staged(rows.groupBy("g", "code").agg(F.count("*").alias("n")))
        near = staged(_near(rows, counts, cuts(counts, most)).groupBy("g", "code", *kept).agg(F.count("*").alias("times")))
        order = [F.asc("code"), *[F.asc_nulls_last(c) for c in kept]]
        ranged = near.repartitionByRange("g", *order).withColumn("range", F.spark_partition_id())
        first = ranged.withColumn(
            "at", F.row_number().over(Window.partitionBy("range", "g").orderBy(*order))
        ).where(F.col("at") <= most).drop("at", "range")
        upto = F.sum("times").over(Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        ranked = first.withColumn("before", upto - F.col("times")).where(F.col("before") < most).withColumn(
            "pos", F.explode(F.expr(f"sequence(before + 1, least(before + times, {most}L))"))
        )
        deal = lambda df: df.withColumn("deal", F.xxhash64("g", "code"))
        found = deal(ranked).join(deal(counts).hint("merge"), ["deal", "g", "code"])
        large, small = pair.decoded()
        return found.select(
            *[x.alias(c) for x, c in zip(group.decoded(), groups)], large.alias(high), small.alias(low),
            *[F.col(k).alias(c) for k, c in zip(kept, ties)], F.col("pos").cast("long").alias(pos),
            F.col("pos").cast("long").alias(place), F.col("n").cast("long").alias(tied)
        )

    return finished(spark, make)


def _whole(number: Column) -> Column:
    """floor(number + 0.5) as a long; a number that is not finite counts as null."""
    return F.when(F.abs(number) < float("inf"), F.floor(number + 0.5).cast("long"))


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sale_lines")
    one = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    of = lambda c: F.when(one, F.lit(-1)).otherwise(c).cast("long")
    return rows.select(
        of(F.col("vendor_id")).alias("vendor_id"), of(F.coalesce(F.col("item_id") % 5, F.lit(-1))).alias("part"),
        of(F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))).alias("month"),
        F.floor(F.col("quantity") / 10).cast("int").alias("tens"), _whole(100 * F.col("discount")).alias("percent"),
        F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"),
        F.col("quantity").cast("long").alias("quantity"), _whole(100 * F.col("amount")).alias("amount_cents")
    )


def op12_group_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leading(
        sale_lines(spark, sf_dir), ["vendor_id", "part", "month"], "tens", "percent",
        ["sale_id", "line_no", "quantity", "amount_cents"]
    )
    return found.select(
        "vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied"
    )


def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII text, by the table of its polynomial."""
    entries = [reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 * (c & 1)), range(8), i) for i in range(256)]
    steps = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, ([{','.join(map(str, entries))}]::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"


SQL = f"""
WITH ids AS (SELECT sale_id, {_crc32("CAST(sale_id AS VARCHAR)")} % 5 = 0 AS one FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL)),
l AS (SELECT CASE WHEN one THEN -1 ELSE vendor_id END AS vendor_id, CASE WHEN one THEN -1 ELSE coalesce(item_id % 5, -1) END AS part,
  CASE WHEN one THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS month, floor(quantity / 10) AS tens,
  CAST(CASE WHEN isfinite(discount) THEN floor(100 * discount + 0.5) END AS BIGINT) AS percent, sale_id, CAST(line_no AS BIGINT) AS line_no,
  CAST(quantity AS BIGINT) AS quantity, CAST(CASE WHEN isfinite(amount) THEN floor(100 * amount + 0.5) END AS BIGINT) AS amount_cents
  FROM sale_lines LEFT JOIN ids USING (sale_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST, sale_id NULLS LAST,
  line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos, count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM l)
SELECT CAST(vendor_id AS BIGINT) AS vendor_id, CAST(part AS BIGINT) AS part, CAST(month AS BIGINT) AS month, CAST(pos AS BIGINT) AS pos, CAST(pos AS BIGINT) AS place,
  sale_id, line_no, quantity, percent, amount_cents, CAST(tied AS BIGINT) AS tied FROM r WHERE pos <= {MOST}
"""
