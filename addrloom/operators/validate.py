"""Validation of match rows against a point layer of a database (code, name, x, y) and one of shapes (gid, x, y).

Every match row (rid, gid, v1, v2) is resolved once: database record by gid = code, or else by the first configured value that
is a name; shape point by normalised gid. Statistics and problem rows all read that frame, so they cannot disagree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..functions.text import gid_norm, match_value, strip


def _norm(c: Column) -> Column:
    """Null if nothing is left, so that blank values are no key that all of them meet on."""
    return F.nullif(F.lower(strip(c.cast("string"))), F.lit(""))


def _keyed(db: DataFrame, column: str) -> DataFrame:
    """Of each key the first record (by code, then name), and how many there are."""
    return db.withColumn("k", _norm(F.col(column))).where("k is not null").groupBy("k").agg(
        F.min(F.struct("code", "name", "x", "y")).alias("r"), F.count("*").alias("n")
    )


def resolve(rows: DataFrame, db: DataFrame, shapes: DataFrame, fields: list[str]) -> DataFrame:
    """rows with db (record or null), db_by, db_n (records of that key), shape (x, y) and distance in metres."""
    codes = _keyed(db, "code").select(F.col("k").alias("_kc"), F.col("r").alias("_rc"), F.col("n").alias("_nc"))
    out = rows.join(codes, F.coalesce(gid_norm(F.col("gid")), _norm(F.col("gid"))) == F.col("_kc"), "left")
    names = _keyed(db, "name")
    for i, f in enumerate(fields):
        out = out.join(
            names.select(F.col("k").alias(f"_k{i}"), F.col("r").alias(f"_r{i}"), F.col("n").alias(f"_n{i}")),
            _norm(F.col(f)) == F.col(f"_k{i}"), "left"
        )
    points = shapes.withColumn("g", gid_norm(F.col("gid"))).where("g is not null").groupBy("g").agg(
        F.max_by(F.struct("x", "y"), "seq").alias("shape")
    )
    out = out.join(points, gid_norm(F.col("gid")) == F.col("g"), "left")
    db_, n = (F.coalesce(f"_{c}c", *(f"_{c}{i}" for i in range(len(fields)))) for c in "rn")
    by = reduce(
        lambda c, f: c.when(F.col(f"_r{f[0]}").isNotNull(), f[1]), enumerate(fields),
        F.when(F.col("_rc").isNotNull(), "gid")
    )
    out = out.select(*rows.columns, db_.alias("db"), by.alias("db_by"), F.coalesce(n, F.lit(0)).alias("db_n"), "shape")
    return out.withColumn(
        "distance", F.round(geo.distance(F.col("shape.x"), F.col("shape.y"), F.col("db.x"), F.col("db.y")), 2)
    )


def completeness(resolved: DataFrame) -> DataFrame:
    counts = resolved.agg(F.count("*").alias("total"), F.count_if(F.col("db").isNotNull()).alias("found"))
    return counts.withColumns(
        {
            "missing": F.col("total") - F.col("found"),
            "rate": F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("found") / F.col("total") * 100, 6))
        }
    )


def completeness_original(rows: DataFrame, db: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of the original table of which any configured value is a database name."""
    names = db.select(_norm(F.col("name")).alias("k")).where("k is not null").distinct()
    hits = reduce(
        DataFrame.unionByName, (rows.select("rid", _norm(F.col(f)).alias("k")) for f in fields)
    ).join(names, "k", "left_semi").select("rid").distinct()
    marked = rows.select("rid").join(hits.withColumn("hit", F.lit(1)), "rid", "left")
    counts = marked.agg(F.count("*").alias("total"), F.count("hit").alias("found"))
    return counts.withColumns(
        {
            "missing": F.col("total") - F.col("found"),
            "rate": F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("found") / F.col("total") * 100, 6))
        }
    )


def deviation(resolved: DataFrame, metres: float = 10.0) -> DataFrame:
    n = lambda c: F.count_if(c)
    d = F.col("distance")
    counts = resolved.agg(
        F.count("*").alias("attempted"), n(d.isNotNull()).alias("checked"), n(d <= metres).alias("within"),
        n(d > metres).alias("exceed"), n(F.col("shape").isNull()).alias("no_shp"),
        n(F.col("shape").isNotNull() & F.col("db").isNull()).alias("no_db")
    )
    return counts.withColumn(
        "within_rate",
        F.when(F.col("checked") == 0, 0.0).otherwise(F.round(F.col("within") / F.col("checked") * 100, 6))
    )


def duplicates(resolved: DataFrame) -> DataFrame:
    hit = F.col("db_n") > 1
    key = F.when(
        hit,
        F.when(
            F.col("db_by") == "gid", F.concat(F.lit("code:"), _norm(F.col("db.code")))
        ).otherwise(F.concat(F.lit("name:"), _norm(F.col("db.name"))))
    )
    return resolved.agg(
        F.count_distinct(key).alias("duplicate_keys"), F.count_if(hit).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(hit, F.col("db_n"))), F.lit(0)).alias("duplicate_records")
    )


def _problem(rows: DataFrame, kind: str, status: Column, fields: list[str]) -> DataFrame:
    point = lambda c: F.when(
        F.col(c).isNotNull(), F.format_string("%.6f,%.6f", f"{c}.x", f"{c}.y")
    ).otherwise("")
    return rows.select(
        "rid", F.coalesce(F.col("gid").cast("string"), F.lit("")).alias("gid"),
        F.coalesce("db.code", F.lit("")).alias("db_code"), match_value([F.col(f) for f in fields]).alias("value"),
        F.lit(kind).alias("kind"), status.alias("status"), point("shape").alias("shape_at"), point("db").alias("db_at")
    )


def missing(resolved: DataFrame, fields: list[str]) -> DataFrame:
    return _problem(resolved.where("db is null"), "missing", F.lit("数据库中未找到"), fields)


def deviations(resolved: DataFrame, fields: list[str], metres: float = 10.0) -> DataFrame:
    return _problem(
        resolved.where(F.col("distance") > metres), "deviation", F.format_string("%.2f米", F.col("distance")), fields
    )


def duplicate_rows(resolved: DataFrame, fields: list[str]) -> DataFrame:
    return _problem(resolved.where("db_n > 1"), "duplicate", F.format_string("重复%d条", F.col("db_n")), fields)


def problems(resolved: DataFrame, fields: list[str], metres: float = 10.0) -> DataFrame:
    return missing(resolved, fields).unionByName(
        deviations(resolved, fields, metres)
    ).unionByName(duplicate_rows(resolved, fields))


def report(found: DataFrame) -> DataFrame:
    """Problem rows under the names of the problem table; what a row lacks is a hyphen."""
    or_none = lambda c: F.when(c != "", c).otherwise("-")
    point = lambda c: or_none(
        F.when(F.col(c) != "", F.concat(F.lit("("), F.replace(c, F.lit(","), F.lit(", ")), F.lit(")"))).otherwise("")
    )
    kinds = reduce(
        lambda c, k: c.when(F.col("kind") == k, PROBLEM_TYPES[k]), list(PROBLEM_TYPES)[1:],
        F.when(F.col("kind") == "missing", PROBLEM_TYPES["missing"])
    )
    apart = F.when(F.col("kind") == "deviation", F.col("status")).otherwise("-")
    return found.select(
        F.col("gid").alias("目标表GID"), or_none(
            F.col("db_code")
        ).alias("数据库code"), F.col("value").alias("源表匹配值"), F.col("status").alias("状态"), apart.alias("偏差距离"),
        point("shape_at").alias("原始坐标"), point("db_at").alias("数据库坐标"), kinds.alias("问题类型"),
    )


#: Values of the problem table.
PROBLEM_TYPES = {"missing": "缺失", "deviation": "偏差", "duplicate": "重复"}


def text_report(
    source_total: DataFrame, resolved: DataFrame, fields: list[str], metres: float = 10.0, most: int = 100
) -> DataFrame:
    """(line, text): the report of a validation as text, with the first `most` problems by row; source_total has one row, n."""
    one = completeness(resolved).select(F.col("total").alias("matched"), "found", "missing")
    far = deviation(resolved, metres).select("checked", "within", "exceed")
    again = duplicates(resolved).select("duplicate_keys", "duplicate_records")
    head = reduce(
        lambda a, b: a.crossJoin(F.broadcast(b)), (one, far, again),
        source_total.select(F.col("n").alias("source_total"))
    )  # a row each
    value = lambda label, c: F.concat(F.lit(label + ": "), F.col(c).cast("string"))
    rule = F.lit("=" * 60)
    lines = [
        rule, F.lit("数据治理验证统计报告"), rule, F.lit(""), F.lit("【基本信息】"), value(
            "原始客户数据总数", "source_total"
        ), value("匹配结果总数", "matched"), F.lit(""),
        F.lit("【数据完整性统计】"), value("匹配结果在数据库中存在", "found"), value("匹配结果在数据库中缺失", "missing"), F.lit(""),
        F.lit("【位置偏差统计】"), value("检查总数", "checked"), value("在阈值内", "within"), value("超过阈值", "exceed"), F.lit(""),
        F.lit("【重复数据统计】"), value("重复匹配值数", "duplicate_keys"), value("重复记录数", "duplicate_records"), F.lit(""),
    ]
    top = head.select(
        F.posexplode(F.array(*lines)).alias("line", "text")
    ).select(F.col("line").cast("long").alias("line"), "text")
    found = problems(resolved, fields, metres)
    first = found.orderBy("rid", "kind").limit(most).withColumn(
        "n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rid", "kind"))
    )
    body = first.select(
        (F.col("n") + len(lines)).cast("long").alias("line"),
        F.concat(F.col("n").cast("string"), F.lit(". "), "status", F.lit(" - GID: "), "gid").alias("text")
    )
    title = found.limit(1).select(F.lit(len(lines)).cast("long").alias("line"), F.lit("【问题数据详情】").alias("text"))
    rest = found.agg(F.count("*").alias("n")).where(F.col("n") > most).select(
        F.lit(len(lines) + most + 1).cast("long").alias("line"),
        F.concat(F.lit("... 还有 "), (F.col("n") - most).cast("string"), F.lit(" 条问题数据未显示")).alias("text")
    )
    return reduce(DataFrame.unionByName, (top, title, body, rest))


def duplicate_records(db: DataFrame) -> DataFrame:
    """Database records whose code or name occurs more than once."""
    def more(column):
        return db.select(
            _norm(F.col(column)).alias("k")
        ).where("k is not null").groupBy("k").count().where("count > 1").select("k")

    by_code = db.join(more("code"), _norm(F.col("code")) == F.col("k"), "left_semi")
    by_name = db.join(more("name"), _norm(F.col("name")) == F.col("k"), "left_semi")
    return by_code.unionByName(by_name).distinct()


def target_gid(names: Column) -> Column:
    """Of a list of column names the target's gid column, or else its code column."""
    holds = lambda x, word: F.lower(x).contains(word)
    first = lambda test: F.get(F.filter(names, lambda x: x.contains("[目标:") & test(x)), F.lit(0))
    return F.coalesce(first(lambda x: holds(x, "gid") & ~holds(x, "code")), first(lambda x: holds(x, "code")))


def map_field(field: str, table: str, names: Column) -> Column:
    """Of a list of column names the source's column for a field, by its very name under either prefix, or the first that has it."""
    exact = [F.when(F.array_contains(names, n), n) for n in (f"[源:{table}]{field}", f"【匹配源:{table}】{field}")]
    return F.coalesce(*exact, F.get(F.filter(names, lambda x: x.contains(field)), F.lit(0)))


def gid_field(names: Column) -> Column:
    """Of a list of a shape layer's column names the one with its ids: gid, or else id, or else the first."""
    named = lambda word: F.get(F.filter(names, lambda x: F.lower(x) == word), F.lit(0))
    return F.coalesce(named("gid"), named("id"), F.get(names, F.lit(0)))


def point_layer(layers: dict[str, DataFrame]) -> str | None:
    """The first layer, in the order given (database layers go first), that has the columns code and name."""
    return next((name for name, df in layers.items() if {"code", "name"} <= {c.lower() for c in df.columns}), None)
