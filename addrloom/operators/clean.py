"""Cleaning: rows into valid ones with a composed address text, and rejected ones with a reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import rules as R, similarity, text as T

LINEAGE = ["_record_id", "_source_file", "_source_row"]


def lineage(df: DataFrame, stem: str, rid: str = "rid") -> DataFrame:
    """Row numbers are those of a file with a header: the first row is row 2."""
    row = F.col(rid) + 2
    return df.withColumns(
        {
            "_record_id": F.concat(F.lit(stem + "_"), row.cast("string")), "_source_file": F.lit(stem),
            "_source_row": row.cast("int")
        }
    )


def ids_first(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in LINEAGE if c in df.columns], *[f"`{c}`" for c in df.columns if c not in LINEAGE])


def useless_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, ignored): fields without any value, or with one different value of digits only. One aggregate over all fields."""
    value = lambda f: F.when(~T.blank(F.col(f"`{f}`")), T.strip(F.col(f"`{f}`").cast("string")))
    stats = df.agg(
        *(
            F.struct(
                F.lit(f).alias("field"), F.min(value(f)).alias("low"), F.max(value(f)).alias("high")
            ).alias(f"f{i}") for i,
            f in enumerate(fields)
        )
    )
    rows = stats.select(F.explode(F.array(*(f"f{i}" for i in range(len(fields))))).alias("x")).select("x.*")
    return rows.select(
        "field",
        (F.col("low").isNull() | ((F.col("low") == F.col("high")) & F.col("low").rlike("^[0-9]+$"))).alias("ignored")
    )


def active_fields(df: DataFrame, fields: list[str]) -> list[str]:
    gone = {r.field for r in useless_fields(df, fields).where("ignored").collect()} if fields else set()
    return [f for f in fields if f not in gone]


def empty_row(fields: list[str]):
    return reduce(lambda a, b: a & b, (T.blank(F.col(f"`{f}`")) for f in fields), F.lit(True))


def judged(df: DataFrame, fields: list[str], stem: str, phrases: bool = True) -> DataFrame:
    """df with {stem}_adr_clean and reason (null: valid): empty row, nothing left after cleaning, only administrative names.

    Each step is a column of its own, which later ones name more than once: so none is computed again, and no step's generated
    code grows beyond what the JVM compiles."""
    names, parts = df.columns, [f"_part{i}" for i in range(len(fields))]
    out = df.withColumns({p: T.strip(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit(""))) for p, f in zip(parts, fields)})
    out = out.withColumns({p: T.sanitize(F.col(p)) for p in parts})
    out = out.withColumn("_clean", T.joined_parts([F.col(p) for p in parts])).drop(*parts)
    out = out.withColumn("_clean", F.when(F.col("_clean") == "", T.fallback_address(names)).otherwise(F.col("_clean")))
    out = out.withColumn("_clean", T.dedupe_admin(F.col("_clean")))
    if phrases:
        out = out.withColumn(
            "_clean", F.when(F.length("_clean") >= 8, similarity.dedupe_phrases("_clean")).otherwise(F.col("_clean"))
        )
    reason = F.when(empty_row(fields), R.REASONS[0]).when(F.col("_clean") == "", R.REASONS[1]).when(
        T.is_pure_admin(F.col("_clean")) & ~T.has_building_info(names), R.REASONS[2]
    )
    return out.withColumn("reason", reason).withColumnRenamed("_clean", f"{stem}_adr_clean")


def partition(df: DataFrame, fields: list[str], stem: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected)."""
    rows = judged(df, fields, stem)
    return rows.where("reason is null").drop("reason"), rows.where(
        "reason is not null"
    ).drop(f"{stem}_adr_clean").withColumnRenamed("reason", "_剔除原因")


def counts(judged_rows: DataFrame) -> DataFrame:
    return judged_rows.groupBy(F.coalesce("reason", F.lit("有效")).alias("reason")).agg(F.count("*").alias("n"))


def field_warnings(df: DataFrame, fields: list[str], rid: str = "rid") -> DataFrame:
    """(field, n_sampled, has_chinese) over the first hundred values of each field."""
    def one(f):
        first = df.where(F.col(f).isNotNull()).orderBy(rid).limit(100)
        return first.agg(
            F.lit(f).alias("field"), F.count("*").alias("n_sampled"),
            F.coalesce(F.max(T.contains_chinese(F.col(f).cast("string"))), F.lit(False)).alias("has_chinese")
        )

    return reduce(DataFrame.unionByName, map(one, fields))
