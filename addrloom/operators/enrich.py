"""Address enrichment: structured parts and a predicted POI for each address, from tables of what is known already, and from a
provider for the rest.

A provider is a function from a frame of different texts to a frame of answers; it decides how texts reach a service (rates,
retries, signatures), for instance by mapInPandas. What it answers is returned too, so that it can be kept as a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..sources.shared import spread
from . import region

Provider = Callable[[DataFrame], DataFrame]
#: Column of the result -> the part's names in a structured address, the first that is there counts.
PARTS = {
    "省": ["prov", "province"], "市": ["city"], "区县": ["district"], "街道镇": ["town"], "村社区": ["village"], "道路": ["road"],
    "门牌号": ["roadNo", "roadno"], "POI_结构化": ["poi"], "楼号": ["houseno"], "单元号": ["cellno"], "房间号": ["roomno"]
}
STRUCTURES, POIS = "text string, structure map<string,string>", "std string, poi string"


def load(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A table of known answers; the last answer to a text counts."""
    return spark.read.schema(f"{schema}, batch long").parquet(folder)


def keep(answers: DataFrame, folder: str, batch: int) -> None:
    """Adds answers to a table; nothing of what is there is written again."""
    answers.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(folder)


def _known(table: DataFrame, key: str, value: str) -> DataFrame:
    if "batch" not in table.columns:
        return table
    return table.groupBy(key).agg(F.max_by(F.struct(value), "batch").alias("x")).select(key, f"x.{value}")


def _answers(
    asked: DataFrame, known: DataFrame, key: str, value: str, provider: Provider | None
) -> tuple[DataFrame, DataFrame]:
    """(all answers with cached, new answers) for the different keys that were asked."""
    old = asked.join(known, key).select(key, value).withColumn("cached", F.lit(True))
    if provider is None:
        return old, old.drop("cached").limit(0)
    new = provider(asked.join(known, key, "left_anti")).select(key, value)
    new = new.where(F.col(value).isNotNull() & (F.size(value) > 0 if value == "structure" else F.lit(True)))
    return old.unionByName(new.withColumn("cached", F.lit(False))), new


def standardise(
    rows: DataFrame, address: str, structures: DataFrame, pois: DataFrame, structure_of: Provider | None = None,
    poi_of: Provider | None = None, dims: tuple[DataFrame, DataFrame, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with the fourteen standard columns and structure_cached, poi_cached, cached; new structures; new POIs).

    structures (text, structure) and pois (std, poi) are known answers. An empty structure and a null POI are failures and are
    not kept; an empty POI is an answer. Rows without an address have empty columns. Columns of the rows stay, but for those that
    have the name of a result's. dims (provinces, cities, areas) complete
    province and city where province, city or district lacks."""
    text = T.strip(F.coalesce(F.col(f"`{address}`").cast("string"), F.lit("")))
    # The row goes along as one column, whatever its own columns are called.
    named = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), text.alias("text"))
    # Different texts are few bytes, but much work: they are dealt to all tasks again.
    asked = spread(named.select("text").where("text <> ''").distinct())
    found, new_structures = _answers(asked, _known(structures, "text", "structure"), "text", "structure", structure_of)
    part = lambda keys: F.coalesce(*(F.nullif(F.col("structure")[k], F.lit("")) for k in keys), F.lit(""))
    parsed = asked.join(found.withColumnRenamed("cached", "structure_cached"), "text", "left").select(
        "text", F.coalesce("structure_cached", F.lit(False)).alias("structure_cached"),
        *(part(k).alias(c) for c, k in PARTS.items())
    )
    keys = {
        "prov": "省", "city": "市", "district": "区县", "town": "街道镇", "village": "村社区", "road": "道路", "roadNo": "门牌号",
        "poi": "POI_结构化", "houseno": "楼号", "cellno": "单元号"
    }
    parsed = parsed.withColumn("std", T.std_address({k: F.col(c) for k, c in keys.items()}))
    wanted = spread(parsed.select("std").where("std <> ''").distinct())
    answers, new_pois = _answers(wanted, _known(pois, "std", "poi"), "std", "poi", poi_of)
    parsed = parsed.join(
        answers.select("std", F.col("poi").alias("predicted"), F.col("cached").alias("poi_cached")), "std", "left"
    )
    poi, origin = T.poi_choice(F.col("predicted"), F.col("POI_结构化"))
    parsed = parsed.withColumns(
        {"标准化POI抽取": poi, "POI来源": origin, "poi_cached": F.coalesce("poi_cached", F.lit(False))}
    )
    if dims:
        lacks = T.blank(F.col("省")) | T.blank(F.col("市")) | T.blank(F.col("区县"))
        full = region.deduce(
            parsed.withColumns({"province": F.col("省"), "city": F.col("市"), "area": F.col("区县")}), *dims
        )
        parsed = full.withColumns(
            {
                "省": F.when(lacks, F.col("province_full")).otherwise(F.col("省")),
                "市": F.when(lacks, F.col("city_full")).otherwise(F.col("市"))
            }
        )
    standard = ["标准化POI抽取", "POI来源", *PARTS]
    out = named.join(parsed, "text", "left")
    columns = [F.coalesce(c, F.lit("")).alias(c) for c in standard]
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("structure_cached", "poi_cached")]
    both = F.coalesce(F.col("structure_cached") & F.col("poi_cached"), F.lit(False)).alias("cached")
    made = {"标准化地址", *standard, "structure_cached", "poi_cached", "cached"}
    return out.select(
        *(F.col(f"row.`{c}`") for c in rows.columns if c not in made), F.coalesce("std", F.lit("")).alias("标准化地址"), *columns,
        *flags, both
    ), new_structures, new_pois


def hits(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count("*").alias("total"), F.count_if(F.col("structure_cached") | F.col("poi_cached")).alias("hits")
    )
