"""Region dimensions (province, city, area, street) and what addresses lack of them. Dimensions are tables of the country's
divisions: their size is that of the gazetteer, not of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import blank, strip
from . import gazetteer


def dimension(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A dimension from (code, name, parent) rows."""
    return spark.createDataFrame(rows, names)


def read(spark: SparkSession, folder: str, kind: str, array: bool = True) -> DataFrame:
    """provinces, cities, areas or streets from a JSON file of an array of objects, or of one object a line, which Spark splits."""
    return spark.read.option("multiLine", array).json(f"{folder}/{kind}.json")


def first_by_name(dim: DataFrame) -> DataFrame:
    """One row per name and per name without its suffix: the first code wins."""
    names = F.array_distinct(F.array("name", F.regexp_replace("name", "(省|市|区|县|自治区|街道|镇|乡)$", "")))
    return dim.withColumn("key", F.explode(names)).where("key <> ''").groupBy("key").agg(
        F.min_by(F.struct(*dim.columns), "code").alias("d")
    )


def deduce(rows: DataFrame, provinces: DataFrame, cities: DataFrame, areas: DataFrame) -> DataFrame:
    """rows with province, city and area completed upwards: area to city, city to province (names as the dimensions have them)."""
    def look(df, key, dim, name):
        found = first_by_name(dim).select(F.col("key").alias(f"_k{name}"), F.col("d").alias(f"_{name}"))
        return df.join(F.broadcast(found), strip(F.coalesce(F.col(key), F.lit(""))) == F.col(f"_k{name}"), "left")

    by_code = lambda dim, name: F.broadcast(
        dim.select(
            F.col("code").alias(f"_c{name}"), F.col("name").alias(f"_n{name}"),
            *([F.col("provinceCode").alias(f"_p{name}")] if "provinceCode" in dim.columns else [])
        )
    )
    out = look(rows, "area", areas, "area").join(
        by_code(cities, "up"), F.col("_area.cityCode") == F.col("_cup"), "left"
    )
    city = F.when(~blank(F.col("city")), strip(F.col("city"))).otherwise(F.coalesce("_nup", F.lit("")))
    out = look(out.withColumn("city_", city), "city_", cities, "city").join(
        by_code(provinces, "top"), F.coalesce(F.col("_city.provinceCode"), F.col("_pup")) == F.col("_ctop"), "left"
    )
    province = F.when(~blank(F.col("province")), strip(F.col("province"))).otherwise(F.coalesce("_ntop", F.lit("")))
    method = F.when(
        ~blank(F.col("province")) & ~blank(F.col("city")), "given"
    ).when(F.col("_nup").isNotNull() & blank(F.col("city")), "area").when(
        F.col("_ntop").isNotNull() & blank(F.col("province")), "city"
    ).otherwise("none")
    sure = F.when(method == "area", 0.9).when(method == "city", 0.95).when(method == "given", 1.0).otherwise(0.0)
    return out.select(
        *rows.columns, province.alias("province_full"), F.col("city_").alias("city_full"), method.alias("method"),
        sure.alias("confidence")
    )


def valid(rows: DataFrame, provinces: DataFrame, cities: DataFrame, areas: DataFrame) -> DataFrame:
    """rows (rid, province, city, area) with valid: the area is of the city and the city of the province, by name with or
    without suffix. Every reading of an ambiguous name counts."""
    short = lambda c: F.regexp_replace(c, "(省|市|区|县|自治区)$", "")
    chain = areas.select(F.col("name").alias("an"), "cityCode").join(
        cities.select(F.col("code").alias("cc"), F.col("name").alias("cn"), "provinceCode"),
        F.col("cityCode") == F.col("cc")
    ).join(provinces.select(F.col("code").alias("pc"), F.col("name").alias("pn")), F.col("provinceCode") == F.col("pc"))
    keys = F.broadcast(
        chain.select(
            short(F.col("pn")).alias("p"), short(F.col("cn")).alias("c"), short(F.col("an")).alias("a")
        ).distinct().withColumn("ok", F.lit(True))
    )
    return rows.join(
        keys,
        (
            short(F.col("province")) == F.col("p")
        ) & (short(F.col("city")) == F.col("c")) & (short(F.col("area")) == F.col("a")),
        "left"
    ).select(*rows.columns, F.coalesce("ok", F.lit(False)).alias("valid"))


def areas_in(city: str, cities: DataFrame, areas: DataFrame) -> DataFrame:
    return areas.join(
        F.broadcast(cities.where(F.col("name") == city).select(F.col("code").alias("c"))),
        F.col("cityCode") == F.col("c"), "left_semi"
    ).select("code", "name")


#: The endings of street names, longest first.
STREET_ENDS = ["街道办事处", "办事处", "街道", "镇", "乡"]
AREA_ENDS, CITY_ENDS = ["自治县", "自治旗", "区", "县", "市", "旗"], ["市", "地区", "盟"]


def _ending(ends: list[str]) -> str:
    return f"({'|'.join(ends)})$"


def _around(found: DataFrame) -> DataFrame:
    """With before, the letter before a place (empty at the start), and after, the rest of the text from its end on."""
    return found.withColumns({
        "before": F.when(F.col("at") > 0, F.expr("substring(text, at, 1)")).otherwise(""),
        "after": F.expr("substring(text, at + length(name) + 1)")
    })


def extract_area(rows: DataFrame, areas: DataFrame, address: str = "address") -> DataFrame:
    """(rid, area): the known area name in an address. Names right after the suffix of a city count most, then the longest
    (ten more for autonomous ones that do not count otherwise), then the last by name; a name that goes on as a zone or a
    division does not count, nor one right after a province's suffix unless it is autonomous."""
    texts = rows.select("rid", F.col(address).cast("string").alias("text"))
    names = areas.select("name").where("name rlike '^[一-龥]{2,10}[区县旗]$'")
    found = _around(gazetteer.places(texts, names))
    length, usual = F.length("name"), F.length("name").between(3, 7)
    priority = F.when(F.col("before").isin(*"市州盟") & usual, 100).when(
        (F.col("before") != "省") & ~F.col("after").rlike("^[域划]") & usual, length
    ).when(F.col("name").rlike("自治[县旗]$"), length + 10)
    best = found.withColumn("priority", priority).where("priority is not null").groupBy("rid").agg(
        F.max(F.struct("priority", "name")).alias("x")
    )
    return rows.select("rid").join(best, "rid", "left").select("rid", F.coalesce("x.name", F.lit("")).alias("area"))


def extract_street(rows: DataFrame, streets: DataFrame, address: str = "address") -> DataFrame:
    """(rid, street): the longest known street name with one of the endings in an address, the last by name among those; a name
    that goes on as a village does not count. Else the first place of a known street with another ending than its own, the
    longest there, as the address has it."""
    texts = rows.select("rid", F.col(address).cast("string").alias("text"))
    whole = streets.select("name").where(F.col("name").rlike(_ending(STREET_ENDS))).distinct()
    short = whole.select(F.regexp_replace("name", _ending(STREET_ENDS), "").alias("s")).where("length(s) >= 2").distinct()
    other = short.select(F.explode(F.array(*(F.concat("s", F.lit(e)) for e in STREET_ENDS))).alias("name")).join(
        whole, "name", "left_anti"
    ).distinct()
    names = whole.withColumn("known", F.lit(True)).unionByName(other.withColumn("known", F.lit(False)))
    found = _around(gazetteer.places(texts, names)).join(names, "name")
    found = found.where("not (name rlike '[镇乡]$' and startswith(after, '村'))")
    place = F.when(F.col("known"), 0).otherwise(-F.col("at"))
    best = found.groupBy("rid").agg(
        F.max_by("name", F.struct("known", place.alias("place"), F.length("name").alias("n"), "name")).alias("street")
    )
    return rows.select("rid").join(best, "rid", "left").select("rid", F.coalesce("street", F.lit("")).alias("street"))


def chains(provinces: DataFrame, cities: DataFrame, areas: DataFrame, streets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What lies above a city, an area and a street, by name and by name without its suffix (the first code wins): a key, and
    the names province, city and area as far as they go."""
    up = cities.select("code", F.col("name").alias("city"), F.col("provinceCode").alias("p")).join(
        provinces.select(F.col("code").alias("p"), F.col("name").alias("province")), "p", "left"
    )
    of_area = areas.select("code", F.col("name").alias("area"), F.col("cityCode").alias("c")).join(
        up.select(F.col("code").alias("c"), "province", "city"), "c", "left"
    )
    of_street = streets.select("code", F.col("name").alias("street"), F.col("areaCode").alias("a")).join(
        of_area.select(F.col("code").alias("a"), "province", "city", "area"), "a", "left"
    )

    def by(dim, name, ends, *columns):
        keys = F.array_distinct(F.array(name, F.regexp_replace(name, _ending(ends), "")))
        return dim.withColumn("key", F.explode(keys)).where("key <> ''").groupBy("key").agg(
            F.min_by(F.struct(*columns), "code").alias("d")
        )

    return (
        by(up, "city", CITY_ENDS, "province"), by(of_area, "area", AREA_ENDS, "province", "city"),
        by(of_street, "street", STREET_ENDS, "province", "city", "area")
    )


def _above(rows: DataFrame, of: str, dim: DataFrame, ends: list[str]) -> DataFrame:
    """rows with d, what lies above a name: as it is or, where that is not known, without its suffix."""
    exact, short = dim.select(F.col("key").alias("k1"), F.col("d").alias("d1")), dim.select(F.col("key").alias("k2"), F.col("d").alias("d2"))
    bare = F.regexp_replace(of, _ending(ends), "")
    out = rows.join(exact, F.col(of) == F.col("k1"), "left").join(short, bare == F.col("k2"), "left")
    return out.withColumn("d", F.when(F.col("k1").isNotNull(), F.col("d1")).otherwise(F.col("d2"))).drop("k1", "k2", "d1", "d2")


def complete(rows: DataFrame, provinces: DataFrame, cities: DataFrame, areas: DataFrame, streets: DataFrame) -> DataFrame:
    """rid, province, city, area, street, confidence and method of rows (rid, address and what is known of the four).

    Area and street are looked for in the address where they are not given. Then what lacks is filled from the area (0.9,
    area_lookup), from the street (0.85 at least, street_lookup) and the province from the city (0.95 at least, city_lookup);
    the last step that filled anything names the method, none if there was none. Dimensions are joined, whatever their size."""
    of_city, of_area, of_street = chains(provinces, cities, areas, streets)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    known = rows.select("rid", "address", *(text(c) for c in ("province", "city", "area", "street")))
    found = known.join(
        extract_area(known, areas).withColumnRenamed("area", "area_"), "rid"
    ).join(extract_street(known, streets).withColumnRenamed("street", "street_"), "rid")
    or_else = lambda c, x: F.when(F.col(c) == "", F.coalesce(x, F.lit(""))).otherwise(F.col(c))
    now = found.withColumns({
        "area": or_else("area", F.col("area_")), "street": or_else("street", F.col("street_")), "confidence": F.lit(0.0),
        "method": F.lit("none")
    }).drop("area_", "street_", "address")
    steps = [
        ("area", of_area, AREA_ENDS, ["province", "city"], 0.9), ("city", of_city, CITY_ENDS, ["province"], 0.95)
    ]
    steps.insert(1, ("street", of_street, STREET_ENDS, ["province", "city", "area"], 0.85))
    for of, dim, ends, lacking, sure in steps:
        lacks = reduce(Column.__or__, (F.col(c) == "" for c in lacking)) & (F.col(of) != "")
        now = _above(now, of, dim, ends).withColumn("hit", lacks & F.col("d").isNotNull())
        filled = {c: F.when(F.col("hit"), or_else(c, F.col(f"d.{c}"))).otherwise(F.col(c)) for c in lacking}
        surer = F.when(F.col("hit"), F.greatest("confidence", F.lit(sure))).otherwise(F.col("confidence"))
        method = F.when(F.col("hit"), f"{of}_lookup").otherwise(F.col("method"))
        now = now.withColumns(filled | {"confidence": surer, "method": method}).drop("d", "hit")
    return now


def fill(parsed: dict[str, Column], completed: dict[str, Column]) -> dict[str, Column]:
    """Parsed parts stay unless province, city or district lacks: then completed values go first."""
    lacks = blank(parsed["province"]) | blank(parsed["city"]) | blank(parsed["district"])
    return {
        k: F.when(lacks, F.coalesce(F.when(~blank(completed[k]), completed[k]), parsed[k])).otherwise(parsed[k])
        for k in parsed
    }
