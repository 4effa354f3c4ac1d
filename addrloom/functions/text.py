"""Column builders over text; all of them stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import rules as R


#: What a regular expression's \\s matches.
_SPACE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def blank(c: Column) -> Column:
    """Null, empty or white space."""
    return F.coalesce(strip(c.cast("string")), F.lit("")) == ""


def sanitize(c: Column) -> Column:
    """Noise words and placeholders go in list order, then 无 before a digit, then runs of 无. Text that has none of them, as one
    look tells, is left as it is."""
    words, text = (*R.NOISE, *R.PLACEHOLDERS, "无"), c
    for word in words[:-1]:
        c = F.replace(c, F.lit(word), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, r"无(?=\d)", ""), "无{2,}", "")
    least = [w for w in words if not any(v in w for v in words if v != w)]
    some = text.rlike(f"(?=[{''.join(sorted({w[0] for w in least}))}])(?:{R.any_of(least)})")
    return strip(F.when(some, c).otherwise(text))


def contains_chinese(c: Column) -> Column:
    return F.coalesce(c.rlike("[一-龥]"), F.lit(False))


def build_clean_text(columns: list[Column]) -> Column:
    """The sanitised parts that hold Chinese, in order, without anything between them."""
    return joined_parts([sanitize(strip(F.coalesce(c.cast("string"), F.lit("")))) for c in columns])


def joined_parts(parts: list[Column]) -> Column:
    return F.concat(*(F.when(contains_chinese(p), p).otherwise("") for p in parts)) if parts else F.lit("")


def dedupe_admin(c: Column) -> Column:
    return F.when(F.length(c) >= 6, F.regexp_replace(c, r"([一-龥]{2,}(?:省|市|区|县))\1+", "$1")).otherwise(c)


def is_pure_admin(c: Column) -> Column:
    """Only names of provinces, cities and districts; digits, address words and village words speak against it."""
    text = strip(F.coalesce(c, F.lit("")))
    letters = F.regexp_replace(text, "[^一-龥]", "")
    return (
        F.when(text == "", False).when(text.rlike(r"[0-9]"), False).when(text.rlike(R.any_of(R.ADDRESS_WORDS)), False)
        .when(letters == "", True).when(
            letters.rlike(R.any_of(R.VILLAGE_WORDS)), False
        ).otherwise(letters.rlike(R.PURE_ADMIN))
    )


def fallback_address(names: list[str]) -> Column:
    """The first address-like column (in table order) whose value has Chinese and more than two letters, sanitised."""
    found = [strip(F.col(f"`{n}`").cast("string")) for n in names if any(a in n.lower() for a in R.ADDRESS_COLUMNS)]
    return F.coalesce(*(F.when(contains_chinese(c) & (F.length(c) > 2), sanitize(c)) for c in found), F.lit(""))


def has_building_info(names: list[str]) -> Column:
    def one(n):
        c = F.col(f"`{n}`").cast("string")
        named = ~strip(c).isin("", "无", "nan", "None") if any(
            b in n.lower() for b in R.BUILDING_COLUMNS
        ) else F.lit(False)
        return F.coalesce(named | c.rlike(R.any_of(R.BUILDING_WORDS)), F.lit(False))

    return reduce(lambda a, b: a | b, map(one, names), F.lit(False))


def is_pure_numeric(c: Column) -> Column:
    return F.coalesce(strip(c).rlike("^[0-9]+$"), F.lit(False))


def is_device(c: Column) -> Column:
    return F.coalesce(c.rlike("调[0-9]+|" + R.any_of(R.DEVICE_WORDS)), F.lit(False))


def clean_poi(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[0-9#\-]+", ""))


def is_admin_only(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    return text.rlike(R.ADMIN_NAME) & ~text.rlike(f"({R.any_of(R.POI_SUFFIXES)})$")


def normalize_poi(c: Column) -> Column:
    return strip(
        F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"_[0-9]+$", ""), r"（[^（）]*）|\([^()]*\)", "")
    )


def first_poi(c: Column, sep: str = ";") -> Column:
    return strip(F.substring_index(F.coalesce(c, F.lit("")), sep, 1))


def char_overlap(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    size = F.greatest(F.size(x), F.size(y))
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.size(F.array_intersect(x, y)) / size)


def length_ratio(a: Column, b: Column) -> Column:
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(high == 0, 0.0).otherwise(low / high)


def std_address(parts: dict[str, Column]) -> Column:
    """Parts of a structured address in fixed order; the room is left out."""
    plain = [parts[k] for k in ("prov", "city", "district", "town", "village", "road", "roadNo", "poi") if k in parts]
    marked = [
        F.when(~blank(parts[k]), F.concat(strip(parts[k]), F.lit(m))) for k,
        m in (("houseno", "号楼"), ("cellno", "单元")) if k in parts
    ]
    return F.concat_ws("", *(F.when(~blank(c), strip(c)) for c in plain), *marked)


def parse_kv(c: Column) -> Column:
    """'k=v k=v' to a map; the first '=' of a part counts, the last value of a key wins."""
    parts = F.filter(F.split(strip(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: F.instr(x, "=") > 1)
    return F.aggregate(
        parts, F.expr("cast(map() as map<string,string>)"),
        lambda m, x: F.map_concat(
            F.map_filter(m, lambda k, _: k != F.substring_index(x, "=", 1)),
            F.create_map(F.substring_index(x, "=", 1), F.regexp_replace(x, "^[^=]*=", ""))
        )
    )


def poi_choice(predicted: Column, structured: Column) -> tuple[Column, Column]:
    """(poi, its source)."""
    value = F.when(~blank(predicted), strip(predicted)).when(~blank(structured), strip(structured)).otherwise("")
    return value, F.when(~blank(predicted), "predict").when(~blank(structured), "structure").otherwise("empty")


def match_value(columns: list[Column]) -> Column:
    return F.concat_ws("; ", *(F.when(~blank(c), strip(c.cast("string"))) for c in columns))


def gid_norm(c: Column) -> Column:
    number = strip(c.cast("string")).try_cast("double")
    return F.when(F.abs(number) < 9.0e15, number.cast("bigint").cast("string"))


def level_label(c: Column) -> Column:
    return F.when(c == "EXACT", "精确匹配").when(
        c == "HIGH_CONFIDENCE", "高置信度"
    ).when(c == "NEED_REVIEW", "需人工确认").otherwise("未匹配")


def pair_label(c: Column) -> tuple[Column, Column]:
    """Source and target label of a 'source=target' match field."""
    parts = F.split(F.coalesce(c, F.lit("")), "=", 2)
    source, target = strip(F.get(parts, F.lit(0))), strip(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    return F.when(source == "", "匹配字段").otherwise(source), F.when(target == "", "匹配值").otherwise(target)


def wkt_kind(c: Column) -> Column:
    return F.upper(
        F.regexp_extract(
            strip(F.coalesce(c, F.lit(""))), r"(?i)^(MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|POINT|LINESTRING|POLYGON)",
            1
        )
    )


def wkt_point(c: Column) -> Column:
    n = r"\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)"
    part = lambda i: F.nullif(
        F.regexp_extract(c, r"(?i)^\s*POINT\s*(?:Z|M|ZM)?\s*\(" + n, i), F.lit("")
    ).try_cast("double")
    return F.struct(part(1).alias("x"), part(2).alias("y"))


POI_COLUMNS = ("标准化POI抽取", "predict_poi", "POI", "poi", "POI_结构化")


def poi_column(names: Column) -> Column:
    """Of a list of column names the one that has POIs, by order of preference."""
    return F.coalesce(*(F.when(F.array_contains(names, n), n) for n in POI_COLUMNS))
