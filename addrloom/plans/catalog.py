"""Queries over text functions, cleaning, joins, regions, profiles and validation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo, geodesic, rules as R, similarity, text as T
from ..operators import clean, communities, join, lineage, match, profile, region, validate
from ..sources import discovery, layers, readers, shared, sinks
from .fixtures import FRAMES, frame
from .registry import FIELDS, QUERIES, SQL, add, blank_sql, sanitize_sql, strip_sql

# Scalar functions -----------------------------------------------------------------------------------------------------

def scalar(name: str, frames: str, column, sql: str | None, rid: str = "rid") -> None:
    add(
        name, frames, lambda df: df.select(rid, column().alias("value")),
        sql and f"SELECT {rid}, {sql} AS value FROM {frames}"
    )


CLEAN_SQL = "concat(" + ", ".join(
    f"CASE WHEN regexp_matches({s}, '[一-龥]') THEN {s} ELSE '' END"
    for s in (sanitize_sql(strip_sql(f"coalesce({f}, '')")) for f in FIELDS)
) + ")"
PURE_SQL = f"""CASE WHEN {{s}} = '' THEN false WHEN regexp_matches({{s}}, '[0-9]') THEN false WHEN regexp_matches({{s}}, '{R.any_of(R.ADDRESS_WORDS)}') THEN false
  WHEN regexp_replace({{s}}, '[^一-龥]', '', 'g') = '' THEN true WHEN regexp_matches(regexp_replace({{s}}, '[^一-龥]', '', 'g'), '{R.any_of(R.VILLAGE_WORDS)}') THEN false
  ELSE regexp_matches(regexp_replace({{s}}, '[^一-龥]', '', 'g'), '{R.PURE_ADMIN}') END"""


def pure_sql(c: str) -> str:
    return PURE_SQL.replace("{s}", strip_sql(f"coalesce({c}, '')"))


FALLBACK_SQL = f"CASE WHEN regexp_matches({strip_sql('location')}, '[一-龥]') AND length({strip_sql('location')}) > 2 THEN {sanitize_sql(strip_sql('location'))} ELSE '' END"
scalar("sanitize", "addr", lambda: T.sanitize(F.coalesce("street", F.lit(""))), sanitize_sql("coalesce(street, '')"))
scalar(
    "contains_chinese", "addr", lambda: T.contains_chinese(F.col("location")),
    "coalesce(regexp_matches(location, '[一-龥]'), false)"
)
scalar("build_clean_text", "addr", lambda: T.build_clean_text([F.col(f) for f in FIELDS]), CLEAN_SQL)
scalar(
    "dedupe_admin", "addr",
    lambda: T.dedupe_admin(
        F.concat(F.coalesce("city", F.lit("")), F.coalesce("city", F.lit("")), F.coalesce("street", F.lit("")))
    ),
    "concat(coalesce(city, ''), coalesce(street, ''))"
)
#: A step of the search for later copies of phrases, from cut (rid, t, size, i), which ends with a size of 3.
CUT_SQL = """SELECT rid, CASE WHEN i + size <= length(t) AND p > 0 THEN substr(t, 1, i + size + p - 1) || substr(t, i + size + p + size) ELSE t END,
    CASE WHEN i + size > length(t) THEN size - 1 ELSE size END, CASE WHEN i + size > length(t) THEN 0 WHEN p > 0 THEN i ELSE i + 1 END
  FROM (SELECT *, instr(substr(t, i + size + 1), substr(t, i + 1, size)) AS p FROM cut WHERE size >= 4)"""
_PHRASES = "concat(coalesce(street, ''), coalesce(poi, ''), coalesce(street, ''))"
add(
    "dedupe_phrases", "addr", lambda df: df.select("rid", similarity.dedupe_phrases(
        F.concat(F.coalesce("street", F.lit("")), F.coalesce("poi", F.lit("")), F.coalesce("street", F.lit("")))
    ).alias("value")),
    f"cut(rid, t, size, i) AS (SELECT rid, {_PHRASES}, 15, 0 FROM addr UNION ALL {CUT_SQL}) SELECT rid, t AS value FROM cut WHERE size = 3"
)
SQL["dedupe_phrases"] = SQL["dedupe_phrases"].replace("WITH ", "WITH RECURSIVE ", 1)
scalar(
    "pure_admin_region", "addr", lambda: T.is_pure_admin(F.concat_ws("", "province", "city")),
    pure_sql("concat_ws('', province, city)")
)
scalar(
    "fallback_address", "addr", lambda: T.fallback_address(["rid", "province", "location"]),
    f"coalesce({FALLBACK_SQL}, '')"
)
BUILDING_SQL = "(" + " OR ".join(
    f"coalesce(regexp_matches(CAST({c} AS VARCHAR), '{R.any_of(R.BUILDING_WORDS)}'), false)"
    for c in ["rid", *FIELDS, "location", "const_code", "nothing"]
) + ")"
ADDR = ["rid", *FIELDS, "location", "const_code", "nothing"]
scalar("has_building_info", "addr", lambda: T.has_building_info(ADDR), BUILDING_SQL)
scalar(
    "is_pure_numeric", "addr", lambda: T.is_pure_numeric(F.col("location")),
    f"coalesce(regexp_matches({strip_sql('location')}, '^[0-9]+$'), false)"
)
scalar(
    "is_non_poi_device", "addr", lambda: T.is_device(F.col("poi")),
    f"coalesce(regexp_matches(poi, '调[0-9]+|{R.any_of(R.DEVICE_WORDS)}'), false)"
)
CLEAN_POI_SQL = strip_sql("regexp_replace(coalesce({c}, ''), '[0-9#\\-]+', '', 'g')")
scalar("clean_poi_for_fuzzy", "addr", lambda: T.clean_poi(F.col("poi")), CLEAN_POI_SQL.replace("{c}", "poi"))
ADMIN_SQL = f"(regexp_matches({{s}}, '{R.ADMIN_NAME}') AND NOT regexp_matches({{s}}, '({R.any_of(R.POI_SUFFIXES)})$'))"
scalar(
    "is_admin_only", "addr", lambda: T.is_admin_only(F.col("poi")),
    ADMIN_SQL.replace("{s}", strip_sql("coalesce(poi, '')"))
)
NORMAL_SQL = strip_sql(
    r"regexp_replace(regexp_replace(" + strip_sql("coalesce(poi, '')")
    + r", '_[0-9]+$', '', 'g'), '（[^（）]*）|\([^()]*\)', '', 'g')"
)
scalar("normalize_poi", "addr", lambda: T.normalize_poi(F.col("poi")), NORMAL_SQL)
scalar("first_poi", "addr", lambda: T.first_poi(F.col("poi")), strip_sql("split_part(coalesce(poi, ''), ';', 1)"))
OVERLAP_SQL = "CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE CAST(len(list_intersect(list_distinct(string_split({a}, '')), list_distinct(string_split({b}, '')))) AS DOUBLE) / greatest(len(list_distinct(string_split({a}, ''))), len(list_distinct(string_split({b}, '')))) END"
scalar(
    "char_overlap", "addr",
    lambda: F.round(T.char_overlap(F.coalesce("street", F.lit("")), F.coalesce("poi", F.lit(""))), 6),
    "round(" + OVERLAP_SQL.replace("{a}", "coalesce(street, '')").replace("{b}", "coalesce(poi, '')") + ", 6)"
)
LENGTH_SQL = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0 ELSE CAST(least(length({a}), length({b})) AS DOUBLE) / greatest(length({a}), length({b})) END"
scalar(
    "length_ratio", "addr",
    lambda: F.round(T.length_ratio(F.coalesce("street", F.lit("")), F.coalesce("poi", F.lit(""))), 6),
    "round(" + LENGTH_SQL.replace("{a}", "coalesce(street, '')").replace("{b}", "coalesce(poi, '')") + ", 6)"
)
KV = ["prov", "city", "road", "poi", "houseno"]
KV_SQL = {k: f"nullif(regexp_extract(structure, '(^|\\s){k}=(\\S*)', 2), '')" for k in KV}
TEN = ["prov", "city", "district", "town", "village", "road", "roadNo", "poi", "houseno", "cellno"]
TEN_SQL = {k: f"nullif(regexp_extract(structure, '(^|\\s){k}=(\\S*)', 2), '')" for k in [*TEN, "roomno"]}
STD_SQL = f"concat_ws('', {', '.join(TEN_SQL[k] for k in TEN[:8])}, {TEN_SQL['houseno']} || '号楼', {TEN_SQL['cellno']} || '单元')"
scalar("std_address", "kv10", lambda: T.std_address({k: T.parse_kv(F.col("structure"))[k] for k in TEN}), STD_SQL)
add(
    "parse_kv", "kv",
    lambda df: df.select("rid", *(F.coalesce(T.parse_kv(F.col("structure"))[k], F.lit("")).alias(k) for k in KV)),
    "SELECT rid, " + ", ".join(f"coalesce({KV_SQL[k]}, '') AS {k}" for k in KV) + " FROM kv"
)


def _poi_choice(df):
    poi, origin = T.poi_choice(F.col("predicted"), T.parse_kv(F.col("structure"))["poi"])
    return df.select("rid", poi.alias("poi"), origin.alias("origin"))


add(
    "poi_choice", "kv", _poi_choice,
    f"SELECT rid, CASE WHEN NOT {blank_sql('predicted')} THEN {strip_sql('predicted')} ELSE coalesce({KV_SQL['poi']}, '') END AS poi, CASE WHEN NOT {blank_sql('predicted')} THEN 'predict' WHEN {KV_SQL['poi']} IS NOT NULL THEN 'structure' ELSE 'empty' END AS origin FROM kv"
)
scalar(
    "match_value", "addr", lambda: T.match_value([F.col(f) for f in FIELDS]),
    "concat_ws('; ', " + ", ".join(f"CASE WHEN NOT {blank_sql(f)} THEN {strip_sql(f)} END" for f in FIELDS) + ")"
)
scalar(
    "gid_norm", "rows_", lambda: T.gid_norm(F.col("gid")),
    "CAST(CAST(trunc(TRY_CAST(gid AS DOUBLE)) AS BIGINT) AS VARCHAR)"
)
scalar(
    "level_label", "tgt",
    lambda: T.level_label(
        F.element_at(
            F.split(F.lit("EXACT,HIGH_CONFIDENCE,NEED_REVIEW,UNMATCHED"), ","), (F.col("rid") % 4 + 1).cast("int")
        )
    ),
    "split_part('精确匹配,高置信度,需人工确认,未匹配', ',', CAST(rid % 4 + 1 AS INT))"
)


def _pair_label(df):
    field = F.element_at(F.split(F.lit("名称=name;=b;地址;a=b=c"), ";"), (F.col("rid") % 4 + 1).cast("int"))
    source, target = T.pair_label(field)
    return df.select("rid", source.alias("source_label"), target.alias("target_label"))


add(
    "field_pair_label", "tgt", _pair_label,
    "SELECT rid, split_part('名称;匹配字段;地址;a', ';', CAST(rid % 4 + 1 AS INT)) AS source_label, split_part('name;b;匹配值;b=c', ';', CAST(rid % 4 + 1 AS INT)) AS target_label FROM tgt"
)


def _wkt(df):
    wkt = F.when(
        F.col("rid") % 3 == 0, F.concat(F.lit("point ("), F.col("rid").cast("string"), F.lit(" 2.5)"))
    ).when(F.col("rid") % 3 == 1, "MULTIPOLYGON (((0 0, 1 1, 1 0)))").otherwise("none")
    return df.select("rid", T.wkt_kind(wkt).alias("kind"), T.wkt_point(wkt).x.alias("x"), T.wkt_point(wkt).y.alias("y"))


add(
    "wkt_point", "tgt", _wkt,
    "SELECT rid, CASE rid % 3 WHEN 0 THEN 'POINT' WHEN 1 THEN 'MULTIPOLYGON' ELSE '' END AS kind, CASE WHEN rid % 3 = 0 THEN CAST(rid AS DOUBLE) END AS x, CASE WHEN rid % 3 = 0 THEN 2.5::DOUBLE END AS y FROM tgt"
)

# Cleaning -------------------------------------------------------------------------------------------------------------
add(
    "lineage_cols", "addr", lambda df: clean.lineage(df.select("rid", "province"), "custs"),
    "SELECT rid, province, concat('custs_', CAST(rid + 2 AS VARCHAR)) AS _record_id, 'custs' AS _source_file, CAST(rid + 2 AS INTEGER) AS _source_row FROM addr"
)
add(
    "ids_first", "addr", lambda df: clean.ids_first(clean.lineage(df.select("rid", "city"), "custs")),
    "SELECT concat('custs_', CAST(rid + 2 AS VARCHAR)) AS _record_id, 'custs' AS _source_file, CAST(rid + 2 AS INTEGER) AS _source_row, rid, city FROM addr"
)
_IGNORED = ["province", "location", "const_code", "nothing"]
add(
    "ignore_fields", "addr", lambda df: clean.useless_fields(df, _IGNORED),
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, (count(nullif({strip_sql(f)}, '')) = 0 OR (min(nullif({strip_sql(f)}, '')) = max(nullif({strip_sql(f)}, '')) AND regexp_matches(min(nullif({strip_sql(f)}, '')), '^[0-9]+$'))) AS ignored FROM addr"
        for f in _IGNORED
    )
)
EMPTY_SQL = "(" + " AND ".join(map(blank_sql, FIELDS)) + ")"
add(
    "empty_row", "addr", lambda df: df.select("rid", clean.empty_row(FIELDS).alias("empty")),
    f"SELECT rid, {EMPTY_SQL} AS empty FROM addr"
)
JUDGED_SQL = f"j AS (SELECT rid, CASE WHEN {CLEAN_SQL} = '' THEN coalesce({FALLBACK_SQL}, '') ELSE {CLEAN_SQL} END AS clean, {EMPTY_SQL} AS e, {BUILDING_SQL} AS b FROM addr), k AS (SELECT rid, clean, CASE WHEN e THEN '{R.REASONS[0]}' WHEN clean = '' THEN '{R.REASONS[1]}' WHEN {pure_sql('clean')} AND NOT b THEN '{R.REASONS[2]}' END AS reason FROM j)"


def _judged(df, phrases=False):
    return clean.judged(df, FIELDS, "custs", phrases)


add(
    "clean_partition", "addr", lambda df: _judged(df).select("rid", F.col("custs_adr_clean").alias("clean"), "reason"),
    JUDGED_SQL + " SELECT rid, clean, reason FROM k"
)
add(
    "clean_counts", "addr", lambda df: clean.counts(_judged(df)),
    JUDGED_SQL + " SELECT coalesce(reason, '有效') AS reason, count(*) AS n FROM k GROUP BY 1"
)
_J, _K = JUDGED_SQL.split(", k AS ", 1)
add(
    "clean_file", "addr", lambda df: clean.judged(df, FIELDS, "custs").select("rid", "custs_adr_clean", "reason"),
    _J.replace("j AS (", "j0 AS (", 1) + f""", cut(rid, t, size, i) AS (SELECT rid, clean, CASE WHEN length(clean) >= 8 THEN 15 ELSE 3 END, 0 FROM j0 UNION ALL {CUT_SQL}),
j AS (SELECT rid, t AS clean, e, b FROM cut JOIN j0 USING (rid) WHERE size = 3), k AS {_K} SELECT rid, clean AS custs_adr_clean, reason FROM k"""
)
SQL["clean_file"] = SQL["clean_file"].replace("WITH ", "WITH RECURSIVE ", 1)
add(
    "check_field_config", "addr", lambda df: clean.field_warnings(df, ["province", "location"]),
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) AS n_sampled, coalesce(bool_or(regexp_matches({f}, '[一-龥]')), false) AS has_chinese FROM (SELECT {f} FROM addr WHERE {f} IS NOT NULL ORDER BY rid LIMIT 100)"
        for f in ("province", "location")
    )
)
add(
    "file_quality", "addr", lambda df: profile.file_quality(df, ["poi", "district"]),
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, round(avg(CASE WHEN {blank_sql(f)} THEN 0 ELSE 1 END), 6) AS filled FROM addr"
        for f in ("poi", "district")
    )
)

# Joins and predicates -------------------------------------------------------------------------------------------------
_A, _B = "SELECT c_custkey, nullif(c_nationkey % 7, 0) AS k FROM customer", "SELECT s_suppkey, nullif(s_nationkey % 7, 0) AS k2 FROM supplier"

#: Whole tables whose keys leave some of the other side's without a partner.
_FEW_A, _FEW_B = "SELECT c_custkey, nullif(c_nationkey % 4, 0) AS k FROM customer", "SELECT s_suppkey, nullif(s_nationkey % 4, 0) AS k2 FROM supplier"


def joined(kind, on="k2"):
    return lambda spark, sf_dir: join.export(frame(spark, sf_dir, _A), frame(spark, sf_dir, _B), "k", on, kind)


QUERIES["join_inner"] = joined("inner")
SQL["join_inner"] = f'SELECT a.c_custkey AS "[A]c_custkey", a.k AS "【关联A】k", b.s_suppkey AS "[B]s_suppkey", b.k2 AS "【关联B】k2" FROM ({_A}) a JOIN ({_B}) b ON a.k IS NOT DISTINCT FROM b.k2'
QUERIES["join_left_anti"] = lambda spark, sf_dir: join.left_anti(
    frame(spark, sf_dir, _A), frame(spark, sf_dir, _FEW_B), "k", "k2"
)
SQL["join_left_anti"] = f"SELECT * FROM ({_A}) a WHERE NOT EXISTS (SELECT 1 FROM ({_FEW_B}) b WHERE a.k = b.k2)"
QUERIES["join_right_anti"] = lambda spark, sf_dir: join.right_anti(
    frame(spark, sf_dir, _FEW_A), frame(spark, sf_dir, _B), "k", "k2"
)
SQL["join_right_anti"] = f"SELECT * FROM ({_B}) b WHERE NOT EXISTS (SELECT 1 FROM ({_FEW_A}) a WHERE a.k = b.k2)"
QUERIES["join_export"] = lambda spark, sf_dir: join.export(
    frame(spark, sf_dir, _A), frame(spark, sf_dir, _B), "k", "k2", "left_anti"
)
SQL["join_export"] = f"SELECT * FROM ({_A}) a WHERE NOT EXISTS (SELECT 1 FROM ({_B}) b WHERE a.k = b.k2)"
_KA = "lower(" + strip_sql("{t}.ka") + ")"
EXACT_SQL = f"SELECT lid, rid, 1.0::DOUBLE AS confidence FROM lt JOIN rt ON {_KA.replace('{t}', 'lt')} = {_KA.replace('{t}', 'rt')} WHERE {_KA.replace('{t}', 'lt')} <> ''"
_MK = "concat(coalesce(" + _KA + ", ''), '|', coalesce({t}.kb, ''))"
MULTI_SQL = f"SELECT lid, rid, 1.0::DOUBLE AS confidence FROM lt JOIN rt ON {_MK.replace('{t}', 'lt')} = {_MK.replace('{t}', 'rt')} WHERE {_MK.replace('{t}', 'lt')} <> '|' AND {_MK.replace('{t}', 'rt')} <> '|'"
_PAIRS = [("ka", "ka"), ("kb", "kb")]
add("me_exact", "lt rt", lambda l, r: join.exact(l, r, "ka", "ka"), EXACT_SQL)
add("me_multi_field", "lt rt", lambda l, r: join.multi_field(l, r, _PAIRS), MULTI_SQL)
add(
    "me_batch", "lt rt", lambda l, r: join.batch([join.multi_field(l, r, _PAIRS), join.exact(l, r, "ka", "ka")]),
    f"u AS (SELECT *, 0 AS strategy FROM ({MULTI_SQL}) UNION ALL SELECT *, 1 FROM ({EXACT_SQL})) SELECT lid, rid, confidence, strategy FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY strategy, rid) AS n FROM u) WHERE n = 1"
)
_ROWS = [
    ("AND", "c_nationkey", ">=", 3), ("AND", "c_mktsegment", "LIKE", "U"), ("OR", "c_acctbal", "<", 0),
    ("AND", "c_nationkey", "IN", [1, 2, 5]), ("AND", "c_name", "IS NOT NULL", None)
]
QUERIES["filter_builder"] = lambda spark, sf_dir: spark.read.parquet(
    f"{sf_dir}/customer.parquet"
).where(join.predicate(_ROWS)).select("c_custkey", "c_nationkey")
SQL[
    "filter_builder"
] = "SELECT c_custkey, c_nationkey FROM customer WHERE (((c_nationkey >= 3 AND c_mktsegment LIKE '%U%') OR c_acctbal < 0) AND c_nationkey IN (1, 2, 5)) AND c_name IS NOT NULL"
_KINDS = ["=", "LIKE", "包含", "被包含", "前缀", "后缀"]
_NAMES = "SELECT n_nationkey, n_name, r_name FROM nation, region"
QUERIES["pair_predicates"] = lambda spark, sf_dir: frame(spark, sf_dir, _NAMES).select(
    "n_nationkey", "r_name",
    *(join.pair_predicate(F.col("n_name"), F.substring("r_name", 1, 1), k).alias(f"p{i}") for i, k in enumerate(_KINDS))
)
SQL[
    "pair_predicates"
] = f"SELECT n_nationkey, r_name, n_name = f AS p0, contains(n_name, f) AS p1, contains(n_name, f) AS p2, contains(f, n_name) AS p3, starts_with(n_name, f) AS p4, ends_with(n_name, f) AS p5 FROM (SELECT *, substr(r_name, 1, 1) AS f FROM ({_NAMES}))"
add(
    "remaining_rows", "src tgt", lambda s, t: join.remaining(s, match.exact_by(s, t, "core")).select("rid", "core"),
    f"SELECT rid, core FROM src WHERE NOT coalesce({strip_sql('core')} IN (SELECT {strip_sql('core')} FROM tgt WHERE core <> ''), false)"
)
add(
    "head_n", "src", lambda s: join.head(s, 10).select("rid", "core"), "SELECT rid, core FROM src ORDER BY rid LIMIT 10"
)
add(
    "sample_n", "src", lambda s: join.sample(s, 1000).select("rid", "core"),
    "SELECT rid, core FROM src ORDER BY md5(concat('42:', CAST(rid AS VARCHAR))), rid LIMIT 1000"
)
add(
    "paginate", "src", lambda s: join.page(s, 3).select("rid", "poi"),
    "SELECT rid, poi FROM src ORDER BY rid LIMIT 100 OFFSET 200"
)
#: Lists of column names, chosen by row.
_LISTS = ["a|POI|poi|predict_poi", "poi|x", "名称", "POI_结构化|POI", "标准化POI抽取|predict_poi"]


def _column_lists(df, lists):
    return df.select(
        "rid",
        F.split(
            F.element_at(F.array(*map(F.lit, lists)), (F.col("rid") % len(lists) + 1).cast("int")), "\\|"
        ).alias("names")
    )


def _lists_sql(lists):
    return f"(SELECT rid, string_split(([{', '.join(repr(x) for x in lists)}])[CAST(rid % {len(lists)} + 1 AS INT)], '|') AS names FROM tgt)"


add("detect_poi_column", "tgt", lambda df: _column_lists(df, _LISTS).select(
    "rid", T.poi_column(F.col("names")).alias("found")
),
    f"SELECT rid, list_filter(['标准化POI抽取', 'predict_poi', 'POI', 'poi', 'POI_结构化'], lambda x: list_contains(names, x))[1] AS found FROM {_lists_sql(_LISTS)}")

# Region ---------------------------------------------------------------------------------------------------------------


def _region_dim(spark, sf_dir):
    """The dimension as a JSON file in the shared folder."""
    folder = f"{shared.home(spark)}/{uuid.uuid4().hex}"
    frame(spark, sf_dir, "towns").agg(
        F.to_json(F.collect_list(F.struct("*"))).alias("value")
    ).coalesce(1).write.text(f"{folder}/cities.json")
    return region.first_by_name(region.read(spark, folder, "cities")).select("key", "d.*")


QUERIES["read_region_dim"] = _region_dim
SQL["read_region_dim"] = f"""WITH towns AS ({FRAMES['towns']}), n AS (SELECT *, unnest(list_distinct([name, regexp_replace(name, '(省|市|区|县|自治区|街道|镇|乡)$', '')])) AS key FROM towns)
SELECT key, code, name, provinceCode FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY code) AS r FROM n) WHERE r = 1"""
_LOOK = "(SELECT {what} FROM {dim} d WHERE d.name = {v} OR regexp_replace(d.name, '(省|市|区|县|自治区|街道|镇|乡)$', '') = {v} ORDER BY d.code LIMIT 1)"
DEDUCE_SQL = f"""r1 AS (SELECT *, (SELECT name FROM cities c WHERE c.code = {_LOOK.format(what='d.cityCode', dim='areas', v='places.area')}) AS up FROM places),
r2 AS (SELECT *, CASE WHEN coalesce(city, '') <> '' THEN city ELSE coalesce(up, '') END AS city_full FROM r1),
r3 AS (SELECT *, (SELECT name FROM provinces p WHERE p.code = coalesce({_LOOK.format(what='d.provinceCode', dim='cities', v='r2.city_full')}, (SELECT provinceCode FROM cities c WHERE c.name = r2.up))) AS top FROM r2),
r4 AS (SELECT *, CASE WHEN province <> '' THEN province ELSE coalesce(top, '') END AS province_full, CASE WHEN province <> '' AND coalesce(city, '') <> '' THEN 'given' WHEN up IS NOT NULL AND coalesce(city, '') = '' THEN 'area' WHEN top IS NOT NULL AND province = '' THEN 'city' ELSE 'none' END AS method FROM r3)"""
add(
    "region_deduce", "places provinces cities areas",
    lambda r, p, c, a: region.deduce(r, p, c, a).select("rid", "province_full", "city_full"),
    DEDUCE_SQL + " SELECT rid, province_full, city_full FROM r4"
)
_ENDS = "(街道办事处|办事处|街道|镇|乡)$"
#: Areas and streets named in the addresses of a table t (rid, address).
EXTRACT_SQL = f"""at_ AS (SELECT rid, address, unnest(range(1, length(address) + 1)) AS i FROM {{t}}),
af AS (SELECT rid, name, CASE WHEN i > 1 AND substr(address, i - 1, 1) IN ('市', '州', '盟') AND length(name) BETWEEN 3 AND 7 THEN 100
    WHEN NOT (i > 1 AND substr(address, i - 1, 1) = '省') AND NOT substr(address, i + length(name), 1) IN ('域', '划') AND length(name) BETWEEN 3 AND 7 THEN length(name)
    WHEN regexp_matches(name, '自治[县旗]$') THEN length(name) + 10 END AS priority
  FROM at_ JOIN (SELECT DISTINCT name FROM areas WHERE regexp_matches(name, '^[一-龥]{{{{2,10}}}}[区县旗]$')) n ON substr(address, i, length(name)) = name),
ax AS (SELECT rid, name AS area FROM af WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid ORDER BY priority DESC, name DESC) = 1),
sw AS (SELECT DISTINCT name FROM streets WHERE regexp_matches(name, '{_ENDS}')),
sn AS (SELECT name, true AS known FROM sw UNION ALL SELECT DISTINCT name, false FROM (SELECT regexp_replace(name, '{_ENDS}', '') || unnest({region.STREET_ENDS}) AS name FROM sw WHERE length(regexp_replace(name, '{_ENDS}', '')) >= 2) WHERE name NOT IN (FROM sw)),
sf AS (SELECT rid, name, known, i FROM at_ JOIN sn ON substr(address, i, length(name)) = name WHERE NOT (regexp_matches(name, '[镇乡]$') AND substr(address, i + length(name), 1) = '村')),
sx AS (SELECT rid, name AS street FROM sf QUALIFY row_number() OVER (PARTITION BY rid ORDER BY known DESC, CASE WHEN known THEN 0 ELSE i END, length(name) DESC, name DESC) = 1)"""
_BARE = {
    "area": "regexp_replace({v}, '(自治县|自治旗|区|县|市|旗)$', '')", "street": f"regexp_replace({{v}}, '{_ENDS}', '')",
    "city": "regexp_replace({v}, '(市|地区|盟)$', '')"
}
_UP = "LEFT JOIN cities c ON c.code = a.cityCode LEFT JOIN provinces p ON p.code = c.provinceCode"
_DIMS = {
    "city": "SELECT c.code, c.name, p.name AS province, c.name AS city, '' AS area FROM cities c LEFT JOIN provinces p ON p.code = c.provinceCode",
    "area": f"SELECT a.code, a.name, p.name AS province, c.name AS city, a.name AS area FROM areas a {_UP}",
    "street": f"SELECT s.code, s.name, p.name AS province, c.name AS city, a.name AS area FROM streets s LEFT JOIN areas a ON a.code = s.areaCode {_UP}"
}


def _above_sql(of: str, n: int) -> str:
    """Steps of the completion: k{n}, what lies above a name; s{n}, the rows after it."""
    lacking = {"area": ["province", "city"], "street": ["province", "city", "area"], "city": ["province"]}[of]
    sure = {"area": 0.9, "street": 0.85, "city": 0.95}[of]
    lacks = " OR ".join(f"{c} = ''" for c in lacking)
    hit = f"({lacks}) AND {of} <> '' AND d IS NOT NULL"
    filled = ", ".join(f"CASE WHEN {hit} AND {c} = '' THEN coalesce(d.{c}, '') ELSE {c} END AS {c}" for c in lacking)
    return f"""d{n} AS (SELECT *, unnest(list_distinct([name, {_BARE[of].format(v='name')}])) AS key FROM ({_DIMS[of]})),
k{n} AS (SELECT key, struct_pack(province := province, city := city, area := area) AS d FROM d{n} WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY code) = 1),
j{n} AS (SELECT s.*, CASE WHEN x.key IS NOT NULL THEN x.d ELSE y.d END AS d FROM s{n - 1} s LEFT JOIN k{n} x ON x.key = s.{of} LEFT JOIN k{n} y ON y.key = {_BARE[of].format(v=f's.{of}')}),
s{n} AS (SELECT * EXCLUDE (d) REPLACE ({filled}, CASE WHEN {hit} THEN greatest(confidence, {sure}::DOUBLE) ELSE confidence END AS confidence, CASE WHEN {hit} THEN '{of}_lookup' ELSE method END AS method) FROM j{n})"""


_OR_ELSE = "CASE WHEN coalesce({c}, '') = '' THEN coalesce(x_{c}, '') ELSE {c} END AS {c}"
COMPLETE_SQL = EXTRACT_SQL.format(t="spots") + f""",
s0 AS (SELECT rid, coalesce(province, '') AS province, coalesce(city, '') AS city, {_OR_ELSE.format(c='area')}, {_OR_ELSE.format(c='street')}, 0.0::DOUBLE AS confidence, 'none' AS method
  FROM (SELECT s.*, ax.area AS x_area, sx.street AS x_street FROM spots s LEFT JOIN ax USING (rid) LEFT JOIN sx USING (rid))),
""" + ",\n".join(_above_sql(of, n + 1) for n, of in enumerate(("area", "street", "city")))
add(
    "complete_address", "spots provinces cities areas streets", region.complete, COMPLETE_SQL + " SELECT * FROM s3"
)


def _from_street(rows, *dims):
    alone = rows.select("rid", "address", *(F.lit("").alias(c) for c in ("province", "city", "area")), "street")
    found = region.complete(alone, *dims).where("method = 'street_lookup'")
    return found.select("rid", "province", "city", "area", "street")


add(
    "region_deduce_street", "spots provinces cities areas streets", _from_street,
    COMPLETE_SQL.replace("FROM spots s LEFT", "FROM (SELECT * REPLACE ('' AS province, '' AS city, '' AS area) FROM spots) s LEFT")
    + " SELECT rid, province, city, area, street FROM s3 WHERE method = 'street_lookup'"
)


def _street_dim(spark, sf_dir):
    """Streets as a JSON file in the shared folder, read as a dimension."""
    folder = f"{shared.home(spark)}/{uuid.uuid4().hex}"
    frame(spark, sf_dir, "streets").select(F.to_json(F.struct("*")).alias("value")).write.text(f"{folder}/streets.json")
    return region.first_by_name(region.read(spark, folder, "streets", False)).select("key", "d.*")


QUERIES["read_street_dim"] = _street_dim
SQL["read_street_dim"] = f"""WITH streets AS ({FRAMES['streets']}), n AS (SELECT *, unnest(list_distinct([name, regexp_replace(name, '(省|市|区|县|自治区|街道|镇|乡)$', '')])) AS key FROM streets)
SELECT key, areaCode, code, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY code) AS r FROM n) WHERE r = 1"""
_SHORT = "regexp_replace({}, '(省|市|区|县|自治区)$', '')"
add(
    "validate_region", "places provinces cities areas",
    lambda r, p, c, a: region.valid(r, p, c, a).select("rid", "valid"),
    f"SELECT rid, EXISTS (SELECT 1 FROM areas a JOIN cities c ON a.cityCode = c.code JOIN provinces p ON c.provinceCode = p.code WHERE {_SHORT.format('a.name')} = {_SHORT.format('places.area')} AND {_SHORT.format('c.name')} = {_SHORT.format('places.city')} AND {_SHORT.format('p.name')} = {_SHORT.format('places.province')}) AS valid FROM places"
)
add(
    "areas_in_city", "seats quarters", lambda c, a: region.areas_in("N1市", c, a),
    "SELECT code, name FROM quarters WHERE cityCode IN (SELECT code FROM seats WHERE name = 'N1市')"
)
add(
    "region_extract", "spots areas streets",
    lambda r, a, s: region.extract_area(r, a).join(region.extract_street(r, s), "rid"),
    EXTRACT_SQL.format(t="spots") + " SELECT rid, coalesce(area, '') AS area, coalesce(street, '') AS street FROM (SELECT rid FROM spots) s LEFT JOIN ax USING (rid) LEFT JOIN sx USING (rid)"
)


def _fill(df):
    done = region.fill(
        {"province": F.col("province"), "city": F.col("city"), "district": F.col("area")},
        {"province": F.lit("浙江省"), "city": F.lit(""), "district": F.lit("西湖区")}
    )
    return df.select("rid", *(c.alias(k) for k, c in done.items()))


_LACKS = "(coalesce(province, '') = '' OR coalesce(city, '') = '')"
add(
    "fill_region", "places", _fill,
    f"SELECT rid, CASE WHEN {_LACKS} THEN '浙江省' ELSE province END AS province, city, CASE WHEN {_LACKS} THEN '西湖区' ELSE area END AS district FROM places"
)


# Profiles and relations -----------------------------------------------------------------------------------------------
COLUMNS = {
    "customer": ["c_custkey", "c_nationkey", "c_mktsegment"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderpriority"], "region": ["r_regionkey", "r_name"],
    "supplier": ["s_suppkey", "s_nationkey"]
}


def _long(spark, sf_dir):
    return profile.values({n: spark.read.parquet(f"{sf_dir}/{n}.parquet").select(*c) for n, c in COLUMNS.items()})


LONG_SQL = "lv AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS file, '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL" for t,
    cs in COLUMNS.items() for c in cs
) + "), dv AS (SELECT DISTINCT * FROM lv), nv AS (SELECT file, field, count(*) AS n FROM dv GROUP BY ALL)"
EDGE_SQL = LONG_SQL + """, ev AS (SELECT a.file AS file_a, a.field AS field_a, b.file AS file_b, b.field AS field_b, count(*) AS overlap FROM dv a JOIN dv b ON a.value = b.value AND (a.file, a.field) < (b.file, b.field) {same} GROUP BY ALL),
edges AS (SELECT ev.*, x.n + y.n - overlap AS union_count, round(overlap / (x.n + y.n - overlap), 6) AS jaccard, round(overlap / x.n, 6) AS containment_a, round(overlap / y.n, 6) AS containment_b FROM ev JOIN nv x ON x.file = file_a AND x.field = field_a JOIN nv y ON y.file = file_b AND y.field = field_b)"""
EDGES = EDGE_SQL.replace("{same}", "AND a.file <> b.file")
DEGREE_SQL = EDGES + """, en AS (SELECT concat(file_a, '.', field_a) AS node, concat(file_b, '.', field_b) AS other FROM edges UNION ALL SELECT concat(file_b, '.', field_b), concat(file_a, '.', field_a) FROM edges),
deg AS (SELECT concat(file, '.', field) AS node, (SELECT count(*) FROM en WHERE en.node = concat(file, '.', field)) AS degree, round((SELECT count(*) FROM en WHERE en.node = concat(file, '.', field)) / ((SELECT count(*) FROM nv) - 1), 6) AS centrality FROM nv)"""


def relation(name, make, sql):
    QUERIES[name] = lambda spark, sf_dir: make(_long(spark, sf_dir))
    if sql:
        SQL[name] = "WITH " + sql


def _degree(v):
    return profile.degree_centrality(profile.profile(v), profile.pairs(v))


relation(
    "field_profile", profile.profile,
    LONG_SQL + " SELECT file, field, count(DISTINCT value) AS unique_count, count(*) AS non_null FROM lv GROUP BY ALL"
)
relation(
    "rel_overlap", lambda v: profile.pairs(v).select("file_a", "field_a", "file_b", "field_b", "overlap"),
    EDGES + " SELECT file_a, field_a, file_b, field_b, overlap FROM edges"
)
relation("jaccard_pairs", profile.pairs, EDGES + " SELECT * FROM edges")
relation("relation_graph", lambda v: profile.graph(profile.profile(v), profile.pairs(v)), DEGREE_SQL + """, pr AS (SELECT concat(file, '.', field) AS node, count(DISTINCT value) AS unique_count FROM lv GROUP BY ALL),
  ab AS (SELECT concat(file_a, '.', field_a) AS node, concat(file_b, '.', field_b) AS other, overlap, jaccard FROM edges UNION ALL SELECT concat(file_b, '.', field_b), concat(file_a, '.', field_a), overlap, jaccard FROM edges)
  SELECT node, unique_count, other, overlap, jaccard FROM pr LEFT JOIN ab USING (node)""")
relation(
    "relation_samples",
    lambda v: profile.sample_values(v, profile.pairs(v).select("file_a", "field_a", "file_b", "field_b")),
    EDGES + ", c AS (SELECT file_a, field_a, file_b, field_b, a.value, row_number() OVER (PARTITION BY file_a, field_a, file_b, field_b ORDER BY a.value) AS n FROM edges JOIN dv a ON a.file = file_a AND a.field = field_a JOIN dv b ON b.file = file_b AND b.field = field_b AND a.value = b.value) SELECT file_a, field_a, file_b, field_b, string_agg(value, '|' ORDER BY n) AS samples FROM c WHERE n <= 20 GROUP BY ALL"
)
relation("degree_centrality", _degree, DEGREE_SQL + " SELECT * FROM deg")
_RANK = "file_a, field_a, file_b, field_b"
relation(
    "relations_ranked", lambda v: profile.ranked(profile.pairs(v), 10),
    EDGES + f" SELECT * FROM edges ORDER BY overlap DESC, jaccard DESC, {_RANK} LIMIT 10"
)
relation(
    "relation_filters", lambda v: profile.pairs(v).where("file_a = 'customer' or file_b = 'customer'"),
    EDGES + " SELECT * FROM edges WHERE file_a = 'customer' OR file_b = 'customer'"
)
relation(
    "insight_high_relation", lambda v: profile.insight_high(profile.pairs(v)),
    EDGES + f" SELECT * FROM edges WHERE field_a <> field_b AND jaccard > 0.6 ORDER BY jaccard DESC, {_RANK} LIMIT 5"
)
_A_IN = "containment_a > 0.9"
relation(
    "insight_foreign_key", lambda v: profile.insight_foreign_key(profile.pairs(v)),
    EDGES + f" SELECT CASE WHEN {_A_IN} THEN concat(file_a, '.', field_a) ELSE concat(file_b, '.', field_b) END AS child, CASE WHEN {_A_IN} THEN concat(file_b, '.', field_b) ELSE concat(file_a, '.', field_a) END AS parent, CASE WHEN {_A_IN} THEN containment_a ELSE containment_b END AS containment, overlap FROM edges WHERE overlap >= 10 AND field_a <> field_b AND ({_A_IN} OR containment_b > 0.9) ORDER BY containment DESC, overlap DESC, child, parent LIMIT 5"
)
relation(
    "insight_central", lambda v: profile.insight_central(_degree(v)),
    DEGREE_SQL + " SELECT * FROM deg WHERE degree >= 2 ORDER BY centrality DESC, node LIMIT 5"
)
relation(
    "insight_stats", lambda v: profile.insight_counts(_degree(v)),
    DEGREE_SQL + " SELECT count(*) FILTER (degree > 0) AS connected, count(*) FILTER (degree = 0) AS isolated FROM deg"
)
COMPONENT_SQL = DEGREE_SQL.replace(
    "lv AS", "RECURSIVE lv AS", 1
) + ", cc(node, seen) AS (SELECT node, node FROM deg UNION SELECT cc.node, en.other FROM cc JOIN en ON en.node = cc.seen), com AS (SELECT node, min(seen) AS community FROM cc GROUP BY 1)"


def _communities(v):
    return profile.communities(profile.profile(v), profile.pairs(v))


relation("communities", _communities, COMPONENT_SQL + " SELECT * FROM com")
relation(
    "insights", lambda v: profile.insight_communities(_communities(v)),
    COMPONENT_SQL + " SELECT community, count(*) AS n_fields, count(DISTINCT split_part(node, '.', 1)) AS n_files FROM com GROUP BY 1 HAVING n_files >= 2 ORDER BY n_fields DESC, community LIMIT 5"
)


def _relation_state(v):
    """Relations saved twice as a project's state and read back: the last version counts."""
    folder, edges = f"{shared.home(v.sparkSession)}/{uuid.uuid4().hex}", profile.pairs(v)
    for rows in (edges.limit(1), edges):
        sinks.save_rows(rows, folder, "field_relations")
    return readers.read_rows(v.sparkSession, folder, "field_relations", edges.schema.simpleString()[7:-1].replace(":", " "))


relation("relation_state", _relation_state, EDGES + " SELECT * FROM edges")


def _louvain(v):
    """Fields by Louvain's communities over jaccard in millionths; fields without relations are alone."""
    nodes = profile.profile(v).select(F.concat_ws(".", "file", "field").alias("node"))
    name = lambda s: F.concat_ws(".", f"file_{s}", f"field_{s}").alias(s)
    edges = profile.pairs(v).select(name("a"), name("b"), F.round(F.col("jaccard") * 1_000_000).cast("long").alias("w"))
    found = communities.louvain(edges)
    return nodes.join(found, "node", "left").select("node", F.coalesce("community", "node").alias("community"))


relation("communities_louvain", _louvain, None)
relation("insights_louvain", lambda v: profile.insight_communities(_louvain(v)), None)

#: Files that a project makes of one another: each customer's file is cleaned and parsed, parsed ones are matched together, and
#: the matches merged; some are imported again from their parsed form.
FILE_SQL = """SELECT concat('raw_', c_custkey) AS parent, concat('clean_', c_custkey) AS child, 'step2_cleaned' AS step FROM customer
  UNION ALL SELECT concat('clean_', c_custkey), concat('parsed_', c_custkey), 'step3_parsed' FROM customer
  UNION ALL SELECT concat('parsed_', c_custkey), concat('match_', CAST(floor(c_custkey / 4) AS INT)), 'step4_matched' FROM customer
  UNION ALL SELECT concat('match_', CAST(floor(c_custkey / 4) AS INT)), concat('merged_', CAST(floor(c_custkey / 16) AS INT)), 'step5_merged' FROM customer
  UNION ALL SELECT concat('parsed_', c_custkey), concat('raw_', c_custkey), 'step1' FROM customer WHERE c_custkey % 50 = 0
  UNION ALL SELECT concat('raw_', c_custkey), concat('raw_', c_custkey), 'step1' FROM customer WHERE c_custkey % 9 = 0"""


def _chain(spark, sf_dir):
    folder = f"{shared.home(spark)}/{uuid.uuid4().hex}"
    edges = frame(spark, sf_dir, FILE_SQL)
    lineage.record(edges.where("step < 'step4'"), folder)
    lineage.record(edges, folder)
    return lineage.closure(lineage.load(spark, folder))


QUERIES["file_chain"] = _chain
QUERIES["file_originals"] = lambda spark, sf_dir: lineage.originals(_chain(spark, sf_dir))
_CHAIN_SQL = f"""WITH RECURSIVE e AS (SELECT DISTINCT parent, child FROM ({FILE_SQL}) WHERE parent <> child),
c(ancestor, descendant, depth) AS (SELECT parent, child, 1 FROM e UNION SELECT c.ancestor, e.child, depth + 1 FROM c JOIN e ON c.descendant = e.parent WHERE depth < 10),
m AS (SELECT ancestor, descendant, min(depth) AS depth FROM c GROUP BY ALL)"""
SQL["file_chain"] = _CHAIN_SQL + " SELECT * FROM m"
SQL["file_originals"] = _CHAIN_SQL + " SELECT * FROM m WHERE ancestor NOT IN (SELECT descendant FROM m)"
relation(
    "relation_usage", lambda v: profile.usage(profile.pairs(v)),
    EDGES + " SELECT file_a, field_a, file_b, field_b, CASE WHEN regexp_matches(lower(field_a), '省|市|县|区|province|city|district') THEN 'constraint' WHEN regexp_matches(lower(field_a), 'id|gid|编号|code') THEN 'filter' ELSE 'match' END AS use_for FROM edges"
)
_NUMBER = r"'^-?[0-9]+(\.[0-9]+)?$'"
#: Tables with fields of the same names and values.
NAMED = {
    "clients": "SELECT c_mktsegment AS segment, n_name AS nation, n_name AS home, c_custkey AS id, c_name AS _name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "lands": "SELECT n_name AS nation, n_regionkey AS region_id FROM nation",
    "parts_of_world": "SELECT r_regionkey AS region_id, r_name AS region FROM region",
    "sales": "SELECT o_orderpriority AS priority, o_custkey AS id, o_orderstatus AS status FROM orders",
}
NAMED_FIELDS = {
    "clients": ["segment", "nation", "home", "id", "_name"], "lands": ["nation", "region_id"],
    "parts_of_world": ["region_id", "region"], "sales": ["priority", "id", "status"]
}
NAMED_SQL = ", ".join(f"{n} AS ({q})" for n, q in NAMED.items()) + ",\n"


def _long_sql(fields, most=None):
    parts = " UNION ALL ".join(
        f"SELECT '{t}' AS file, '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL" for t,
        cs in fields.items() for c in cs
    )
    first = f" WHERE NOT starts_with(field, '_') QUALIFY row_number() OVER (PARTITION BY file, field ORDER BY value) <= {most}" if most else ""
    return f"lv AS ({parts}), d0 AS (SELECT DISTINCT * FROM lv), dv AS (SELECT * FROM d0{first}), nv AS (SELECT file, field, count(*) AS n FROM dv GROUP BY ALL)"


def _named_edges(same: str, most=None):
    return NAMED_SQL + _long_sql(NAMED_FIELDS, most) + EDGE_SQL.removeprefix(LONG_SQL).replace("{same}", same)


def named(name, make, sql):
    QUERIES[name] = lambda spark, sf_dir: make(profile.values({n: frame(spark, sf_dir, q) for n, q in NAMED.items()}))
    SQL[name] = "WITH " + sql


named(
    "insight_same_name", lambda v: profile.insight_same_name(profile.pairs(v)),
    _named_edges(
        "AND a.file <> b.file"
    ) + f" SELECT * FROM edges WHERE field_a = field_b AND jaccard > 0.8 ORDER BY jaccard DESC, {_RANK} LIMIT 3"
)
named("relation_sampled", profile.sampled_relations, _named_edges(
    f"AND (SELECT NOT bool_and(regexp_matches(value, {_NUMBER})) FROM dv z WHERE z.file = a.file AND z.field = a.field) AND (SELECT NOT bool_and(regexp_matches(value, {_NUMBER})) FROM dv z WHERE z.file = b.file AND z.field = b.field)",
    500
)
    + " SELECT file_a, field_a, file_b, field_b, overlap, round(jaccard, 3) AS jaccard FROM edges WHERE overlap >= 3 AND jaccard >= 0.1")
def _types_sql(source: str) -> str:
    n = "lower(replace(name, ' ', ''))"
    hits = [
        (k, "address", p, 0.8) for k, p in R.ADDRESS_FIELDS.items()
    ] + [(k, k, p, 0.7) for k, p in R.ID_FIELDS.items()]
    case = lambda pick, rest: "CASE " + " ".join(
        f"WHEN regexp_matches({n}, '{R.any_of(h[2])}') THEN {pick(h)}" for h in hits
    ) + f" ELSE {rest} END"
    return f"SELECT *, {case(lambda h: repr(h[1]), repr('text'))} AS inferred_type, {case(lambda h: repr(h[0]), repr(''))} AS category, CAST({case(lambda h: h[3], 0.5)} AS DOUBLE) AS confidence FROM {source}"


add("detect_field_type", "fields_", profile.field_types, _types_sql("fields_"))


def _refined(spark, sf_dir):
    df = frame(
        spark, sf_dir,
        "SELECT o_orderkey AS rid, CAST(o_orderdate AS VARCHAR(30)) AS shipped, CAST(o_totalprice AS VARCHAR(30)) AS amount, o_orderstatus AS remark FROM orders"
    )
    return profile.refine_types(
        profile.field_types(profile.names_frame(spark, ["shipped", "amount", "remark"])), df, "rid"
    )


QUERIES["refine_by_samples"] = _refined
SQL["refine_by_samples"] = rf"""WITH f AS (SELECT CAST(o_orderdate AS VARCHAR) AS shipped, CAST(o_totalprice AS VARCHAR) AS amount, CAST(o_orderstatus AS VARCHAR) AS remark FROM orders ORDER BY o_orderkey LIMIT 10),
u AS (SELECT name, value FROM f UNPIVOT (value FOR name IN (shipped, amount, remark))),
h AS (SELECT name, avg(CAST(regexp_matches(trim(value), {_NUMBER}) AS INT)) AS numeric, avg(CAST(regexp_matches(value, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}') AS INT)) AS dated FROM u GROUP BY 1)
SELECT name, CASE WHEN dated > 0.7 THEN 'date' WHEN numeric > 0.8 THEN 'numeric' ELSE 'text' END AS inferred_type, '' AS category,
  CASE WHEN dated > 0.7 THEN 0.8::DOUBLE WHEN numeric > 0.8 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM h"""


def _related(names):
    return profile.related_fields(
        profile.field_types(names).withColumn("source", F.when(F.length("name") % 2 == 0, "a").otherwise("b"))
    )


_X, _Y = "lower(x.name)", "lower(y.name)"
add("infer_relationships", "fields_", _related, f"""ty AS (SELECT *, CASE WHEN length(name) % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM ({_types_sql('fields_')})),
p AS (SELECT x.source AS source_a, x.name AS name_a, y.source AS source_b, y.name AS name_b, least(1.0, CASE WHEN x.category <> '' AND x.category = y.category THEN 0.8 WHEN x.inferred_type = y.inferred_type THEN 0.4 ELSE 0.0 END + 0.3 * CASE WHEN {_X} = {_Y} THEN 1.0 WHEN contains({_X}, {_Y}) OR contains({_Y}, {_X}) THEN 0.7 ELSE len(list_filter(string_split({_X}, ''), lambda c: contains({_Y}, c))) / greatest(length({_X}), length({_Y})) END) AS score FROM ty x JOIN ty y ON x.source < y.source)
SELECT source_a, name_a, source_b, name_b, round(CAST(score AS DOUBLE), 6) AS score FROM p WHERE score > 0.5""")

# Validation -----------------------------------------------------------------------------------------------------------
_V = ["v1", "v2"]
_NORM = "lower(" + strip_sql("coalesce(CAST({} AS VARCHAR), '')") + ")"
_GID = "coalesce(CAST(CAST(trunc(TRY_CAST(r.gid AS DOUBLE)) AS BIGINT) AS VARCHAR), " + _NORM.format("r.gid") + ")"


def geodesic_sql(rows: str, rounds: int = 9) -> str:
    """g_ (rid, metres) of rows (rid, sx, sy, x, y) in degrees: the iteration on the auxiliary sphere, unrolled."""
    f, minor, k2 = geodesic.FLAT, geodesic.MINOR, (geodesic.AXIS**2 - geodesic.MINOR**2) / geodesic.MINOR**2
    start = f"SELECT rid, atan({1 - f}::DOUBLE * tan(radians(sy))) AS u1, atan({1 - f}::DOUBLE * tan(radians(y))) AS u2, radians(abs(x - sx)) AS lon, radians(abs(x - sx)) AS l FROM {rows} WHERE degrees"
    parts = [f"i0 AS ({start})"]
    for n in range(1, rounds + 1):
        parts += [
            f"a{n} AS (SELECT rid, u1, u2, lon, l, sqrt(pow(cos(u2) * sin(l), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(l), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(l) AS cs FROM i{n - 1})",
            f"b{n} AS (SELECT *, atan2(ss, cs) AS sigma, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(l) / ss ELSE 0 END AS sa FROM a{n})",
            f"c{n} AS (SELECT *, 1 - sa * sa AS c2, CASE WHEN 1 - sa * sa > 1e-15 THEN cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) ELSE 0 END AS mid FROM b{n})",
            f"k{n} AS (SELECT *, {f / 16}::DOUBLE * c2 * (4 + {f}::DOUBLE * (4 - 3 * c2)) AS k FROM c{n})",
            f"i{n} AS (SELECT * REPLACE (lon + (1 - k) * {f}::DOUBLE * sa * (sigma + k * ss * (mid + k * cs * (2 * mid * mid - 1))) AS l) FROM k{n})"
        ]
    v = f"(c2 * {k2}::DOUBLE)"
    parts += [
        f"ab_ AS (SELECT *, 1 + {v} / 16384 * (4096 + {v} * (-768 + {v} * (320 - 175 * {v}))) AS a, {v} / 1024 * (256 + {v} * (-128 + {v} * (74 - 47 * {v}))) AS b FROM i{rounds})",
        f"g_ AS (SELECT rid, {minor}::DOUBLE * a * (sigma - b * ss * (mid + b / 4 * (cs * (2 * mid * mid - 1) - b / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))) AS metres FROM ab_)"
    ]
    return ",\n".join(parts)


RESOLVE_SQL = f"""dc AS (SELECT k, min(ROW(code, name, x, y)) AS r, count(*) AS n FROM (SELECT *, {_NORM.format('code')} AS k FROM db_) WHERE k <> '' GROUP BY k), dn AS (SELECT k, min(ROW(code, name, x, y)) AS r, count(*) AS n FROM (SELECT *, {_NORM.format('name')} AS k FROM db_) WHERE k <> '' GROUP BY k),
sg AS (SELECT CAST(CAST(trunc(TRY_CAST(gid AS DOUBLE)) AS BIGINT) AS VARCHAR) AS g, arg_max(x, seq) AS sx, arg_max(y, seq) AS sy FROM shp_ GROUP BY 1),
r0 AS (SELECT r.rid, r.gid, r.v1, r.v2, coalesce(c.r, a.r, b.r) AS d, CASE WHEN c.r IS NOT NULL THEN 'gid' WHEN a.r IS NOT NULL THEN 'v1' WHEN b.r IS NOT NULL THEN 'v2' END AS db_by, coalesce(c.n, a.n, b.n, 0) AS db_n, sx, sy FROM rows_ r LEFT JOIN dc c ON {_GID} = c.k LEFT JOIN dn a ON {_NORM.format('r.v1')} = a.k LEFT JOIN dn b ON {_NORM.format('r.v2')} = b.k LEFT JOIN sg ON sg.g = CAST(CAST(trunc(TRY_CAST(r.gid AS DOUBLE)) AS BIGINT) AS VARCHAR)),
r1 AS (SELECT *, d[1] AS code, d[2] AS name, d[3] AS x, d[4] AS y FROM r0),
r2 AS (SELECT *, abs(sx) < 180 AND abs(sy) < 90 AND abs(x) < 180 AND abs(y) < 90 AS degrees FROM r1),
{geodesic_sql('r2')},
res AS (SELECT r2.*, round(CASE WHEN degrees THEN metres ELSE sqrt(pow(x - sx, 2) + pow(y - sy, 2)) END, 2) AS distance FROM r2 LEFT JOIN g_ USING (rid))"""


def checked(name, make, sql):
    add(
        name, "rows_ db_ shp_", lambda r, d, s: make(validate.resolve(r, d, s, _V)),
        RESOLVE_SQL + " " + sql if sql else None
    )


_VALUE = "concat_ws('; ', " + ", ".join(f"CASE WHEN NOT {blank_sql(f)} THEN {strip_sql(f)} END" for f in _V) + ")"
_POINT = "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN printf('%.6f,%.6f', {0}, {1}) ELSE '' END"


def problem_sql(kind: str, status: str, where: str) -> str:
    return f"SELECT rid, coalesce(gid, '') AS gid, coalesce(code, '') AS db_code, {_VALUE} AS value, '{kind}' AS kind, {status} AS status, {_POINT.format('sx', 'sy')} AS shape_at, {_POINT.format('x', 'y')} AS db_at FROM res WHERE {where}"


MISSING_SQL = problem_sql("missing", "'数据库中未找到'", "d IS NULL")
DEVIATION_SQL = problem_sql("deviation", "printf('%.2f米', distance)", "distance > 10")
DUPLICATE_SQL = problem_sql("duplicate", "printf('重复%d条', db_n)", "db_n > 1")
checked(
    "val_db_lookup", lambda r: r.select("rid", "db_by", F.col("db.code").alias("code"), F.col("db.name").alias("name")),
    "SELECT rid, db_by, code, name FROM res"
)
checked(
    "val_shp_lookup", lambda r: r.select("rid", F.col("shape.x").alias("x"), F.col("shape.y").alias("y")),
    "SELECT rid, sx AS x, sy AS y FROM res"
)
checked("distance", lambda r: r.select("rid", "distance"), "SELECT rid, distance FROM res")
checked(
    "completeness_match", validate.completeness,
    "SELECT count(*) AS total, count(d) AS found, count(*) - count(d) AS missing, round(count(d) / count(*) * 100, 6) AS rate FROM res"
)
checked(
    "deviation_stats", validate.deviation,
    "SELECT count(*) AS attempted, count(distance) AS checked, count(*) FILTER (distance <= 10) AS within, count(*) FILTER (distance > 10) AS exceed, count(*) FILTER (sx IS NULL) AS no_shp, count(*) FILTER (sx IS NOT NULL AND d IS NULL) AS no_db, round(count(*) FILTER (distance <= 10) / count(distance) * 100, 6) AS within_rate FROM res"
)
checked(
    "duplicate_stats", validate.duplicates,
    f"SELECT count(DISTINCT CASE WHEN db_n > 1 THEN CASE WHEN db_by = 'gid' THEN concat('code:', {_NORM.format('code')}) ELSE concat('name:', {_NORM.format('name')}) END END) AS duplicate_keys, count(*) FILTER (db_n > 1) AS duplicate_rows, CAST(coalesce(sum(db_n) FILTER (db_n > 1), 0) AS BIGINT) AS duplicate_records FROM res"
)
checked("val_missing", lambda r: validate.missing(r, _V), MISSING_SQL)
checked("val_deviation", lambda r: validate.deviations(r, _V), DEVIATION_SQL)
checked("val_duplicates", lambda r: validate.duplicate_rows(r, _V), DUPLICATE_SQL)
_TYPES = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in validate.PROBLEM_TYPES.items()) + " END"
_AT = "CASE WHEN {0} <> '' THEN '(' || replace({0}, ',', ', ') || ')' ELSE '-' END"
PROBLEMS_SQL = " UNION ALL ".join((MISSING_SQL, DEVIATION_SQL, DUPLICATE_SQL))


def report_sql(of: str) -> str:
    return f"""SELECT gid AS "目标表GID", CASE WHEN db_code <> '' THEN db_code ELSE '-' END AS "数据库code", value AS "源表匹配值", status AS "状态", CASE WHEN kind = 'deviation' THEN status ELSE '-' END AS "偏差距离",
  {_AT.format('shape_at')} AS "原始坐标", {_AT.format('db_at')} AS "数据库坐标", {_TYPES} AS "问题类型" FROM ({of})"""


checked("problem_union", lambda r: validate.report(validate.problems(r, _V)), report_sql(PROBLEMS_SQL))
checked("problem_filter", lambda r: validate.problems(r, _V).where("kind = 'duplicate'"), DUPLICATE_SQL)


def _exported(spark, sf_dir):
    """The problem table, written and read back."""
    rows = validate.resolve(*(frame(spark, sf_dir, n) for n in ("rows_", "db_", "shp_")), _V)
    path = f"{shared.home(spark)}/{uuid.uuid4().hex}"
    sinks.write_csv(validate.report(validate.problems(rows, _V)), path)
    return readers.read_csv(spark, path, "utf-8").na.fill("")


QUERIES["export_problems"] = _exported
SQL["export_problems"] = SQL["problem_union"]
_LINES = [
    "repeat('=', 60)", "'数据治理验证统计报告'", "repeat('=', 60)", "''", "'【基本信息】'", "'原始客户数据总数: ' || (SELECT count(*) FROM addr)", "'匹配结果总数: ' || (SELECT count(*) FROM res)", "''",
    "'【数据完整性统计】'", "'匹配结果在数据库中存在: ' || (SELECT count(d) FROM res)", "'匹配结果在数据库中缺失: ' || (SELECT count(*) - count(d) FROM res)", "''",
    "'【位置偏差统计】'", "'检查总数: ' || (SELECT count(distance) FROM res)", "'在阈值内: ' || (SELECT count(*) FILTER (distance <= 10) FROM res)", "'超过阈值: ' || (SELECT count(*) FILTER (distance > 10) FROM res)", "''",
    "'【重复数据统计】'", "'重复匹配值数: ' || (SELECT duplicate_keys FROM ds)", "'重复记录数: ' || (SELECT duplicate_records FROM ds)", "''",
]
add("text_report", "addr rows_ db_ shp_", lambda a, r, d, s: validate.text_report(
    a.agg(F.count("*").alias("n")), validate.resolve(r, d, s, _V), _V
),
    RESOLVE_SQL + f""", pb AS ({PROBLEMS_SQL}), ds AS ({SQL['duplicate_stats'][SQL['duplicate_stats'].rindex('SELECT count(DISTINCT'):]}), nb AS (SELECT *, row_number() OVER (ORDER BY rid, kind) AS n FROM pb)
""" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS line, {x} AS text" for i, x in enumerate(_LINES)) + f"""
UNION ALL SELECT {len(_LINES)}, '【问题数据详情】' WHERE (SELECT count(*) FROM pb) > 0
UNION ALL SELECT {len(_LINES)} + n, n || '. ' || status || ' - GID: ' || gid FROM nb WHERE n <= 100
UNION ALL SELECT {len(_LINES) + 101}, '... 还有 ' || (count(*) - 100) || ' 条问题数据未显示' FROM pb HAVING count(*) > 100""")
add(
    "completeness_original", "rows_ db_", lambda r, d: validate.completeness_original(r, d, _V),
    f"nm AS (SELECT DISTINCT {_NORM.format('name')} AS k FROM db_), hit AS (SELECT {_NORM.format('v1')} IN (SELECT k FROM nm WHERE k <> '') OR {_NORM.format('v2')} IN (SELECT k FROM nm WHERE k <> '') AS h FROM rows_) SELECT count(*) AS total, count(*) FILTER (h) AS found, count(*) - count(*) FILTER (h) AS missing, round(count(*) FILTER (h) / count(*) * 100, 6) AS rate FROM hit"
)
add(
    "export_duplicates", "db_", validate.duplicate_records,
    f"SELECT DISTINCT code, name, x, y FROM db_ WHERE {_NORM.format('code')} IN (SELECT {_NORM.format('code')} FROM db_ GROUP BY 1 HAVING count(*) > 1) OR {_NORM.format('name')} IN (SELECT {_NORM.format('name')} FROM db_ GROUP BY 1 HAVING count(*) > 1)"
)
_GIDS = ["[源:a]gid|[目标:b]code|[目标:b]GID", "[目标:b]x|[目标:b]code", "x|gid", "[目标:b]gid_code|[目标:c]my_gid"]
add("pick_target_gid", "tgt", lambda df: _column_lists(df, _GIDS).select(
    "rid", validate.target_gid(F.col("names")).alias("found")
),
    f"""SELECT rid, coalesce(list_filter(names, lambda x: contains(x, '[目标:') AND contains(lower(x), 'gid') AND NOT contains(lower(x), 'code'))[1], list_filter(names, lambda x: contains(x, '[目标:') AND contains(lower(x), 'code'))[1]) AS found FROM {_lists_sql(_GIDS)}""")
_MAPS = ["x|【匹配源:t】v", "[目标:t]v1|[源:t]v", "a|has v in it", "none", "【匹配源:t】v|[源:t]v"]
add("map_fields", "tgt", lambda df: _column_lists(df, _MAPS).select(
    "rid", validate.map_field("v", "t", F.col("names")).alias("found")
),
    f"""SELECT rid, coalesce(list_filter(['[源:t]v', '【匹配源:t】v'], lambda x: list_contains(names, x))[1], list_filter(names, lambda x: contains(x, 'v'))[1]) AS found FROM {_lists_sql(_MAPS)}""")


def _mercator(df):
    x, y = F.col("x"), F.col("y")
    east, north = geo.to_mercator(x, y)
    back = geo.from_mercator(F.col("east"), F.col("north"))
    rows = df.select("rid", east.alias("east"), north.alias("north"))
    return rows.select(
        "rid", (F.round("east", 3) + 0.0).alias("east"), (F.round("north", 3) + 0.0).alias("north"),
        (F.round(back[0], 6) + 0.0).alias("x"), (F.round(back[1], 6) + 0.0).alias("y")
    )


add("mercator", "shp_", lambda df: _mercator(df.withColumn("rid", F.col("seq"))), f"""SELECT rid, round(radians(x) * {geo.MERCATOR}, 3) + 0.0 AS east, round(ln(tan(radians(y) / 2 + pi() / 4)) * {geo.MERCATOR}, 3) + 0.0 AS north, round(x, 6) AS x, round(y, 6) AS y
  FROM (SELECT seq AS rid, x, y FROM shp_)""")


def _transformed(df):
    """Degrees around a central meridian, in a three-degree zone, a UTM zone, and back."""
    zone, utm = (geo.transformed(112 + F.col("x") / 25, F.col("y"), 4326, code) for code in (4547, 32649))
    rows = df.select("seq", *(c.alias(n) for n, c in zip(("east", "north", "utm_east", "utm_north"), (*zone, *utm))))
    back = geo.transformed(F.col("east"), F.col("north"), 4547, 4326)
    return rows.select(
        F.col("seq").alias("rid"), *(F.round(c, 3).alias(c) for c in ("east", "north", "utm_east", "utm_north")),
        F.round(back[0], 8).alias("x"), F.round(back[1], 8).alias("y")
    )


def _transverse_sql(t, east: str, north: str) -> str:
    lon, e = f"radians(lon - {t.central})", f"{t.e}::DOUBLE"
    tau = f"sinh(atanh(sin(radians(y))) - {e} * atanh({e} * sin(radians(y))))"
    more = lambda f, g: " + ".join(f"{a}::DOUBLE * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(t.alpha, 1))
    return f"""SELECT rid, round({t.east} + {t.radius}::DOUBLE * (eta + {more('cos', 'sinh')}), 3) AS {east}, round({t.north} + {t.radius}::DOUBLE * (xi + {more('sin', 'cosh')}), 3) AS {north}, lon, y
  FROM (SELECT *, atan2(t, cos({lon})) AS xi, atanh(sin({lon}) / sqrt(1 + t * t)) AS eta FROM (SELECT seq AS rid, 112 + x / 25 AS lon, y, {tau.replace('lon', '112 + x / 25')} AS t FROM shp_))"""


add(
    "transform_crs", "shp_", _transformed,
    f"SELECT z.rid, east, north, utm_east, utm_north, round(z.lon, 8) AS x, round(z.y, 8) AS y FROM ({_transverse_sql(geo.projection(4547), 'east', 'north')}) z JOIN ({_transverse_sql(geo.projection(32649), 'utm_east', 'utm_north')}) u USING (rid)"
)

_LAYERS = ["x|ID|gid", "name|Id", "code|name", "GID|id"]
add("gid_field", "tgt", lambda df: _column_lists(df, _LAYERS).select(
    "rid", validate.gid_field(F.col("names")).alias("found")
),
    f"SELECT rid, coalesce(list_filter(names, lambda x: lower(x) = 'gid')[1], list_filter(names, lambda x: lower(x) = 'id')[1], names[1]) AS found FROM {_lists_sql(_LAYERS)}")


def _point_layer(spark, sf_dir):
    """Records of the layer that is found among others in two folders."""
    base = f"{shared.home(spark)}/{uuid.uuid4().hex}"
    sinks.write_csv(frame(spark, sf_dir, "shp_"), f"{base}/a/1.csv")
    frame(spark, sf_dir, "src").write.parquet(f"{base}/a/2")
    layers.write_points(frame(spark, sf_dir, "db_"), f"{base}/b/points", "x", "y")
    found = discovery.point_layer(spark, [f"{base}/none", f"{base}/a", f"{base}/b"], [("jdbc:none:nowhere", ["t"])])
    return found.open().select("code", "name")


QUERIES["point_layer"] = _point_layer
SQL["point_layer"] = f"SELECT code, name FROM ({FRAMES['db_']})"
