"""Queries over similarities, the tiers of linkage, POI matching, layered results and address enrichment."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import rules as R, similarity, text as T
from ..operators import answers, enrich, join, match, nearest
from ..sources import readers, shared, sinks
from .catalog import ADMIN_SQL, CLEAN_POI_SQL, OVERLAP_SQL, LENGTH_SQL, STD_SQL, TEN_SQL
from .fixtures import FRAMES, frame
from .registry import QUERIES, SQL, add, blank_sql, strip_sql

# Similarities -----------------------------------------------------------------------------------------------------------
#: Of the columns a and b.
LCS_SQL = """list_reduce(list_transform(string_split(a, ''), lambda c: [CAST(ord(c) AS BIGINT)]),
  lambda p, x: list_reduce(list_transform(range(1, len(b) + 1), lambda j: [CASE WHEN ord(string_split(b, '')[j]) = x[1] THEN p[j] + 1 ELSE p[j + 1] END]), lambda acc, v: list_append(acc, greatest(acc[-1], v[1])), [CAST(0 AS BIGINT)]),
  list_transform(range(0, len(b) + 1), lambda i: CAST(0 AS BIGINT)))[-1]"""
RATIO_SQL = f"200.0::DOUBLE * {LCS_SQL} / (length(a) + length(b))"


def pairs_sql(source: str, target: str) -> str:
    return f"""s_{target} AS (SELECT DISTINCT trim(poi) AS a FROM {source} WHERE trim(coalesce(poi, '')) <> ''), t_{target} AS (SELECT DISTINCT trim(poi) AS b FROM {target} WHERE trim(coalesce(poi, '')) <> ''),
ratios_{target} AS (SELECT a, b, {RATIO_SQL} AS score FROM s_{target}, t_{target})"""


def partial_sql(a: str, b: str) -> str:
    """pr (pa, pb, score): the best ratio of the shorter string with a window of the longer one, for SELECTs of a and of b."""
    return f"""pp AS (SELECT DISTINCT a AS pa, b AS pb, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM ({a}), ({b})),
pw AS (SELECT *, unnest(range(1 - length(s), length(l))) AS i FROM pp),
px AS (SELECT pa, pb, s AS a, substr(l, CAST(greatest(i, 0) + 1 AS BIGINT), CAST(least(i + length(s), length(l)) - greatest(i, 0) AS BIGINT)) AS b FROM pw),
pr AS (SELECT pa, pb, max({RATIO_SQL}) AS score FROM px GROUP BY ALL)"""


def _stripped(df, name):
    return df.select(T.strip(F.col("poi")).alias(name))


def _scores(found):
    return found.select("a", "b", F.round("score", 6).alias("score"))


def _poi_of(t, name):
    return f"SELECT DISTINCT {strip_sql('poi')} AS {name} FROM {t} WHERE {strip_sql('poi')} <> ''"


add(
    "fuzz_ratio", "src tgt", lambda s, t: _scores(similarity.candidates(_stripped(s, "a"), _stripped(t, "b"), 90.0)),
    pairs_sql("src", "tgt") + " SELECT a, b, round(score, 6) AS score FROM ratios_tgt WHERE score >= 90"
)
add(
    "partial_ratio", "src tgt",
    lambda s, t: _scores(similarity.partial_candidates(_stripped(s, "a"), _stripped(t, "b"), 75.0)),
    partial_sql(
        _poi_of("src", "a"), _poi_of("tgt", "b")
    ) + " SELECT pa AS a, pb AS b, round(score, 6) AS score FROM pr WHERE score >= 75"
)
#: dl (x, y, score) of dp (x, y): difflib's score, by the longest common block, the first in x and then in y, and what lies left
#: and right of it.
DIFFLIB_SQL = """dw(x, y, a, b) AS (SELECT x, y, x, y FROM dp UNION ALL SELECT x, y, unnest([substr(a, 1, i - 1), substr(a, i + k)]), unnest([substr(b, 1, j - 1), substr(b, j + k)])
  FROM (SELECT *, instr(b, substr(a, i, k)) AS j FROM (SELECT *, m[1] AS k, -m[2] AS i FROM (SELECT *, list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda k: CASE WHEN contains(b, substr(a, i, k)) THEN [k, -i] ELSE [0, 0] END)))) AS m
  FROM dw WHERE a <> '' AND b <> '') WHERE m[1] > 0))),
dk AS (SELECT x, y, sum(m) AS matched FROM (SELECT x, y, list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda k: CASE WHEN contains(b, substr(a, i, k)) THEN k ELSE 0 END)))) AS m FROM dw WHERE a <> '' AND b <> '') GROUP BY ALL),
dl AS (SELECT x, y, CASE WHEN x = y THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 2.0::DOUBLE * matched / (length(x) + length(y)) - 0.2::DOUBLE * abs(length(x) - length(y)) / greatest(length(x), length(y))) END AS score FROM dk)"""
add(
    "difflib_score", "tgt tgt2",
    lambda s, t: _scores(similarity.difflib_candidates(_stripped(s, "a"), _stripped(t, "b"), 0.7)),
    f"dp AS (SELECT a AS x, b AS y FROM ({_poi_of('tgt', 'a')}), ({_poi_of('tgt2', 'b')})), {DIFFLIB_SQL} SELECT x AS a, y AS b, round(score, 6) AS score FROM dl WHERE score >= 0.7"
)
add(
    "me_fuzzy", "src tgt",
    lambda s, t: join.fuzzy(s.withColumnRenamed("rid", "lid"), t, "poi", "poi").select(
        "lid", "rid", F.round("confidence", 6).alias("confidence")
    ),
    f"""dp AS (SELECT a AS x, b AS y FROM ({_poi_of('src', 'a')}), ({_poi_of('tgt', 'b')})), {DIFFLIB_SQL},
dr AS (SELECT x, min(t.rid) AS rid, score FROM dl JOIN tgt t ON {strip_sql('t.poi')} = y WHERE score >= 0.7 GROUP BY x, score QUALIFY row_number() OVER (PARTITION BY x ORDER BY score DESC) = 1)
SELECT s.rid AS lid, dr.rid, round(dr.score, 6) AS confidence FROM src s JOIN dr ON {strip_sql('s.poi')} = x"""
)
for _name in ("difflib_score", "me_fuzzy"):
    SQL[_name] = SQL[_name].replace("WITH ", "WITH RECURSIVE ", 1)


def _vectors(spark, sf_dir, rest):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") % 2 == rest).select(
        F.col("vec_id").alias("rid"), F.col("embedding").alias("v")
    )


QUERIES["semantic_sim"] = lambda spark, sf_dir: nearest.search(
    _vectors(spark, sf_dir, 0), _vectors(spark, sf_dir, 1)
).drop("cells")
SQL["semantic_sim"] = """WITH p AS (SELECT l.vec_id AS rid, r.vec_id AS target_rid, round(list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS similarity FROM embeddings l, embeddings r WHERE l.vec_id % 2 = 0 AND r.vec_id % 2 = 1)
SELECT rid, target_rid, similarity FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY similarity DESC, target_rid) AS n FROM p) WHERE n = 1"""

_LETTERS = "花园广场中心小区学医院路门"


def _letter_counts(texts):
    """A stand-in for an encoder: one, and how often each of some letters occurs."""
    count = lambda x: F.length("text") - F.length(F.replace("text", F.lit(x), F.lit("")))
    return texts.select("text", F.array(F.lit(1.0), *(count(x).cast("double") for x in _LETTERS)).alias("v"))


_COUNTS = "[1.0::DOUBLE" + "".join(
    f", CAST(length(t) - length(replace(t, '{x}', '')) AS DOUBLE)" for x in _LETTERS
) + "]"
add("semantic_encoded", "src tgt", lambda s, t: nearest.search(
    *(match.embedded(x, "poi", _letter_counts).where("v is not null").select("rid", "v") for x in (s, t))
).drop("cells"),
    f"""l AS (SELECT rid, {_COUNTS} AS v FROM (SELECT rid, {strip_sql('poi')} AS t FROM src) WHERE t <> ''), r AS (SELECT rid AS target_rid, {_COUNTS} AS w FROM (SELECT rid, {strip_sql('poi')} AS t FROM tgt) WHERE t <> ''),
p AS (SELECT rid, target_rid, round(list_cosine_similarity(v, w), 6) AS similarity FROM l, r)
SELECT rid, target_rid, similarity FROM p QUALIFY row_number() OVER (PARTITION BY rid ORDER BY similarity DESC, target_rid) = 1""")

# Tiers ------------------------------------------------------------------------------------------------------------------
_SAME = "coalesce(district <> '' AND target_district <> '' AND district = target_district, false)"
_OTHER = "coalesce(district <> '' AND target_district <> '' AND district <> target_district, false)"
SURE_SQL = f"(CASE WHEN {_SAME} THEN score >= 95 WHEN {_OTHER} THEN score >= 103 ELSE score >= 98 END)"
_OVERLAP, _LIKE = (x.replace("{a}", "a").replace("{b}", "b") for x in (OVERLAP_SQL, LENGTH_SQL))


def near_sql(source: str, t: str, meaning: bool) -> str:
    """x_ (rid, target_rid, score, match_type, district, target_district): the best target by ratio, or by meaning too."""
    best = f"SELECT s.rid, s.district, t.rid AS target_rid, t.district AS target_district, r.a, r.b, r.score, r.score AS exactly, 'fuzzy_' || CAST(floor(r.score) AS INT) AS match_type, 0 AS of FROM {source} s JOIN ratios_{t} r ON trim(s.poi) = r.a JOIN {t} t ON trim(t.poi) = r.b WHERE r.score >= 90 QUALIFY row_number() OVER (PARTITION BY s.rid ORDER BY r.score DESC, t.rid) = 1"
    parts, more = [
        f"SELECT * REPLACE (CASE WHEN score >= 98 AND {_LIKE} >= 0.8 THEN 1000.0::DOUBLE ELSE exactly END AS exactly) FROM k_{t}"
    ], ""
    if meaning:
        more = f""",
m_{t} AS (SELECT s.rid, s.district, t.rid AS target_rid, t.district AS target_district, trim(s.poi) AS a, trim(t.poi) AS b, round(list_cosine_similarity(s.v::DOUBLE[], t.v::DOUBLE[]), 6) AS sim FROM {source} s, {t} t WHERE trim(s.poi) <> '' AND trim(t.poi) <> '' AND s.v IS NOT NULL AND t.v IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY s.rid ORDER BY sim DESC, t.rid) = 1),
q_{t} AS (SELECT *, greatest(0.0::DOUBLE, sim * 100 - CASE WHEN {_OVERLAP} < 0.3 THEN 15.0::DOUBLE WHEN {_OVERLAP} < 0.5 THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END) AS points FROM m_{t})"""
        parts.append(
            f"SELECT rid, district, target_rid, target_district, a, b, round(points, 2), points, CASE WHEN points >= 82 THEN 'semantic_strong' WHEN points >= 75 THEN 'semantic_weak' ELSE 'semantic' END, 1 FROM q_{t} WHERE points > 0"
        )
    return f"""k_{t} AS ({best}){more},
c_{t} AS (SELECT * FROM ({' UNION ALL '.join(parts)}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY exactly DESC, of DESC) = 1),
l_{t} AS (SELECT * REPLACE (CASE WHEN {_LIKE} < 0.6 THEN greatest(0.0::DOUBLE, score - 5) ELSE score END AS score) FROM c_{t}),
x_{t} AS (SELECT rid, target_rid, score, match_type, district, target_district FROM l_{t} WHERE {_OVERLAP} >= 0.2 AND ({_OVERLAP} >= 0.3 OR score >= 98))"""


def tier_sql(t: str, source: str = "src", meaning: bool = False) -> str:
    exact = lambda f: f"SELECT s.rid, min(t.rid) AS target_rid, 100.0::DOUBLE AS score FROM {source} s JOIN {t} t ON {strip_sql(f's.{f}')} = {strip_sql(f't.{f}')} WHERE {strip_sql(f's.{f}')} <> '' GROUP BY 1"
    typed = f"CASE WHEN {_SAME} AND starts_with(match_type, 'fuzzy') THEN 'district_' || match_type ELSE match_type END"
    return pairs_sql(source, t) + f""",
{near_sql(source, t, meaning)},
e0_{t} AS ({exact('core')}), e1_{t} AS ({exact('poi')}),
w_{t} AS (SELECT rid, {strip_sql("unnest(string_split(pois, ';'))")} AS k FROM {source}), g_{t} AS (SELECT {strip_sql('poi')} AS k, min(rid) AS f, max(rid) AS l FROM {t} WHERE length({strip_sql('poi')}) >= 2 GROUP BY 1),
e2_{t} AS (SELECT w.rid, arg_min(g.l, g.f) AS target_rid, 100.0::DOUBLE AS score FROM w_{t} w JOIN g_{t} g USING (k) GROUP BY 1),
e3_{t} AS (SELECT rid, target_rid, score, {typed} AS match_type FROM x_{t} WHERE {SURE_SQL}),
e4_{t} AS (SELECT rid, target_rid, score, match_type FROM x_{t} WHERE score BETWEEN 90 AND 98),
u_{t} AS (""" + " UNION ALL ".join([*(f"SELECT *, '{match.EXACT_TYPES[i]}' AS match_type, {i} AS tier FROM e{i}_{t}" for i in range(3)), *(f"SELECT *, {i} FROM e{i}_{t}" for i in (3, 4))]) + ")"


LEVEL_SQL = "CASE WHEN tier <= 2 THEN 'EXACT' WHEN tier = 3 THEN 'HIGH_CONFIDENCE' WHEN tier = 4 THEN 'NEED_REVIEW' ELSE 'UNMATCHED' END"


def fall_sql(*targets: str, source: str = "src", meaning: bool = False) -> str:
    union = " UNION ALL ".join(f"SELECT *, {i} AS target FROM u_{t}" for i, t in enumerate(targets))
    first = f"SELECT *, row_number() OVER (PARTITION BY rid ORDER BY target, tier) AS n FROM ({union})"
    return ",\n".join(tier_sql(t, source, meaning) for t in targets) + f""",
fall AS (SELECT s.rid, x.target, x.target_rid, coalesce(x.score, 0.0::DOUBLE) AS score, {LEVEL_SQL} AS level, coalesce(x.match_type, 'unmatched') AS match_type FROM {source} s LEFT JOIN ({first}) x ON s.rid = x.rid AND x.n = 1)"""


def rounded(df):
    return df.withColumn("score", F.round("score", 6))


def _near(s, t):
    return match.scored(s, t, R.THRESHOLDS["review_low"])


def _shown(df):
    return rounded(df.select("rid", "target_rid", "score", "match_type"))


_PICK = "rid, target_rid, round(score, 6) AS score, match_type"
_ROW = "rid, target, target_rid, round(score, 6) AS score, level, match_type"
add("sm_exact_core", "src tgt", lambda s, t: match.exact_by(s, t, "core"), tier_sql("tgt") + " SELECT * FROM e0_tgt")
add("sm_exact_poi", "src tgt", lambda s, t: match.exact_by(s, t, "poi"), tier_sql("tgt") + " SELECT * FROM e1_tgt")
add("sm_poi_contains", "src tgt", match.contained, tier_sql("tgt") + " SELECT * FROM e2_tgt")
MEANING = tier_sql("tgt_v", "src_v", True)
add(
    "sm_high_conf", "src_v tgt_v", lambda s, t: _shown(match.high_confidence(_near(s, t))),
    MEANING + f" SELECT {_PICK} FROM e3_tgt_v"
)
add(
    "sm_need_review", "src_v tgt_v", lambda s, t: _shown(match.need_review(_near(s, t))),
    MEANING + f" SELECT {_PICK} FROM e4_tgt_v"
)
add(
    "sm_high_conf_ratio", "src tgt", lambda s, t: _shown(match.high_confidence(_near(s, t))),
    tier_sql("tgt") + f" SELECT {_PICK} FROM e3_tgt"
)
add(
    "sm_unmatched", "src tgt", lambda s, t: match.cascade(s, t).where("level = 'UNMATCHED'").select("rid", "level"),
    fall_sql("tgt") + " SELECT rid, level FROM fall WHERE level = 'UNMATCHED'"
)
add(
    "sm_cascade", "src_v tgt_v", lambda s, t: rounded(match.cascade(s, t)),
    fall_sql("tgt_v", source="src_v", meaning=True) + f" SELECT {_ROW.replace('target, ', '', 1)} FROM fall"
)
add(
    "task_waterfall", "src tgt tgt2", lambda s, *t: rounded(match.waterfall(s, list(t))),
    fall_sql("tgt", "tgt2") + f" SELECT {_ROW} FROM fall"
)
COUNTS_SQL = ", ".join(
    f"count(*) FILTER (level = '{k}') AS {k.lower()}" for k in ("EXACT", "HIGH_CONFIDENCE", "NEED_REVIEW", "UNMATCHED")
)
STATS_SQL = f", c AS (SELECT count(*) AS total, {COUNTS_SQL} FROM fall) SELECT *, exact + high_confidence AS auto_match, round((exact + high_confidence) / total * 100, 2) AS auto_rate, round((exact + high_confidence + need_review) / total * 100, 2) AS match_rate FROM c"
add(
    "match_stats", "src tgt tgt2", lambda s, *t: match.statistics(match.waterfall(s, list(t))),
    fall_sql("tgt", "tgt2") + STATS_SQL
)
DETAIL_SQL = """, d AS (SELECT CAST(i AS INTEGER) AS target, count(rid) FILTER (level = 'EXACT') AS exact, count(rid) FILTER (level = 'HIGH_CONFIDENCE') AS high_confidence,
  count(rid) FILTER (level = 'NEED_REVIEW') AS need_review, count(rid) AS matched FROM range(2) r(i) LEFT JOIN fall ON target = i GROUP BY 1),
o AS (SELECT *, CAST((SELECT count(*) FROM src) - coalesce(sum(matched) OVER (ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offered FROM d)
SELECT *, CASE WHEN offered > 0 THEN '完成' ELSE '无剩余记录' END AS status FROM o"""
add(
    "target_details", "src tgt tgt2", lambda s, *t: match.target_details(match.waterfall(s, list(t)), len(t)),
    fall_sql("tgt", "tgt2") + DETAIL_SQL
)
add(
    "task_totals", "src tgt tgt2",
    lambda s, *t: match.waterfall(s, list(t)).groupBy("level").agg(F.count("*").alias("n")),
    fall_sql("tgt", "tgt2") + " SELECT level, count(*) AS n FROM fall GROUP BY 1"
)



def _state(spark, sf_dir):
    """The totals of a task, saved as its state and read back."""
    frames = [frame(spark, sf_dir, n) for n in ("src", "tgt")]
    totals = {r.level: r.n for r in match.cascade(*frames).groupBy("level").agg(F.count("*").alias("n")).collect()}
    path = f"{shared.home(spark)}/{uuid.uuid4().hex}/tasks.json"
    sinks.save_state(spark, path, {"tasks": []})
    sinks.save_state(spark, path, {"tasks": [{"source": "甲", "targets": ["乙"], "totals": totals}]})
    return spark.createDataFrame(
        sorted(readers.read_state(spark, path)["tasks"][0]["totals"].items()), "level string, n long"
    )


QUERIES["task_state"] = _state
SQL["task_state"] = f"WITH src AS ({FRAMES['src']}), tgt AS ({FRAMES['tgt']}),\n" + fall_sql("tgt") + " SELECT level, count(*) AS n FROM fall GROUP BY 1"

# POI matching -----------------------------------------------------------------------------------------------------------


def poi_sql(source: str, pois: str, target: str, meaning: bool) -> str:
    """pm (rid, target_rid, kind, score)."""
    clean = lambda c: CLEAN_POI_SQL.replace("{c}", c)
    first = lambda c: strip_sql(f"split_part(coalesce({c}, ''), ';', 1)")
    device = f"regexp_matches(raw, '调[0-9]+|{R.any_of(R.DEVICE_WORDS)}')"
    vector = lambda t: f", {t}.v" if meaning else ""
    near = """mm AS (SELECT rid, target_rid, sim FROM (SELECT l.rid, r.rid AS target_rid, round(list_cosine_similarity(l.v::DOUBLE[], r.v::DOUBLE[]), 6) AS sim FROM pl l, pn r WHERE l.early IS NULL AND l.v IS NOT NULL AND r.v IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY sim DESC, target_rid) = 1)""" if meaning else "mm AS (SELECT NULL::BIGINT AS rid, NULL::BIGINT AS target_rid, NULL::DOUBLE AS sim WHERE false)"
    return f"""p0 AS (SELECT rid, {first(pois)} AS raw{vector(source)} FROM {source}), p1 AS (SELECT *, {clean('raw')} AS a FROM p0),
pl AS (SELECT *, CASE WHEN raw = '' THEN 'empty_left' WHEN regexp_matches(raw, '^[0-9]+$') OR {device} THEN 'non_poi_left' WHEN a = '' THEN 'no_poi_left' END AS early FROM p1),
n0 AS (SELECT rid, coalesce(poi, '') AS whole, {first('poi')} AS fp{vector(target)} FROM {target}), pn AS (SELECT * FROM (SELECT *, CASE WHEN {clean('fp')} = '' THEN whole ELSE {clean('fp')} END AS b FROM n0 WHERE NOT {ADMIN_SQL.replace('{s}', 'fp')}) WHERE b <> ''),
pb AS (SELECT b, min(rid) AS target_rid FROM pn GROUP BY 1),
{partial_sql("SELECT DISTINCT a FROM pl WHERE early IS NULL", "SELECT b FROM pb")},
pf AS (SELECT pa, target_rid, score FROM pr JOIN pb ON pb.b = pr.pb WHERE score >= 75 QUALIFY row_number() OVER (PARTITION BY pa ORDER BY score DESC, target_rid) = 1),
{near},
pk AS (SELECT l.rid, l.early, f.target_rid AS ft, coalesce(f.score, 0) AS fs, m.target_rid AS mt, coalesce(m.sim, 0) AS ms, CASE WHEN m.sim >= 0.75 THEN round(m.sim * 100, 2) ELSE 0 END AS weak FROM pl l LEFT JOIN pf f ON l.a = f.pa LEFT JOIN mm m ON l.rid = m.rid),
pt AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN (SELECT count(*) FROM pb) = 0 THEN 'no_poi_right' WHEN fs >= 90 THEN 'fuzzy_strong_poi' WHEN ms >= 0.82 THEN 'semantic_strong_poi' WHEN fs >= 75 AND fs > weak THEN 'fuzzy_weak_poi' WHEN weak > 0 THEN 'semantic_weak_poi' ELSE 'unmatched' END AS kind FROM pk),
pm AS (SELECT rid, CASE WHEN starts_with(kind, 'fuzzy') THEN ft WHEN starts_with(kind, 'semantic') THEN mt END AS target_rid, kind, CASE WHEN starts_with(kind, 'fuzzy') THEN fs WHEN starts_with(kind, 'semantic') THEN round(ms * 100, 2) ELSE 0.0::DOUBLE END AS score FROM pt)"""


_FALLBACK_SQL = ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in match.POI_TYPES.items())
REPORT_SQL = f""" SELECT '' AS "源表记录ID", '' AS "目标表记录ID", '甲.csv' AS "源表文件", m.rid + 1 AS "源表行号", '' AS "源表名称", coalesce(l.location, '') AS "源表标准化地址", coalesce(l.poi, '') AS "源表POI原始", {strip_sql("split_part(coalesce(l.poi, ''), ';', 1)")} AS "源表POI",
  CASE WHEN r.rid IS NULL THEN '' ELSE '乙.csv' END AS "目标表文件", m.target_rid + 1 AS "目标表行号", '' AS "目标表名称", '' AS "目标表标准化地址", coalesce(r.poi, '') AS "目标表POI原始", {strip_sql("split_part(coalesce(r.poi, ''), ';', 1)")} AS "目标表POI",
  k.label AS "匹配类型", m.kind AS "匹配类型代码", round(m.score, 6) AS "匹配分数", k.origin AS "POI来源", CASE WHEN r.rid IS NULL THEN '否' ELSE '是' END AS "是否匹配"
  FROM pm m JOIN addr l ON m.rid = l.rid LEFT JOIN tgt2 r ON m.target_rid = r.rid JOIN (VALUES {_FALLBACK_SQL}) k(kind, label, origin) ON m.kind = k.kind"""
add(
    "poi_match", "src_v tgt_v", lambda s, t: rounded(match.poi_match(s, t, "poi", "poi")),
    poi_sql("src_v", "poi", "tgt_v", True) + " SELECT rid, target_rid, kind, round(score, 6) AS score FROM pm"
)
add(
    "poi_match_large", "addr tgt2",
    lambda s, t: match.poi_report(
        s, t, "甲.csv", "乙.csv", "poi", "poi", "location"
    ).withColumn("匹配分数", F.round("匹配分数", 6)),
    poi_sql("addr", "poi", "tgt2", False) + REPORT_SQL
)
add(
    "poi_type_breakdown", "addr tgt", lambda s, t: match.breakdown(match.poi_match(s, t, "poi", "poi")),
    poi_sql(
        "addr", "poi", "tgt", False
    ) + " SELECT kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM pm) * 100, 2) AS rate FROM pm GROUP BY 1"
)

# Layered results --------------------------------------------------------------------------------------------------------
_TARGETS = ["乙_标准化.csv", "丙.csv"]


def _level(result, level, s, *targets):
    return sinks.layered(result, level, s, "甲_标准化.csv", list(zip(_TARGETS, targets)))


def _layers(s, *targets):
    result = match.waterfall(s, list(targets))
    parts = [_level(result, level, s, *targets) for level in sinks.LEVEL_TYPES]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("匹配分数", F.round("匹配分数", 6))


def layer_sql(level: str) -> str:
    """A level's columns; of a waterfall over tgt and tgt2."""
    kind = "CASE WHEN match_type IN ('core_field_exact', 'poi_exact', 'poi_contains', 'unmatched') THEN match_type WHEN starts_with(match_type, 'fuzzy') THEN 'fuzzy' ELSE 'semantic' END"
    own = {"core_field_exact": "core", "poi_exact": "poi", "poi_contains": "pois", "fuzzy": "poi", "semantic": "poi"}
    other = own | {"poi_contains": "poi"}
    label = {k: tuple(x.format(core="core") for x in sinks.MATCH_FIELDS[k]) for k in sinks.LEVEL_TYPES[level]}
    columns = [f's.{c} AS "[源:甲]{c}"' for c in ("rid", "core", "poi", "pois", "district")]
    for k, (a, _) in label.items():
        value = "''" if k == "unmatched" else "substr(s.pois, 1, 50)" if k == "poi_contains" else strip_sql(
            f"s.{own[k]}"
        )
        columns.append(f"""CASE WHEN {kind} = '{k}' THEN {value} END AS "【匹配源:甲】{a}\"""")
    for i, name in enumerate(("乙", "丙")):
        if level == "UNMATCHED":
            columns += [f"""'' AS "【匹配目标:{name}】匹配值\""""] if i == 0 else []
            continue
        columns += [
            f"""CASE WHEN {kind} = '{k}' THEN {strip_sql(f't{i}.{other[k]}')} END AS "【匹配目标:{name}】{b}\"""" for k,
            (_, b) in label.items()
        ]
    columns += [
        'round(score, 6) AS "匹配分数"', 'match_type AS "匹配类型"',
        f"""'{dict(EXACT='精确匹配', HIGH_CONFIDENCE='高置信度', NEED_REVIEW='需人工确认', UNMATCHED='未匹配')[level]}' AS "匹配层级\""""
    ]
    joins = ""
    if level != "UNMATCHED":
        columns += [
            f"""CASE target WHEN 0 THEN '{_TARGETS[0]}' WHEN 1 THEN '{_TARGETS[1]}' END AS "目标表文件\"""",
            'target_rid + 1 AS "目标表行号"'
        ]
        columns += [
            f't{i}.{c} AS "[目标:{name}]{c}"' for i,
            name in enumerate(("乙", "丙")) for c in ("rid", "core", "poi", "pois", "district")
        ]
        joins = " LEFT JOIN tgt t0 ON target = 0 AND t0.rid = target_rid LEFT JOIN tgt2 t1 ON target = 1 AND t1.rid = target_rid"
    return f"SELECT {', '.join(columns)} FROM fall f JOIN src s ON f.rid = s.rid{joins} WHERE level = '{level}'"


add(
    "layered_export", "src tgt tgt2", _layers,
    fall_sql("tgt", "tgt2") + " " + " UNION ALL BY NAME ".join(map(layer_sql, sinks.LEVEL_TYPES))
)


def _merged(s, t):
    out = match.cascade(s, t)
    parts = {
        k: out.where(F.col("level") == k) for k in ("EXACT", "HIGH_CONFIDENCE", "NEED_REVIEW")
    } | {"UNMATCHED": out.where("level = 'UNMATCHED'").drop("target_rid", "score")}
    return rounded(sinks.merged(parts, ["EXACT", "NEED_REVIEW", "UNMATCHED"]))


add(
    "merge_levels", "src tgt", _merged,
    fall_sql("tgt") + " SELECT rid, target_rid, CASE WHEN level <> 'UNMATCHED' THEN round(score, 6) END AS score, level, match_type FROM fall WHERE level <> 'HIGH_CONFIDENCE'"
)


def _coloured(spark, sf_dir):
    """The columns of a layered result and the colours that a workbook of them has; the rows are those of a level's first ten."""
    frames = [frame(spark, sf_dir, n) for n in ("src", "tgt", "tgt2")]
    rows = _level(match.waterfall(frames[0], frames[1:]), "EXACT", *frames)
    found = readers.header_colours(sinks.coloured_bytes(rows.orderBy("`[源:甲]rid`").limit(10), "甲.csv"))
    return spark.createDataFrame(found, "name string, colour string")


_COLUMNS = ["[源:甲]rid", "[源:甲]core", "[源:甲]poi", "[源:甲]pois", "[源:甲]district", *(
    f"【匹配{side}】{x}" for side in ("源:甲", "目标:乙", "目标:丙") for x in ("core", "POI_结构化", "标准化POI抽取 contains POI_结构化")
),
            "匹配分数", "匹配类型", "匹配层级", "目标表文件", "目标表行号", *(
                f"[目标:{t}]{c}" for t in "乙丙" for c in ("rid", "core", "poi", "pois", "district")
            )]
QUERIES["excel_coloured"] = _coloured
SQL["excel_coloured"] = f"""SELECT name, CASE WHEN starts_with(name, '[源:') THEN '{sinks.COLOURS['source'][0]}' WHEN starts_with(name, '[目标:') OR starts_with(name, '目标表') THEN '{sinks.COLOURS['target'][0]}' ELSE '{sinks.COLOURS['match'][0]}' END AS colour
  FROM (SELECT unnest([{', '.join(f"'{c}'" for c in _COLUMNS)}]) AS name)"""

# Enrichment -------------------------------------------------------------------------------------------------------------


def _structured(texts):
    """A stand-in for a service: it knows no address on one of the roads."""
    parts = F.when(
        F.col("text").contains("road=人民路"), F.create_map().cast("map<string,string>")
    ).otherwise(T.parse_kv(F.col("text")))
    return texts.select("text", parts.alias("structure"))


def _predicted(addresses):
    """Another one: by the length of an address it fails, finds nothing, or names a POI."""
    n = F.length("std")
    return addresses.select(
        "std", F.when(n % 3 == 1, "").when(n % 3 == 2, F.concat(F.lit("预测"), n.cast("string"))).alias("poi")
    )


def _enriched(rows, provinces, cities, areas):
    """With tables of answers that are stored and read back, in two batches of which the later one counts."""
    spark, folder = rows.sparkSession, f"{shared.home(rows.sparkSession)}/{uuid.uuid4().hex}"
    text = shared.spread(rows.select(
        T.strip(F.col("structure")).alias("text"), "rid"
    ).where("text <> '' and rid % 3 = 0").select("text").distinct())
    enrich.keep(
        text.select("text", F.create_map(F.lit("city"), F.lit("旧市")).alias("structure")), f"{folder}/structures", 1
    )
    enrich.keep(text.select("text", T.parse_kv(F.col("text")).alias("structure")), f"{folder}/structures", 2)
    parsed = shared.spread(rows.where("rid % 5 = 0 and structure <> ''").select("structure").distinct()).select(
        T.parse_kv(F.col("structure")).alias("parts")
    )
    std = parsed.select(
        T.std_address(
            {
                k: F.col("parts")[k]
                for k in ("prov", "city", "district", "town", "village", "road", "roadNo", "poi", "houseno", "cellno")
            }
        ).alias("std")
    ).distinct()
    enrich.keep(
        std.select(
            "std",
            F.when(F.length("std") % 2 == 0, "").otherwise(F.concat(F.lit("缓存"), F.substring("std", 1, 2))).alias("poi")
        ),
        f"{folder}/pois", 1
    )
    known = enrich.load(
        spark, f"{folder}/structures", enrich.STRUCTURES
    ), enrich.load(spark, f"{folder}/pois", enrich.POIS)
    return enrich.standardise(rows, "structure", *known, _structured, _predicted, (provinces, cities, areas))[0]


ENRICH_SQL = f"""t0 AS (SELECT rid, {strip_sql('structure')} AS structure FROM kv10),
t1 AS (SELECT *, structure <> '' AND structure IN (SELECT structure FROM t0 WHERE rid % 3 = 0) AS sc FROM t0),
t2 AS (SELECT rid, CASE WHEN sc OR NOT contains(structure, 'road=人民路') THEN structure ELSE '' END AS structure, sc FROM t1),
t3 AS (SELECT rid, sc, structure, {STD_SQL} AS std FROM t2),
pc AS (SELECT DISTINCT {STD_SQL} AS std FROM kv10 WHERE rid % 5 = 0 AND structure <> ''),
t4 AS (SELECT t3.*, pc.std IS NOT NULL AND t3.std <> '' AS hit, CASE WHEN t3.std = '' THEN NULL WHEN pc.std IS NOT NULL THEN CASE WHEN length(t3.std) % 2 = 0 THEN '' ELSE '缓存' || substr(t3.std, 1, 2) END
  WHEN length(t3.std) % 3 = 1 THEN '' WHEN length(t3.std) % 3 = 2 THEN '预测' || length(t3.std) END AS predicted FROM t3 LEFT JOIN pc ON t3.std = pc.std),
t5 AS (SELECT *, {', '.join(f"coalesce({TEN_SQL[k]}, '') AS {k}" for k in TEN_SQL)} FROM t4)"""
_NAMED = {
    "区县": "district", "街道镇": "town", "村社区": "village", "道路": "road", "门牌号": "roadNo", "POI_结构化": "poi", "楼号": "houseno",
    "单元号": "cellno", "房间号": "roomno"
}
ENRICHED_SQL = ENRICH_SQL + f""", t6 AS (SELECT rid, std AS "标准化地址", CASE WHEN predicted <> '' THEN predicted ELSE poi END AS "标准化POI抽取", CASE WHEN predicted <> '' THEN 'predict' WHEN poi <> '' THEN 'structure' WHEN structure = '' AND NOT EXISTS (SELECT 1 FROM t0 WHERE t0.rid = t5.rid AND t0.structure <> '') THEN '' ELSE 'empty' END AS "POI来源",
  CASE WHEN prov = '' THEN coalesce((SELECT p.name FROM cities c JOIN provinces p ON c.provinceCode = p.code WHERE c.name = city), '') ELSE prov END AS "省", city AS "市", {', '.join(f'{c} AS "{n}"' for n, c in _NAMED.items())}, sc AS structure_cached, hit AS poi_cached, sc AND hit AS cached FROM t5)"""
add(
    "address_parse_cached", "kv10 provinces cities areas", lambda r, *dims: _enriched(r, *dims).drop("structure"),
    ENRICHED_SQL + " SELECT * FROM t6"
)
add(
    "cache_hit_counts", "kv10 provinces cities areas", lambda r, *dims: enrich.hits(_enriched(r, *dims)),
    ENRICHED_SQL + " SELECT count(*) AS total, count(*) FILTER (structure_cached OR poi_cached) AS hits FROM t6"
)



def _parts(text):
    """A stand-in for a service's client, which fails for one road."""
    if "road=人民路" in text:
        raise ValueError(text)
    found = dict(p.split("=", 1) for p in text.split() if "=" in p)
    return {k: v for k, v in found.items() if v}


def _streamed(rows):
    """All answers to the different addresses, asked in batches of a stream, each of which is kept before the next one starts."""
    spark, folder = rows.sparkSession, f"{shared.home(rows.sparkSession)}/{uuid.uuid4().hex}"
    answers.ask(rows, "structure", f"{folder}/asked")
    kind = "map<string,string>"
    provider = answers.limited(_parts, "structure", "parts", kind, answers.Limits(1e6, 1000, 1, 0.0))
    found = answers.resume(
        spark, f"{folder}/asked", f"{folder}/answers", f"{folder}/checkpoint", provider, "structure", "parts", kind, 4
    )
    return found.select("structure", *(F.col("parts")[k].alias(k) for k in ("prov", "city", "road")))


_KEYED = r"nullif(regexp_extract(structure, '(^|\s){k}=(\S*)', 2), '') AS {k}"
add(
    "address_answers_streamed", "kv10", _streamed,
    f"SELECT DISTINCT structure, {', '.join(_KEYED.replace('{k}', k) for k in ('prov', 'city', 'road'))} FROM (SELECT trim(structure) AS structure FROM kv10) WHERE structure <> '' AND NOT contains(structure, 'road=人民路')"
)

FLAGSHIP = QUERIES["match_stats"]
