"""Queries over sources and sinks: files are written to the folder that all executors share, and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..operators import profile
from ..sources import layers, readers, shared, sinks
from .fixtures import FRAMES, frame, pick
from .registry import QUERIES, SQL, add


def _place(spark) -> str:
    return f"{shared.home(spark)}/{uuid.uuid4().hex}"


def _nations(spark, sf_dir):  # a fixed table of 25 rows
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_nationkey", "n_regionkey")


NATIONS_SQL = "SELECT CAST(n_name AS VARCHAR) AS n_name, CAST(n_nationkey AS VARCHAR) AS n_nationkey, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"

# Frames of sinks --------------------------------------------------------------------------------------------------------
add("export_frame", "addr", lambda df: sinks.chosen(df, ["rid", "absent", "city"]), "SELECT rid, city FROM addr")
POLICY_SQL = "CASE WHEN count(*) * 400 > 100000 THEN 'csv' WHEN count(*) * 400 > 50000 THEN 'plain_excel' ELSE 'excel' END"
add("export_size_policy", "src", lambda df: df.groupBy(
    (F.col("rid") % 5).alias("part")
).agg((F.count("*") * 400).alias("n")).select(
    "part", "n", sinks.format_policy(F.col("n")).alias("format")
),
    f"SELECT rid % 5 AS part, count(*) * 400 AS n, {POLICY_SQL} AS format FROM src GROUP BY 1")


def _written(spark, sf_dir):
    path = _place(spark)
    sinks.write_csv(frame(spark, sf_dir, "addr").select("rid", "province", "poi"), path)
    first = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select(
        F.hex(F.substring("content", 1, 3)).alias("c")
    ).distinct().collect()
    if [r.c for r in first] != ["EFBBBF"]:
        raise ValueError("a file lacks its byte order mark")
    return readers.read_csv(spark, path, "utf-8").na.fill("")


QUERIES["sink_csv"] = _written
SQL["sink_csv"] = f"WITH addr AS ({FRAMES['addr']}) SELECT coalesce(poi, '') AS poi, coalesce(province, '') AS province, CAST(rid AS VARCHAR) AS rid FROM addr"
_ENDINGS = "_清洗.csv,_标准化.csv,_精确匹配_3条,_高置信度_2条.csv,_未匹配_9条,字段关联.csv,其他.csv,_需人工确认_1条"
RESULTS_SQL = f"SELECT concat(n_name, {pick(_ENDINGS, 'n_nationkey')}) AS name FROM nation"


def _categories(spark, sf_dir):
    """Folders and files of results, copied by category."""
    folder, out = _place(spark), _place(spark)
    for r in frame(spark, sf_dir, RESULTS_SQL).collect():  # a fixed table of 25 rows
        shared.write_bytes(spark, f"{folder}/{r.name}", "a\n1\n".encode())
    found = sinks.export_categories(spark, [folder, f"{folder}/none"], ["清洗结果", "匹配结果", "未匹配数据", "关联分析结果"], out)
    there = spark.read.format("binaryFile").load(out).select(
        F.element_at(F.split(F.url_decode("path"), "/"), -1).alias("name"), "length"
    )
    return found.join(there, "name").select("name", "category", "length")


QUERIES["export_categories"] = _categories
SQL["export_categories"] = f"""SELECT name, category, 4::BIGINT AS length FROM (SELECT name, CASE WHEN regexp_matches(name, '_清洗(.csv)?$') THEN '清洗结果' WHEN regexp_matches(name, '_标准化(.csv)?$') THEN '标准化结果' WHEN regexp_matches(name, '精确匹配|高置信度|需人工确认') THEN '匹配结果'
  WHEN contains(name, '未匹配') THEN '未匹配数据' WHEN contains(name, '关联') THEN '关联分析结果' END AS category FROM ({RESULTS_SQL})) WHERE category <> '标准化结果'"""

# Sources ----------------------------------------------------------------------------------------------------------------


def _csv(spark, sf_dir):
    path = _place(spark)
    sinks.write_csv(spark.read.parquet(f"{sf_dir}/nation.parquet"), path)
    return readers.read_csv(spark, path, "utf-8")


def _geojson(spark, sf_dir):
    path = _place(spark)
    nations = _nations(spark, sf_dir)
    point = F.struct(
        F.lit("Point").alias("type"), F.array(F.col("n_nationkey").cast("double"), F.lit(0.5)).alias("coordinates")
    )
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct("n_name", "n_regionkey").alias("properties"), point.alias("geometry")
    )
    nations.agg(
        F.to_json(
            F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))
        ).alias("value")
    ).coalesce(1).write.text(path)
    return readers.read_geojson(spark, path)


def _book(spark, sf_dir):
    path = _place(spark) + ".xlsx"
    shared.write_bytes(spark, path, sinks.workbook_bytes(_nations(spark, sf_dir)))
    return path


def _shapes(spark, sf_dir):
    points, base = _nations(spark, sf_dir).withColumn("x", F.col("n_nationkey") + 0.5).withColumn(
        "y", F.col("n_regionkey") - 2.25
    ), _place(spark)
    layers.write_points(points.withColumnRenamed("n_name", "标准化地址"), base, "x", "y")
    return readers.read_shapefile(spark, base)


#: Points, lines and polygons (with a hole) around whole numbers, as a layer's texts have them.
_KINDS = {
    "point": "concat('POINT (', x, ' ', y, ')')",
    "line": "concat('MULTILINESTRING ((', x, ' ', y, ', ', x + 1, ' ', y, '), (', x, ' ', y + 2, ', ', x + 3, ' ', y + 2, ', ', x + 3, ' ', y + 5, '))')",
    "polygon": "concat('POLYGON ((', x, ' ', y, ', ', x, ' ', y + 9, ', ', x + 9, ' ', y + 9, ', ', x + 9, ' ', y, ', ', x, ' ', y, '), (', x + 1, ' ', y + 1, ', ', x + 2, ' ', y + 1, ', ', x + 2, ' ', y + 2, ', ', x + 1, ' ', y + 1, '))')",
}


def _drawn(kind: str) -> str:
    return f"SELECT id, name, {_KINDS[kind]} AS geometry FROM (SELECT c_custkey AS id, c_name AS name, CAST(c_custkey % 360 - 180 AS INT) AS x, CAST(c_nationkey AS INT) AS y FROM customer)"


def _written_layers(spark, sf_dir):
    """Layers of each kind of shape, written by many tasks in parts and read by ranges of records."""
    out = []
    for kind in _KINDS:
        folder = _place(spark)
        layers.write(frame(spark, sf_dir, _drawn(kind)), folder, projection='PROJCS["flat"]', records=1000)
        out.append(readers.read_shapefile(spark, folder, 400).withColumn("kind", F.lit(kind)))
    return reduce(lambda a, b: a.unionByName(b), out)


def _national(spark, sf_dir, encoding, lines):
    """A folder of two files in a national encoding, with a header each, found out by all of their bytes."""
    folder, rows = _place(spark), _nations(spark, sf_dir).orderBy("n_nationkey").collect()
    for i in (0, 1):
        body = "".join(lines(r) for r in rows if r.n_nationkey % 2 == i)
        shared.write_bytes(spark, f"{folder}/{i}.csv", ("名称,编号\n" + body).encode(encoding))
    return folder


def _auto(spark, sf_dir):
    """Names hold line ends, and one row is the header once more."""
    folder = _national(
        spark, sf_dir, "gbk", lambda r: f'"{r.n_name}\n省",{r.n_nationkey}\n' + ("名称,编号\n" if r.n_nationkey == 2 else "")
    )
    if readers.encoding_of(spark, folder) != "gbk":
        raise ValueError("the encoding was not found")
    return readers.read_csv(spark, folder).select(F.regexp_replace("名称", "\n", "").alias("名称"), "编号")


def _multi(spark, sf_dir):
    """A letter that GBK does not have."""
    return readers.read_any(
        spark,
        _national(spark, sf_dir, "gb18030", lambda r: f"{r.n_name}㐀{chr(0x20000 + r.n_nationkey)},{r.n_nationkey}\n")
    )


def _converted(spark, sf_dir):
    """A workbook, written as CSV and read again."""
    path = _place(spark)
    sinks.write_csv(readers.auto(spark, _book(spark, sf_dir)), path)
    return readers.read_csv(spark, path)


def _resolved(spark, sf_dir):
    """The first of the folders that has each of the files: every region's is in the second one, every other's in the first too."""
    folder, found = _place(spark), []
    for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect():  # a fixed table of five rows
        for place in ["a", "b", "c"][r.r_regionkey % 2 :]:
            shared.write_bytes(spark, f"{folder}/{place}/{r.r_name}.csv", b"a\n")
        at = readers.resolve(spark, f"{r.r_name}.csv", [f"{folder}/{d}" for d in ("none", "a", "b", "c")])
        found.append((f"{r.r_name}.csv", at.removeprefix(folder)))
    return spark.createDataFrame(found, "name string, path string")


QUERIES |= {
    "csv_to_layer": _written_layers, "scan_csv": _csv, "scan_geojson": _geojson, "scan_excel": lambda spark, sf_dir: readers.auto(
        spark, _book(spark, sf_dir)
    ), "scan_shp": _shapes, "scan_auto": _auto, "scan_pandas_multi": _multi,
    "convert_to_csv": _converted, "resolve_path": _resolved, "file_columns": lambda spark, sf_dir: profile.names_frame(
        spark, _csv(spark, sf_dir).columns
    ),
}
SQL |= {
    "csv_to_layer": " UNION ALL ".join(
        f"SELECT CAST(id AS VARCHAR) AS id, name, geometry, 'flat' AS crs, '{k}' AS kind FROM ({_drawn(k)})" for k in _KINDS
    ),
    "scan_csv": NATIONS_SQL, "scan_excel": NATIONS_SQL, "convert_to_csv": NATIONS_SQL, "file_columns": "SELECT unnest(['n_name', 'n_nationkey', 'n_regionkey']) AS name",
    "scan_geojson": """SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, '{"coordinates":[' || CAST(CAST(n_nationkey AS DOUBLE) AS VARCHAR) || ',0.5],"type":"Point"}' AS geometry FROM nation""",
    "scan_shp": """SELECT n_name AS "标准化", CAST(n_nationkey AS VARCHAR) AS n_nationke, CAST(n_regionkey AS VARCHAR) AS n_regionke,
    'POINT (' || (n_nationkey + 0.5::DOUBLE) || ' ' || (n_regionkey - 2.25::DOUBLE) || ')' AS geometry, CAST(NULL AS VARCHAR) AS crs FROM nation""",
    "scan_auto": """SELECT n_name || '省' AS "名称", CAST(n_nationkey AS VARCHAR) AS "编号" FROM nation UNION ALL SELECT '名称', '编号'""",
    "scan_pandas_multi": """SELECT n_name || '㐀' || chr(CAST(131072 + n_nationkey AS INT)) AS "名称", CAST(n_nationkey AS VARCHAR) AS "编号" FROM nation""",
    "resolve_path": "SELECT concat(r_name, '.csv') AS name, concat(CASE WHEN r_regionkey % 2 = 0 THEN '/a/' ELSE '/b/' END, r_name, '.csv') AS path FROM region",
}
