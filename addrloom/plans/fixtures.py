"""Input frames of the queries, derived from the tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import spread

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
_PICK = "split_part('{}', ',', CAST({} % {} + 1 AS INT))"


def pick(words: str, key: str) -> str:
    return _PICK.format(words, key, words.count(",") + 1)


def _poi(key: str, tail: str) -> str:
    return f"concat({pick('阳光花园小区,东方国际商场,绿地中心公寓,解放路第一医院,和平新村家属院,中山实验学校', key)}, {pick('北门服务中心,南区物业大楼,东侧文化广场,西苑综合市场', key)}, {pick(tail, key)})"


FRAMES = {
    "addr": f"""SELECT c_custkey AS rid,
      CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN '  ' ELSE {pick('浙江省,江苏省,广东省', 'c_custkey')} END AS province,
      CASE WHEN c_custkey % 11 < 2 THEN NULL ELSE {pick('杭州市,苏州市,广州市', 'c_custkey')} END AS city,
      CASE WHEN c_custkey % 11 < 2 OR c_custkey % 7 = 2 THEN '' ELSE {pick('西湖区,姑苏区,天河区,nan', 'c_custkey')} END AS district,
      CASE WHEN c_custkey % 11 < 2 OR c_custkey % 3 = 0 THEN NULL ELSE concat({pick('文三路,人民路高压A,中山路 ,无门牌号解放路无无', 'c_custkey')}, CAST(c_custkey % 97 AS VARCHAR(10)), '号') END AS street,
      CASE WHEN c_custkey % 11 = 0 OR c_custkey % 3 = 0 THEN NULL ELSE concat({pick('阳光花园,东方商场（东门）,绿地小区_3,12调压站7,和平村,某某市,2034', 'c_custkey')}, CASE WHEN c_custkey % 4 = 0 THEN ';第二广场' ELSE '' END) END AS poi,
      CASE WHEN c_custkey % 22 = 0 THEN NULL WHEN c_custkey % 22 = 1 THEN '东大街旧址' ELSE CAST(c_custkey AS VARCHAR(10)) END AS location,
      CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '100' END AS const_code, CAST(NULL AS VARCHAR(10)) AS nothing FROM customer""",
    "src": f"""SELECT c_custkey AS rid, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('K', CAST(c_custkey % 211 AS VARCHAR(10)), ' ') END AS core,
      CASE WHEN c_custkey % 13 = 0 THEN ' ' ELSE {_poi('c_custkey', '一二三四,甲乙丙丁,子丑寅卯,一二三四五')} END AS poi,
      concat({pick('城西阁,万家灯火城,无,海天楼', 'c_custkey')}, ';', {pick('星河湾,一品轩,银泰城 ,和,山水居', 'c_custkey')}) AS pois,
      CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('D', CAST(c_nationkey % 5 AS VARCHAR(10))) END AS district FROM customer""",
    "tgt": f"""SELECT s_suppkey AS rid, CASE WHEN s_suppkey % 4 = 0 THEN concat(' K', CAST(s_suppkey % 17 AS VARCHAR(10))) ELSE '' END AS core,
      CASE WHEN s_suppkey % 7 = 0 THEN {pick('星河湾,银泰城,和,海天楼', 's_suppkey')} ELSE {_poi('s_suppkey', '一二三四,甲乙丙,子丑寅卯,二三四五六七,一二三四六')} END AS poi,
      '' AS pois, CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE concat('D', CAST(s_nationkey % 5 AS VARCHAR(10))) END AS district FROM supplier""",
    "tgt2": f"""SELECT p_partkey AS rid, concat('K', CAST(p_partkey % 40 + 17 AS VARCHAR(10))) AS core, {_poi('p_partkey', '一二三四,子丑寅卯辰,东南西北')} AS poi, '' AS pois,
      concat('D', CAST(p_size % 5 AS VARCHAR(10))) AS district FROM part""",
    "kv10": f"""SELECT c_custkey AS rid, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('prov=', CASE WHEN c_custkey % 7 = 0 THEN '' ELSE {pick('浙江省,江苏省,广东省', 'c_custkey')} END, ' city=', {pick('杭州市,苏州市,广州市', 'c_custkey')},
      ' district=', {pick('西湖区,姑苏区,,天河区', 'c_custkey')}, ' town=', {pick('文一街道,,平江街道', 'c_custkey')}, ' village=', {pick(',东村', 'c_custkey')}, ' road=', {pick('文三路,人民路,中山路', 'c_custkey')}, ' roadNo=', CAST(c_custkey % 13 AS VARCHAR(10)), '号',
      ' poi=', {pick('阳光花园,,商场', 'c_custkey')}, ' houseno=', {pick('3,,12', 'c_custkey')}, ' cellno=', {pick(',2', 'c_custkey')}, ' roomno=', CAST(c_custkey % 5 AS VARCHAR(10))) END AS structure FROM customer""",
    "lt": "SELECT c_custkey AS lid, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 17 = 1 THEN '  ' ELSE concat(' N', CAST(c_custkey % 300 AS VARCHAR(10))) END AS ka, CASE WHEN c_custkey % 17 < 2 THEN NULL ELSE CAST(nullif(c_nationkey % 7, 0) AS VARCHAR(10)) END AS kb FROM customer",
    "rt": "SELECT s_suppkey AS rid, CASE WHEN s_suppkey % 19 = 0 THEN NULL ELSE concat('n', CAST(s_suppkey * 2 AS VARCHAR(10)), ' ') END AS ka, CAST(nullif(s_nationkey % 7, 0) AS VARCHAR(10)) AS kb FROM supplier",
    "rows_": """SELECT c_custkey AS rid, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN concat(CAST(c_custkey AS VARCHAR(10)), '.0') WHEN c_custkey % 9 = 2 THEN 'abc' ELSE CAST(c_custkey AS VARCHAR(10)) END AS gid,
      CASE WHEN c_custkey % 4 = 0 THEN concat(' P', CAST(c_custkey % 60 AS VARCHAR(10))) ELSE '' END AS v1, CASE WHEN c_custkey % 5 = 0 THEN concat('p', CAST(c_custkey % 90 AS VARCHAR(10))) END AS v2 FROM customer""",
    "db_": """SELECT CAST(c_custkey AS VARCHAR(10)) AS code, concat('P', CAST(c_custkey AS VARCHAR(10))) AS name, CAST(c_custkey % 100 AS DOUBLE) AS x, CAST(c_custkey % 50 AS DOUBLE) AS y FROM customer WHERE c_custkey % 3 <> 0
      UNION ALL SELECT CAST(s_suppkey % 40 AS VARCHAR(10)), concat('p', CAST(s_suppkey % 30 AS VARCHAR(10))), CAST(s_suppkey AS DOUBLE) / 10, CAST(s_suppkey AS DOUBLE) / 20 FROM supplier""",
    "shp_": """SELECT c_custkey AS seq, concat(CAST(c_custkey AS VARCHAR(10)), CASE WHEN c_custkey % 2 = 0 THEN '.0' ELSE '' END) AS gid, CAST(c_custkey % 100 AS DOUBLE) + CAST(c_custkey % 8 AS DOUBLE) / 40000 AS x, CAST(c_custkey % 50 AS DOUBLE) AS y FROM customer WHERE c_custkey % 10 <> 0""",
    "provinces": "SELECT * FROM (VALUES ('33', '浙江省'), ('32', '江苏省'), ('44', '广东省')) AS t(code, name)",
    "cities": "SELECT * FROM (VALUES ('3301', '杭州市', '33'), ('3205', '苏州市', '32'), ('4401', '广州市', '44'), ('3302', '宁波市', '33')) AS t(code, name, provinceCode)",
    "areas": "SELECT * FROM (VALUES ('330106', '西湖区', '3301'), ('320508', '姑苏区', '3205'), ('440106', '天河区', '4401'), ('330203', '海曙区', '3302'), ('999999', '西湖区', '4401')) AS t(code, name, cityCode)",
    "places": f"""SELECT c_custkey AS rid, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE {pick('浙江省,江苏省,广东省,福建省', 'c_custkey')} END AS province, CASE WHEN c_custkey % 4 < 2 THEN NULL ELSE {pick('杭州市,苏州市,广州市,宁波', 'c_custkey')} END AS city,
      {pick('西湖区,姑苏区,天河,海曙区,某某区', 'c_custkey')} AS area, concat({pick('浙江省杭州市,苏州市,广州,宁波市海曙区', 'c_custkey')}, {pick('西湖区文三路,姑苏区人民路,天河区域内,路边', 'c_custkey + 1')}) AS address FROM customer""",
    "kv": f"""SELECT c_custkey AS rid, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('prov=', {pick('浙江省,江苏省', 'c_custkey')}, '  city=', {pick('杭州市,苏州市,广州市', 'c_custkey')}, ' road=', {pick('文三路,人民路', 'c_custkey')}, ' poi=', {pick('阳光花园,商场', 'c_custkey')}, ' houseno=', CAST(c_custkey % 12 AS VARCHAR(10)), ' bad') END AS structure,
      CASE WHEN c_custkey % 4 = 0 THEN concat('预测', CAST(c_custkey % 5 AS VARCHAR(10))) WHEN c_custkey % 4 = 1 THEN ' ' END AS predicted FROM customer""",
}

_STEMS = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉"


def _stem(key: str) -> str:
    """A name of two letters, of which there are four hundred."""
    at = lambda k: f"substr('{_STEMS}', CAST({k} % 20 AS INT) + 1, 1)"
    return f"concat({at(key)}, {at(f'CAST(floor({key} / 20) AS INT)')})"


#: Streets of the areas, and addresses that name some of them.
FRAMES |= {
    "streets": f"""SELECT CAST(330106000000 + p_partkey AS VARCHAR(20)) AS code, concat({_stem('p_partkey')}, {pick('街道,镇,乡,街道办事处,街道', 'p_partkey')}) AS name, {pick('330106,320508,440106,330203', 'p_partkey')} AS areaCode FROM part""",
    "spots": f"""SELECT c_custkey AS rid, CASE WHEN c_custkey % 3 = 0 THEN '浙江省' WHEN c_custkey % 3 = 1 THEN '' END AS province, CASE WHEN c_custkey % 4 = 0 THEN {pick('杭州市,苏州市,宁波,某某市', 'c_custkey')} ELSE '' END AS city,
      CASE WHEN c_custkey % 5 = 0 THEN {pick('西湖区,姑苏县,天河,无此区', 'c_custkey')} END AS area, CASE WHEN c_custkey % 7 = 0 THEN concat({_stem('c_custkey')}, '街道') ELSE '' END AS street,
      CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE concat({pick('浙江省杭州市,苏州市,广州,江苏省', 'c_custkey')}, {pick('西湖区,姑苏区域,天河区,,', 'c_custkey')}, {_stem('(c_custkey * 7)')}, {pick('街道,镇村,乡,路,办事处,镇,街道办事处', 'c_custkey')}, CAST(c_custkey % 90 AS VARCHAR(10)), '号', CASE WHEN c_custkey % 6 = 0 THEN concat({_stem('(c_custkey * 3)')}, '街道') ELSE '' END) END AS address FROM customer""",
}

#: Cities of nations, quarters of them, and names of fields.
FRAMES |= {
    "towns": f"SELECT CAST(s_suppkey AS VARCHAR(10)) AS code, concat({_stem('s_suppkey')}, {pick('市,地区,镇', 's_suppkey')}) AS name, CAST(s_nationkey AS VARCHAR(10)) AS provinceCode FROM supplier",
    "seats": "SELECT CAST(n_nationkey AS VARCHAR(10)) AS code, concat('N', CAST(n_regionkey AS VARCHAR(10)), '市') AS name FROM nation",
    "quarters": f"SELECT CAST(c_custkey AS VARCHAR(10)) AS code, concat({_stem('c_custkey')}, '区') AS name, CAST(c_nationkey AS VARCHAR(10)) AS cityCode FROM customer",
    "fields_": f"SELECT DISTINCT concat({pick('省份,city_name,District,街道,addr,detail address,楼号,小区,uid,width,姓名,telephone,e-mail,remark', 'c_custkey')}, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('_', CAST(c_custkey % 20 AS VARCHAR(10))) END) AS name FROM customer",
}

#: With an embedding of the POI, for semantic scores.
FRAMES |= {
    "src_v": f"SELECT s.*, e.embedding AS v FROM ({FRAMES['src']}) s LEFT JOIN embeddings e ON e.vec_id = s.rid % 61",
    "tgt_v": f"SELECT t.*, e.embedding AS v FROM ({FRAMES['tgt']}) t LEFT JOIN embeddings e ON e.vec_id = t.rid % 37",
}


#: Tables that do not grow, and vectors, which come in rows of their own and are joined to others.
_AS_READ = ("region", "nation", "embeddings")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Rows of tables that grow are dealt to all tasks, as what follows works by the row."""
    for t in TABLES:
        if t in FRAMES.get(name, name):
            rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            (rows if t in _AS_READ else spread(rows)).createOrReplaceTempView(t)
    return spark.sql(FRAMES.get(name, name))
