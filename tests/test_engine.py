import io
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrloom.functions import geo, similarity, text as T
from addrloom.operators import clean, enrich, join, match, nearest, profile, region
from addrloom.sources import layers, readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_ratio_properties():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert similarity.lcs(a, b) == brute_lcs(a, b)
        assert similarity.ratio(a, b) == similarity.ratio(b, a) and 0 <= similarity.ratio(a, b) <= 100 and similarity.ratio(a, a) == 100
        assert similarity.partial(a, b) >= 0 and (not a or similarity.partial(a, a + b) == 100)


def test_candidates_lose_no_pair(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 14))) for _ in range(120)]
    words += [w[:3] + "x" + w[3:] for w in words[:60]]
    df = spark.createDataFrame([(w,) for w in words], "a string")
    for least in (70.0, 90.0):
        got = {(x.a, x.b) for x in similarity.candidates(df, df.withColumnRenamed("a", "b"), least).collect()}
        assert got == {(a, b) for a in set(words) for b in set(words) if similarity.ratio(a, b) >= least}


def test_text_goldens(spark):
    s = lambda v: F.lit(v)
    assert one(spark, T.sanitize(s(" 高压A站无3号无无 无门牌号"))) == "A站3号 牌号"
    assert one(spark, T.sanitize(s("解放路高压A"))) == "解放路A"
    assert one(spark, T.sanitize(s("无门牌号"))) == "牌号"
    assert one(spark, T.dedupe_admin(s("杭州市杭州市西湖区"))) == "杭州市西湖区"
    assert similarity.without_repeats("文三路12号阳光文三路12号") == "文三路12号阳光"
    assert one(spark, T.is_pure_admin(s("浙江省杭州市"))) is True and one(spark, T.is_pure_admin(s("杭州市东街"))) is False
    assert one(spark, T.is_pure_admin(s("台州市"))) is True and one(spark, T.is_pure_admin(s("厦门市"))) is False
    assert one(spark, T.parse_kv(s("a=1  b=x=y bad =z"))) == {"a": "1", "b": "x=y"}
    assert [one(spark, T.gid_norm(s(v))) for v in ("12.0", " 7 ", "x", "inf")] == ["12", "7", None, None]


def test_similarity_goldens():
    assert similarity.difflib_score("abc", "abc") == 1 and similarity.difflib_score("", "a") == 0
    assert round(similarity.difflib_score("abcd", "abce"), 6) == 0.75
    assert similarity.partial("abc", "xxabcxx") == 100 and round(similarity.partial("abc", "xabx"), 4) == 66.6667


def test_tiers_partition_the_source(spark):
    src = spark.createDataFrame(
        [
            (1, "k1", "甲乙丙丁戊己庚辛壬癸", "", "D"), (2, None, "甲乙丙丁戊己庚辛壬子", "", "D"), (3, "", "", "城;好园", None),
            (4, "q", "别的地方", "", None)
        ],
        "rid long, core string, poi string, pois string, district string"
    )
    tgt = spark.createDataFrame(
        [(1, "k1", "无关", "", "D"), (2, "k1", "甲乙丙丁戊己庚辛壬癸", "", "D"), (3, "", "好园", "", None), (4, "", "好园", "", None)],
        "rid long, core string, poi string, pois string, district string"
    )
    got = {r.rid: (r.level, r.target_rid) for r in match.cascade(src, tgt).collect()}
    assert got == {1: ("EXACT", 1), 2: ("NEED_REVIEW", 2), 3: ("EXACT", 4), 4: ("UNMATCHED", None)}
    stats = match.statistics(match.cascade(src, tgt)).first()
    assert stats.total == 4 == stats.exact + stats.high_confidence + stats.need_review + stats.unmatched


def test_joins_cover_the_left_side(spark):
    a = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id long, k long")
    b = spark.createDataFrame([(7, 5), (8, None)], "id long, k long")
    inner, anti = join.inner(a, b, "k", "k"), join.left_anti(a, b, "k", "k")
    assert inner.columns == ["[A]id", "【关联A】k", "[B]id"] and inner.count() == 2
    assert sorted(r.id for r in anti.collect()) == [2, 3]
    with pytest.raises(KeyError):
        join.predicate([("AND", "k", "; DROP", 1)])


def test_clean_rejects_all_without_fields(spark):
    df = spark.createDataFrame([(1, "文三路")], "rid long, street string")
    assert clean.judged(df, [], "s", False).first().reason == "全空行"
    assert clean.active_fields(df.withColumn("n", F.lit("1")), ["street", "n"]) == ["street"]


def test_region_extract(spark):
    areas = spark.createDataFrame(
        [("1", "安次区", "c"), ("2", "大厂回族自治县", "c")], "code string, name string, cityCode string"
    )
    rows = spark.createDataFrame([(1, "河北省廊坊市安次区银河路"), (2, "大厂回族自治县"), (3, None)], "rid long, address string")
    assert {r.rid: r.area for r in region.extract_area(rows, areas).collect()} == {1: "安次区", 2: "大厂回族自治县", 3: ""}


def test_distance(spark):
    v = one(spark, geo.distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert abs(v - 110574.3886) < 0.001
    assert one(spark, geo.distance(F.lit(1000.0), F.lit(0.0), F.lit(1003.0), F.lit(4.0))) == 5
    assert one(spark, geo.distance(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0))) is None
    x, y = geo.to_mercator(F.lit(10.0), F.lit(50.0))
    back = geo.from_mercator(x, y)
    assert abs(one(spark, back[0]) - 10) < 1e-9 and abs(one(spark, back[1]) - 50) < 1e-9


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("名称,b\n阳光花园,1\n".encode("gbk"))
    assert readers.encoding_of(spark, str(tmp_path / "a.csv")) == "gbk"
    assert [tuple(r) for r in readers.auto(spark, str(tmp_path / "a.csv")).collect()] == [("阳光花园", "1")]
    (tmp_path / "u.csv").write_bytes("﻿名称,b\n园,2\n".encode())
    assert readers.columns(spark, str(tmp_path / "u.csv")) == ["名称", "b"]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>名称</t></si><si><t>园</t></si></sst>")
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>2.5</v></c></row></sheetData></worksheet>'
        )
    assert readers.workbook_rows((tmp_path / "w.xlsx").read_bytes()) == [["名称", None, "n"], ["园", None, "2.5"]]
    record = struct.pack("<i2d", 1, 3.5, -2.0)
    shp = bytes(100) + struct.pack(">2i", 1, len(record) // 2) + record
    (tmp_path / "p.shp").write_bytes(shp)
    field = b"gid".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5]) + bytes(15)
    (tmp_path / "p.dbf").write_bytes(
        bytes([3, 0, 0, 0]) + struct.pack("<IHH", 1, 32 + 32 + 1, 6) + bytes(20) + field + b"\x0d" + b" 12   "
    )
    assert [
        tuple(r) for r in readers.auto(spark, str(tmp_path / "p.shp")).collect()
    ] == [("12", "POINT (3.5 -2)", None)]
    assert sinks.dbf_names(["a" * 12, "a" * 11, "b"]) == ["a" * 10, "a" * 9 + "1", "b"]
    assert sinks.free_name("x.csv", {"x.csv", "x_1.csv"}) == "x_2.csv"


def test_usage_and_types(spark):
    names = profile.names_frame(spark, ["width", "省份"])
    assert {r.name: r.category for r in profile.field_types(names).collect()} == {"width": "id", "省份": "province"}


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a<&>b", 1, None), (" 园 ", 2, "x")], "`名 称` string, n int, z string")
    (tmp_path / "r.xlsx").write_bytes(sinks.workbook_bytes(df, "表"))
    assert [
        tuple(r) for r in readers.auto(spark, str(tmp_path / "r.xlsx")).collect()
    ] == [("a<&>b", "1", None), (" 园 ", "2", "x")]
    assert readers.auto(spark, str(tmp_path / "r.xlsx")).columns == df.columns


def test_workbook_blank_header(spark, tmp_path):
    df = spark.createDataFrame([("1", "2", "3")], "a string, b string, c string")
    data = sinks.workbook_bytes(df)
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as out, zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            out.writestr(name, z.read(name).replace(b">b</t>", b"></t>"))
    assert [r.asDict() for r in readers.auto(spark, str(tmp_path / "b.xlsx")).collect()] == [{"a": "1", "c": "3"}]


def test_point_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("甲", 1.5, -2.0), (None, 3.0, 4.25)], "name string, x double, y double")
    layers.write_points(df, str(tmp_path / "p"), "x", "y")
    assert sorted((tuple(r) for r in readers.read_shapefile(spark, str(tmp_path / "p")).collect()), key=str) == sorted(
        [("甲", "POINT (1.5 -2)", None), (None, "POINT (3 4.25)", None)], key=str
    )


def test_right_sides_of_any_size(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows}
    df = spark.createDataFrame(rows + [(900, None), (901, [1.0])], "rid long, v array<double>").repartition(3)
    left, right = df.where("rid % 2 = 0"), df.where("rid % 2 = 1 and rid < 900")
    want = {
        i: min((-round(sum(x * y for x, y in zip(unit[i], unit[j])), 6), j) for j in unit if j % 2) for i in unit
        if i % 2 == 0
    }
    want = {(i, j, -s) for i, (s, j) in want.items()} | {(900, 1, None)}
    for sizes in ((4096, 4096, 16_384), (4096, 40, 30), (16, 40, 7)):
        found = nearest.search(left, right, *sizes).collect()
        assert {(x.rid, x.target_rid, x.similarity) for x in found} == want
        assert len(found) == len(want) and {x.cells for x in found if x.rid == 900} == {0}
    assert nearest.search(left, right.limit(0)).collect() == []


def test_cells_that_cannot_win_are_not_visited(spark):
    r = np.random.default_rng(5)
    around = r.normal(size=(12, 16))
    of = lambda n, spread: [around[i % 12] + spread * r.normal(size=16) for i in range(n)]
    right = of(600, 0.05) + [around[0] * 0, np.full(16, np.nan)][:1]
    left = of(150, 0.05) + [around[3] + 0.01] * 40
    a, b = (
        spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "rid long, v array<double>").repartition(3)
        for rows in (left, right)
    )
    unit = lambda rows: np.array([v / (np.linalg.norm(v) or np.nan) for v in rows])
    sims = np.round(np.nan_to_num(unit(left) @ unit(right).T, nan=-2), 6)
    found = nearest.search(a, b, 50, 64, 64).collect()
    assert {(x.rid, x.target_rid, x.similarity) for x in found} == {
        (i, int(s.argmax()), float(s.max())) for i, s in enumerate(sims)
    }
    assert sum(x.cells for x in found) < 0.5 * 13 * len(found)
    # A vector that is not a number is like a similarity beyond all others, whatever its cell.
    odd = b.unionByName(spark.createDataFrame([(9999, [float("nan")] * 16)], b.schema))
    assert {x.target_rid for x in nearest.search(a, odd, 50).collect()} == {9999}


def _words(r, n, letters="甲乙丙丁戊己庚辛"):
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(n)]


def test_blocked_pairs_lose_none(spark):
    r = random.Random(4)
    left = _words(r, 70) + ["阳光花园", "阳光花园小区北门", "aab", ""]
    right = _words(r, 70) + [w + "旁" for w in left[:30]] + ["花园", "ab", " "]
    a, b = (spark.createDataFrame([(w,) for w in ws], f"{n} string") for ws, n in ((left, "a"), (right, "b")))
    pairs = {(x, y) for x in left if x for y in right if y}
    got = {(x.a, x.b): x.score for x in similarity.partial_candidates(a, b, 75.0).collect()}
    assert got == {p: s for p in pairs if (s := similarity.partial(*p)) >= 75}
    got = {(x.a, x.b): x.score for x in similarity.difflib_candidates(a, b, 0.7).collect()}
    assert got == {p: s for p in pairs if (s := similarity.difflib_score(*p)) >= 0.7}


def test_fuzzy_and_poi_match_against_every_pair(spark):
    r = random.Random(6)
    left = [(i, w) for i, w in enumerate(_words(r, 40) + ["", " ", "123", "3号调压站", "#12", "阳光花园;别的"])]
    right = [(i, w) for i, w in enumerate(_words(r, 60) + ["阳光花园12", "某某市", "", "12"])]
    a, b = (spark.createDataFrame(x, "rid long, poi string") for x in (left, right))
    got = {
        x.lid: (x.rid, x.confidence) for x in join.fuzzy(a.withColumnRenamed("rid", "lid"), b, "poi", "poi").collect()
    }
    want = {}
    for i, x in left:
        found = [(similarity.difflib_score(x.strip(), y.strip()), -j) for j, y in right if x.strip() and y.strip()]
        if found and max(found)[0] >= 0.7:
            want[i] = (-max(found)[1], max(found)[0])
    assert got == want
    got = {x.rid: (x.kind, x.target_rid, x.score) for x in match.poi_match(a, b, "poi", "poi").collect()}
    clean = {j: "".join(c for c in y if not c.isdigit() and c not in "#-") or y for j, y in right if y and y != "某某市"}
    for i, x in left:
        first = x.split(";")[0].strip()
        kind = "empty_left" if not first else "non_poi_left" if first.isdigit() or "调压" in first else "no_poi_left" if first == "#12" else None
        if kind:
            assert got[i] == (kind, None, 0.0)
            continue
        score, j = max((similarity.partial(first, y), -j) for j, y in clean.items())
        assert got[i] == (
            ("fuzzy_strong_poi" if score >= 90 else "fuzzy_weak_poi", -j, score) if score >= 75
            else ("unmatched", None, 0.0)
        )
    none = match.poi_match(a, b.limit(0), "poi", "poi").collect()
    assert {x.kind for x in none} == {"empty_left", "non_poi_left", "no_poi_left", "no_poi_right"}


def test_semantic_tier(spark):
    kind = "rid long, core string, poi string, pois string, district string, v array<double>"
    source = spark.createDataFrame([
        (1, "", "甲乙丙丁戊", "", "D", [1.0, 0.0, 0.0]),  # equal meaning, four letters in common
        (2, "", "天地玄黄宇", "", "D", [0.0, 1.0, 0.0]),  # equal meaning, nothing in common
        (3, "", "甲乙丙丁戊己庚辛壬癸", "", "D", [0.0, 0.0, 1.0]),  # a ratio of 95, district of the target
        (4, "", "红橙黄绿紫", "", None, [0.96, 0.0, 0.28]),  # two letters of five in common
        (5, "", "无向量的", "", "D", None),
    ], kind)
    target = spark.createDataFrame([
        (1, "", "甲乙丙丁己", "", "D", [2.0, 0.0, 0.0]),
        (2, "", "日月盈昃辰", "", "D", [0.0, 1.0, 0.0]),
        (3, "", "甲乙丙丁戊己庚辛壬癸子", "", "D", None),
        (4, "", "红橙青蓝白", "", None, [0.96, 0.0, 0.28]),
    ], kind)
    got = {x.rid: (x.target_rid, x.level, x.match_type, x.score) for x in match.cascade(source, target).collect()}
    assert got[1] == (1, "HIGH_CONFIDENCE", "semantic_strong", 100.0)
    assert got[2][1:] == ("UNMATCHED", "unmatched", 0.0) and got[5][1:] == ("UNMATCHED", "unmatched", 0.0)
    assert got[3][:3] == (3, "HIGH_CONFIDENCE", "district_fuzzy_95")
    assert got[4] == (4, "NEED_REVIEW", "semantic_strong", 92.0)
    pois = {
        x.rid: (x.kind, x.target_rid, x.score)
        for x in match.poi_match(source.where("rid in (1, 2, 5)"), target, "poi", "poi").collect()
    }
    assert pois == {
        1: ("fuzzy_strong_poi", 3, 100.0), 2: ("semantic_strong_poi", 2, 100.0), 5: ("unmatched", None, 0.0)
    }
    weak = source.where("rid = 2").withColumn("v", F.array(F.lit(0.6), F.lit(0.78), F.lit(0.0)))
    assert match.poi_match(weak, target, "poi", "poi").first().kind == "semantic_weak_poi"
    assert len(match.poi_report(source, target, "a", "b", "poi").columns) == 19


def test_layers_are_written(spark, tmp_path):
    kind = "rid long, core string, poi string, pois string, district string"
    source = spark.createDataFrame([(0, "k", "甲", "x", None), (1, "", "乙", "", None)], kind)
    target = spark.createDataFrame([(0, "k", "丙", "", None)], kind)
    result = match.waterfall(source, [target])
    paths = sinks.write_layers(result, str(tmp_path), source, "客户 表_标准化.csv", [("目标.csv", target)])
    assert {k: p.rpartition("/")[2] for k, p in paths.items()} == {"EXACT": "客户_表_精确匹配_1条", "UNMATCHED": "客户_表_未匹配_1条"}
    row = readers.read_csv(spark, paths["EXACT"]).first().asDict()
    assert row["[源:客户 表]core"] == row[
        "【匹配目标:目标】core"
    ] == "k" and row["匹配类型"] == "core_field_exact" and row["目标表文件"] == "目标.csv" and row["目标表行号"] == "1"
    assert readers.read_csv(spark, paths["UNMATCHED"]).first()["匹配层级"] == "未匹配"
    book = sinks.coloured_bytes(sinks.layered(result, "EXACT", source, "a.csv", [("b.csv", target)]), "a.csv")
    assert dict(readers.header_colours(book))["匹配分数"] == sinks.COLOURS["match"][0]
    assert readers.workbook_rows(book, "图例说明")[0] == ["颜色", "说明"]
    assert sinks.export(
        target, str(tmp_path / "e"), ["rid"]
    ).endswith(".xlsx") and readers.auto(spark, str(tmp_path / "e.xlsx")).columns == ["rid"]


def test_enrichment(spark):
    rows = spark.createDataFrame([(1, " a "), (2, "b"), (3, ""), (4, None), (5, "c")], "rid long, addr string")
    structures = spark.createDataFrame([("a", {"city": "杭州市", "poi": "园"})], enrich.STRUCTURES)
    pois = spark.createDataFrame([], enrich.POIS)
    asked = []

    def service(texts):
        asked.append(sorted(x.text for x in texts.collect()))
        return spark.createDataFrame([("b", {"city": "苏州市"}), ("c", {})], enrich.STRUCTURES)

    out, new, found = enrich.standardise(
        rows, "addr", structures, pois, service, lambda d: d.withColumn("poi", F.when(F.col("std") == "苏州市", ""))
    )
    got = {x.rid: x for x in out.collect()}
    assert asked == [["b", "c"]] and [x.text for x in new.collect()] == ["b"] and [
        tuple(x) for x in found.collect()
    ] == [("苏州市", "")]
    assert (
        got[1]["标准化地址"], got[1]["标准化POI抽取"], got[1]["POI来源"], got[1].structure_cached
    ) == ("杭州市园", "园", "structure", True)
    assert (
        got[2]["市"], got[2]["POI来源"], got[2].cached
    ) == ("苏州市", "empty", False) and got[3]["标准化地址"] == got[4]["市"] == got[5]["省"] == ""
    assert enrich.hits(out).first().asDict() == {"total": 5, "hits": 1}
    nothing, _, _ = enrich.standardise(rows, "addr", structures, pois)
    assert {x.rid for x in nothing.where("`标准化地址` <> ''").collect()} == {1}


def test_national_encodings(spark, tmp_path):
    (tmp_path / "g").mkdir()
    for i, text in enumerate(("名称,b\n\"两\n行\",1\n名称,b\n", "名称,b\n园,2\n")):
        (tmp_path / "g" / f"{i}.csv").write_bytes(text.encode("gbk"))
    assert sorted(
        tuple(x) for x in readers.read_csv(spark, str(tmp_path / "g")).collect()
    ) == [("两\n行", "1"), ("名称", "b"), ("园", "2")]
    (tmp_path / "late.csv").write_bytes(b"a,b\n" + b"x,1\n" * 400_000 + "阳光,2\n".encode("gbk"))
    assert readers.encoding_of(spark, str(tmp_path / "late.csv")) == "gbk"
    assert readers.encoding_of(spark, str(tmp_path / "late.csv"), ("utf-8",)) == "utf-8"
    (tmp_path / "empty.csv").write_bytes(b"")
    assert readers.encoding_of(spark, str(tmp_path / "empty.csv")) == "utf-8"


def test_point_files_of_long_names(spark, tmp_path):
    df = spark.createDataFrame(
        [("园" * 100, "7", "1.5", 1.0, 2.0), (None, "12", "", 3.0, 4.0)],
        "`标准化地址` string, `标准化地区` string, n string, x double, y double"
    )
    layers.write_points(df, str(tmp_path / "p"), "x", "y")
    got = readers.read_shapefile(spark, str(tmp_path / "p"))
    assert got.columns == ["标准化", "标准化1", "n", "geometry", "crs"]
    assert sorted(
        map(tuple, got.select("标准化", "标准化1", "n").collect()), key=str
    ) == sorted([("园" * 84, "7", "1.5"), (None, "12", None)], key=str)
    assert layers.dbf_fields(next((tmp_path / "p").glob("*.dbf")).read_bytes())[1][1] == "N"
    assert [sinks.dbf_type(v) for v in (["1", ""], ["1.5", "2"], ["x"], [], [""])] == ["N", "F", "C", "C", "N"]


def test_blank_values_are_no_key(spark):
    rows = spark.createDataFrame([(1, "", " ", None), (2, None, "P", "")], "rid long, gid string, v1 string, v2 string")
    db = spark.createDataFrame(
        [("", "", 1.0, 2.0), ("9", " p", 1.0, 2.0)], "code string, name string, x double, y double"
    )
    shapes = spark.createDataFrame([], "seq long, gid string, x double, y double")
    from addrloom.operators import validate

    found = validate.resolve(rows, db, shapes, ["v1", "v2"])
    assert {x.rid: (x.db_by, x.db_n) for x in found.collect()} == {1: (None, 0), 2: ("v1", 1)}
    assert validate.report(validate.problems(found, ["v1", "v2"])).columns == [
        "目标表GID", "数据库code", "源表匹配值", "状态", "偏差距离", "原始坐标", "数据库坐标", "问题类型"
    ]
    lines = [
        x.text
        for x in validate.text_report(
            rows.agg(F.count("*").alias("n")), found, ["v1", "v2"], most=0
        ).orderBy("line").collect()
    ]
    assert lines[5] == "原始客户数据总数: 2" and lines[9:11] == [
        "匹配结果在数据库中存在: 1", "匹配结果在数据库中缺失: 1"
    ] and lines[-1] == "... 还有 1 条问题数据未显示"
