import random

from addrloom.operators import gazetteer, region


def test_places_by_both_ways(spark):
    r = random.Random(1)
    names = sorted({"".join(r.choice("甲乙丙") for _ in range(r.randint(1, 4))) for _ in range(12)})
    texts = [(i, "".join(r.choice("甲乙丙丁") for _ in range(r.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "")]
    rows = spark.createDataFrame(texts, "rid long, text string").repartition(3)
    known = spark.createDataFrame([(n,) for n in names + [None, "", names[0]]], "name string")
    want = sorted(
        (i, n, at) for i, t in texts if t for n in names for at in range(len(t)) if t.startswith(n, at)
    )
    for most in (100, 3):
        got = sorted((x.rid, x.name, x["at"]) for x in gazetteer.places(rows, known, most).collect())
        assert got == want
    assert gazetteer.places(rows, known.limit(0)).collect() == []


def _dims(spark):
    make = spark.createDataFrame
    return (
        make([("13", "河北省"), ("33", "浙江省")], "code string, name string"),
        make([("1310", "廊坊市", "13"), ("3301", "杭州市", "33")], "code string, name string, provinceCode string"),
        make([("131002", "安次区", "1310"), ("330106", "西湖区", "3301"), ("990001", "西湖区", "1310")], "code string, name string, cityCode string"),
        make([
            ("131002001", "银河路街道", "131002"), ("330106001", "古荡镇", "330106"), ("330106002", "文新街道办事处", "330106"),
            ("990001001", "无主乡", "000000")
        ], "code string, name string, areaCode string"),
    )


def test_streets_in_addresses(spark):
    rows = spark.createDataFrame([
        (1, "廊坊市安次区银河路街道1号"), (2, "古荡镇村口古荡镇"), (3, "古荡镇村"), (4, "银河路镇旁"), (5, "文新街道"), (6, None), (7, ""),
        (8, "古荡镇与文新街道办事处"), (9, "西湖区域内")
    ], "rid long, address string")
    got = {x.rid: x.street for x in region.extract_street(rows, _dims(spark)[3]).collect()}
    assert got == {
        1: "银河路街道", 2: "古荡镇", 3: "", 4: "银河路镇", 5: "文新街道", 6: "", 7: "", 8: "文新街道办事处", 9: ""
    }
    areas = {x.rid: x.area for x in region.extract_area(rows, _dims(spark)[2]).collect()}
    assert areas[1] == "安次区" and areas[9] == ""


def test_completion_by_area_street_and_city(spark):
    rows = spark.createDataFrame([
        (1, "安次区银河路街道", "", "", "", ""), (2, "古荡镇", "", "", "", ""), (3, "x", "", "廊坊", "", ""),
        (4, "x", "浙江省", "杭州市", "西湖区", "古荡镇"), (5, None, None, None, "西湖县", None), (6, "无主乡", "", "", "", ""),
        (7, "x", "", "", "", "无此街道")
    ], "rid long, address string, province string, city string, area string, street string")
    got = {x.rid: tuple(x)[1:] for x in region.complete(rows, *_dims(spark)).collect()}
    assert got == {
        1: ("河北省", "廊坊市", "安次区", "银河路街道", 0.9, "area_lookup"),
        2: ("浙江省", "杭州市", "西湖区", "古荡镇", 0.85, "street_lookup"),
        3: ("河北省", "廊坊", "", "", 0.95, "city_lookup"),
        4: ("浙江省", "杭州市", "西湖区", "古荡镇", 0.0, "none"),
        5: ("浙江省", "杭州市", "西湖县", "", 0.9, "area_lookup"),
        6: ("", "", "", "无主乡", 0.85, "street_lookup"),
        7: ("", "", "", "无此街道", 0.0, "none"),
    }
