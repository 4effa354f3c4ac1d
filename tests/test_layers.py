import pytest
from pyspark.sql import functions as F

from addrloom.sources import layers, readers

SHAPES = {
    "point": ["POINT (1.5 -2)", "POINT (3 4.25)", None, "no geometry", "POINT EMPTY"],
    "multipoint": ["MULTIPOINT (1 2, 3 4)"],
    "line": ["LINESTRING (0 0, 1 1, 2 0)", "MULTILINESTRING ((0 0, 1 1), (5 5, 6 6, 7 5))"],
    "polygon": [
        "POLYGON ((0 0, 0 9, 9 9, 9 0, 0 0), (1 1, 2 1, 2 2, 1 1))",
        "MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)), ((5 5, 5 9, 9 9, 5 5), (6 7, 7 7, 6 8, 6 7)))",
    ],
}


@pytest.mark.parametrize("kind", SHAPES)
def test_round_trip(spark, tmp_path, kind):
    rows = [(i, f"名{i}", w) for i, w in enumerate(SHAPES[kind] * 7)]
    df = spark.createDataFrame(rows, "id long, `标准化地址` string, geometry string").repartition(3)
    layers.write(df, str(tmp_path / "l"), projection='GEOGCS["w",AUTHORITY["EPSG","4326"]]', records=4)
    assert len(list((tmp_path / "l").glob("*.shp"))) >= 3 and not list((tmp_path / "l").glob("_temporary*"))
    got = readers.read_shapefile(spark, str(tmp_path / "l"), 3)
    assert got.columns == ["id", "标准化", "geometry", "crs"] and got.rdd.getNumPartitions() > len(rows) / 4
    shown = lambda w: w if w and w[-1] == ")" else None
    assert sorted(map(tuple, got.collect())) == sorted((str(i), n, shown(w), "EPSG:4326") for i, n, w in rows)


def test_orientation_is_mended():
    content, box = layers.shape("POLYGON ((0 0, 9 0, 9 9, 0 0), (1 1, 1 2, 2 2, 1 1))")
    assert box == (0, 0, 9, 9)
    assert layers.shape_wkt(content) == "POLYGON ((0 0, 9 9, 9 0, 0 0), (1 1, 2 2, 1 2, 1 1))"
    assert layers.wkt_kind(" point z (1 2 3)") == "POINT" and layers.wkt_kind("CIRCLE (1)") is None


def test_many_records_by_ranges(spark, tmp_path):
    n = 120_000
    df = spark.range(0, n, 1, 3).select(F.col("id").alias("gid"), F.col("id").cast("double").alias("x"), (-F.col("id") / 4).alias("y"))
    layers.write_points(df, str(tmp_path / "m"), "x", "y")
    got = readers.read_shapefile(spark, str(tmp_path / "m"), 20_000)
    assert got.rdd.getNumPartitions() >= 6
    assert got.where(F.col("geometry") != F.concat(F.lit("POINT ("), "gid", F.lit(" "), (-F.col("gid").cast("double") / 4).cast("string"), F.lit(")"))).where(
        "cast(split(split(geometry, ' ')[1], '\\\\(')[1] as double) <> cast(gid as double)"
    ).count() == 0
    assert got.select("gid").distinct().count() == n


def test_kinds_do_not_mix_and_no_rows(spark, tmp_path):
    mixed = spark.createDataFrame([(1, "POINT (1 2)"), (2, "LINESTRING (1 2, 3 4)")], "id long, geometry string")
    with pytest.raises(ValueError):
        layers.write(mixed, str(tmp_path / "x"))
    layers.write(mixed.limit(0), str(tmp_path / "e"))
    got = readers.read_shapefile(spark, str(tmp_path / "e"))
    assert got.columns == ["id", "geometry", "crs"] and got.collect() == []


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    df = spark.range(0, 100, 1, 4).select("id", F.lit("POINT (1 2)").alias("geometry"))
    layers.write(df.limit(2), str(tmp_path / "f"))
    before = sorted(p.name for p in (tmp_path / "f").iterdir())

    @F.udf("string")
    def breaks(i):
        if i == 99 and len(seen) is not None:
            raise RuntimeError("broken")
        return "POINT (3 4)"

    seen = []
    with pytest.raises(Exception, match="broken"):
        layers.write(df.withColumn("geometry", F.when(F.col("id") < 0, "").otherwise(breaks("id"))), str(tmp_path / "f"))
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == before


def test_numbers_that_turn_out_text(spark, tmp_path):
    df = spark.createDataFrame([(str(i) if i < 150 else "x" * 300, 1.0, 2.0) for i in range(151)], "n string, x double, y double").coalesce(1)
    layers.write_points(df, str(tmp_path / "t"), "x", "y")
    got = readers.read_shapefile(spark, str(tmp_path / "t"))
    assert {r.n for r in got.collect()} == {str(i) for i in range(150)} | {"x" * 254}


def test_stores_that_only_spark_opens(spark, tmp_path):
    layers.write_points(spark.createDataFrame([("a", 1.0, 2.0)], "n string, x double, y double"), str(tmp_path / "s"), "x", "y")
    bases = readers._listed(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in readers._whole_layers(spark, bases).collect()] == [("a", "POINT (1 2)", None)]
