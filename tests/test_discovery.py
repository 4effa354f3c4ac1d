from addrloom.sources import discovery, layers, sinks


def test_layers_of_folders_and_databases(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = spark.createDataFrame([("1", "甲", 1.0, 2.0), ("2", "乙", 3.0, 4.0)], "CODE string, NAME string, x double, y double")
    sinks.write_csv(rows.select("x"), f"{base}/a/0.csv")
    rows.select("CODE").write.parquet(f"{base}/a/1")
    layers.write_points(rows, f"{base}/a/2_points", "x", "y")
    rows.write.parquet(f"{base}/b/first")
    (tmp_path / "a" / "notes.md").write_text("x")
    (tmp_path / "a" / "broken.shp").write_bytes(b"")
    found = list(discovery.in_folders(spark, [f"{base}/gone", f"{base}/a", f"{base}/b"]))
    assert [layer.name for layer in found] == ["0.csv", "1", "2_points", "broken.shp", "first"]
    point = discovery.point_layer(spark, [f"{base}/a", f"{base}/b"])
    assert point.name == "2_points" and sorted(r.NAME for r in point.open().collect()) == ["乙", "甲"]
    url = "jdbc:derby:memory:layers;create=true"
    rows.withColumn("id", rows.CODE.cast("int")).write.format("jdbc").options(url=url, dbtable="points").save()
    point = discovery.point_layer(spark, [f"{base}/a"], [("jdbc:none:x", ["points"]), (url, ["absent", "points"])])
    assert point.place == url and point.open().count() == 2
    split = next(discovery.in_database(spark, url, ["points"], ('"id"', 1, 3, 2)))
    assert split.open().rdd.getNumPartitions() == 2 and split.open().count() == 2
    assert discovery.point_layer(spark, [f"{base}/gone"]) is None
