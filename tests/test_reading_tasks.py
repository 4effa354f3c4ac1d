"""Many small ranges of layers are read by a bounded number of tasks; different addresses are answered by all tasks."""

from addrloom.operators import enrich
from addrloom.sources import layers, readers


def test_ranges_of_records_share_tasks(spark, tmp_path):
    rows = spark.range(1300).selectExpr("id", "concat('POINT (', id, ' 0)') as geometry")
    layers.write(rows, str(tmp_path), records=100)
    found = readers.read_shapefile(spark, str(tmp_path), 2)
    assert found.rdd.getNumPartitions() == layers.READERS
    assert sorted(int(r.id) for r in found.collect()) == list(range(1300))


def test_different_addresses_are_answered_by_all_tasks(spark):
    asked = []

    def structure_of(texts):
        asked.append(texts.rdd.getNumPartitions())
        return texts.selectExpr("text", "map('city', text) as structure")

    rows = spark.range(40).selectExpr("concat('t', id % 8) as address")
    none = spark.createDataFrame([], enrich.STRUCTURES), spark.createDataFrame([], enrich.POIS)
    found = enrich.standardise(rows, "address", *none, structure_of)[0]
    assert asked == [4] and found.where("`市` = address").count() == 40
