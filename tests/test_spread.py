"""Work by the row and by the pair is dealt to all tasks, whatever files and keys the rows come with."""

from addrloom.operators import clean
from addrloom.plans.fixtures import frame


def test_rows_of_one_file_go_to_all_tasks(spark, tmp_path):
    rows = spark.range(500).selectExpr("id as c_custkey", "'n' as c_name", "cast(id % 25 as int) as c_nationkey")
    for table in ("customer", "part"):  # the frame's SQL has both words
        rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    assert spark.read.parquet(f"{tmp_path}/customer.parquet").rdd.getNumPartitions() == 1
    found = frame(spark, str(tmp_path), "addr")
    assert found.rdd.getNumPartitions() == 4 and found.select("rid").distinct().count() == 500


def test_text_without_noise_is_kept_and_space_goes_as_before(spark):
    texts = ["文三路", " \t文三路\x0b\r\n", "高压A站", "无3号 无无", "nan", "_ab_A", "中山路", "暂无", "", None]
    got = [r.c for r in clean.judged(spark.createDataFrame([(x,) for x in texts], "street string"), ["street"], "a", False).select("a_adr_clean").toDF("c").collect()]
    assert got == ["文三路", "文三路", "A站", "3号", "", "", "中山路", "", "", ""]
