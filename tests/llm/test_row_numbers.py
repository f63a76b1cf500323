from wirescore.llm import suffix_dedup


def test_row_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"text {i}") for i in range(80)], "doc_id bigint, text string").repartition(8).write.parquet(path)
    rows = suffix_dedup.numbered(spark.read.parquet(path))
    seen = []
    try:
        for open_cost in ("1", "134217728"):
            spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
            spark.conf.set("spark.sql.files.minPartitionNum", "1")
            seen.append(sorted(map(tuple, rows.select("rid", "doc_id").collect())))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert seen[0] == seen[1] and len({rid for rid, _ in seen[0]}) == 80
