from quillstack.llm import _tables as tables


def test_written_tables_are_read_back_dropped_and_released(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    one, two = tables.written(df, "one"), tables.written(df, "two")
    assert one.count() == two.count() == 10 and one.dtypes == df.dtypes
    assert tables.written(df.where("x < 0"), "none").count() == 0
    tables.drop_written(one)
    assert two.count() == 10
    folder = tables._top(spark)
    tables.release(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_clashing_columns_go_whatever_their_case(spark):
    df = spark.range(1).selectExpr("id AS a", "id AS B", "id AS c")
    assert tables.fresh(df, "b", "C").columns == ["a"]
