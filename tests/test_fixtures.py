from folioscan.plans import fixtures as X

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_regions_are_those_of_the_sql(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").limit(2500)
    orders.createOrReplaceTempView("some_orders")
    wanted = spark.sql(X.regions_sql("spark"), orders=orders)
    found = spark.sql(X.spark_regions_sql(), orders=orders)
    assert found.dtypes == wanted.dtypes
    assert rows(found) == rows(wanted)


def test_regions_are_made_by_compiled_methods(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = X.regions(spark, SF)._jdf.queryExecution().debug().codegenToSeq()
        assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
