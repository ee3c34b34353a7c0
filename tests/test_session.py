import os

from pyspark.sql import functions as F

from portolan import session as S


def test_materialize_cuts_lineage_and_is_discarded(spark):
    df = S.materialize(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    path = df._portolan_path
    assert path.startswith(S.shared_dir(spark)) and [r["x"] for r in df.orderBy("id").collect()] == [0, 2, 4, 6, 8]
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()
    S.discard(df)
    assert not os.path.exists(path.removeprefix("file://"))
    S.discard(spark.range(1))  # nothing of ours: nothing happens


def test_spread_deals_out_small_tables_only(spark):
    cores = spark.sparkContext.defaultParallelism
    one = S.spread(spark.range(100).coalesce(1))
    assert one.rdd.getNumPartitions() == cores and one.count() == 100
    many = spark.range(0, 100, 1, cores)
    assert S.spread(many) is many


def test_private_names(spark):
    df = spark.range(1).withColumn("__X", F.lit(1)).withColumn("__x_", F.lit(1))
    assert S.private_name(df, "__x") == "__x__" and S.private_name(df, "y") == "y"


def test_empty_tables_can_be_materialized(spark):
    df = S.materialize(spark.range(0).withColumn("a", F.array(F.lit("x"))), "t")
    assert df.count() == 0 and df.dtypes == [("id", "bigint"), ("a", "array<string>")]


def test_arrow_batches_are_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with S.arrow_batches(spark, 7):
        assert spark.conf.get(key) == "7"
        sizes = spark.range(0, 20, 1, 1).mapInPandas(lambda it: (b.head(1).assign(id=len(b)) for b in it), "id long").collect()
        assert [r["id"] for r in sizes] == [7, 7, 6]
    assert spark.conf.get(key) == before
