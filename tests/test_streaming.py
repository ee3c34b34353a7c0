import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.streaming import incremental as inc

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.TimestampType()), T.StructField("v", T.StringType())])


def at(minute):
    return dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=minute)


def test_append_and_upsert_streams(spark, tmp_path):
    src, out, up = (str(tmp_path / n) for n in ("src", "out", "up"))
    for batch in ([(1, at(0), "a"), (2, at(1), "b")], [(2, at(5), "B"), (3, at(2), "c")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        inc.append_stream(inc.read_files(spark, src, SCHEMA), out, ["k"], str(tmp_path / "c1"), lambda df: df.withColumn("w", F.upper("v"))).awaitTermination()
        inc.upsert_stream(inc.read_files(spark, src, SCHEMA, per_trigger=1), up, ["k"], str(tmp_path / "c2"), "t").awaitTermination()
    assert sorted((r["k"], r["w"]) for r in spark.read.parquet(out).collect()) == [(1, "A"), (2, "B"), (3, "C")]
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(up).collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_older_rows_that_come_late_replace_nothing(spark, tmp_path):
    src, up = str(tmp_path / "src"), str(tmp_path / "up")
    for batch in ([(1, at(0), "new"), (None, at(0), "none")], [(1, at(-300), "old"), (None, at(5), "later")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        inc.upsert_stream(inc.read_files(spark, src, SCHEMA), up, ["k"], str(tmp_path / "c"), "t").awaitTermination()
    assert sorted((str(r["k"]), r["v"]) for r in spark.read.parquet(up).collect()) == [("1", "new"), ("None", "later")]


def test_windows_and_late_rows(spark, tmp_path):
    src = str(tmp_path / "s")
    for i, batch in enumerate([[(1, at(0), "x"), (2, at(10), "x"), (2, at(10), "x")], [(3, at(300), "x")], [(6, at(310), "x")], [(4, at(1), "late")], [(5, at(600), "x")]]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    import os
    import time

    for i, p in enumerate(sorted((f for f in os.listdir(src) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{src}/{f}"))):
        os.utime(f"{src}/{p}", (time.time() - 100 + i, time.time() - 100 + i))
    stream = inc.read_files(spark, src, SCHEMA, per_trigger=1)
    q = inc.windowed_counts(stream, "t", ["v"], delay="10 minutes").writeStream.format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cw")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert ("x", 3) in {(r["v"], r["n"]) for r in spark.table("w").collect()} and not spark.table("w").filter("v = 'late'").count()
    q = inc.dedup_within(stream, "t", ["k"]).writeStream.format("memory").queryName("d").option("checkpointLocation", str(tmp_path / "cd")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("d").filter("k = 2").count() == 1
