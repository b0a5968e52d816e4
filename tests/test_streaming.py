from pyspark.sql import functions as F

from calibrant.streaming import logs


def test_streams(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "k int, v string, at int"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    logs.stream_latest(stream, out, f"file://{tmp_path}/cp", ["k"], "at", "v").awaitTermination()
    spark.createDataFrame([(2, "d", 5), (1, "old", 0)], schema).write.mode("append").parquet(src)
    logs.stream_latest(spark.readStream.schema(schema).parquet(src), out, f"file://{tmp_path}/cp", ["k"], "at", "v").awaitTermination()
    assert {(r.k, r.v) for r in logs.current(spark, out, 1).collect()} == {(1, "b"), (2, "d")}
    logs.stream_quarantine(spark.readStream.schema(schema).parquet(src), f"{out}-q", f"file://{tmp_path}/cq", (F.col("at") < 1, "too_old", F.col("at"))).awaitTermination()
    assert {(r.v, r.reason, r.detail, r.fate) for r in spark.read.parquet(f"{out}-q").where("fate = 'quarantined'").collect()} == {("old", "too_old", "0", "quarantined")}
    assert spark.read.parquet(f"{out}-q").count() == 5
