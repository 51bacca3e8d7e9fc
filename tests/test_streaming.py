from pyspark.sql import functions as F

from plumbline.streaming.quality import quality_windows


def test_stream_and_table_agree(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 7}:00:00", None if i % 5 == 0 else i) for i in range(60)]
    df = spark.createDataFrame(rows, "t string, v int").select(F.col("t").cast("timestamp").alias("t"), "v")
    path = f"{tmp_path}/in"
    df.coalesce(1).write.parquet(path)
    rules = {"missing": F.col("v").isNotNull(), "large": F.col("v") < 50}
    want = sorted(map(tuple, quality_windows(df, "t", rules).collect()))
    stream = quality_windows(spark.readStream.schema(df.schema).parquet(path), "t", rules, late="10 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("quality").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("quality").collect())) == want and sum(r[1] for r in want) == 60
    finally:
        q.stop()
