from tessera.streaming.feed import classify_stream


def test_feed(spark, tmp_path):
    schema = "path string, version bigint, content string"
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        feed = classify_stream(spark.readStream.schema(schema).parquet(source))
        feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    arrive([("a", 1, "x"), ("b", 1, "y"), ("a", 2, "x")])
    arrive([("a", 3, "z"), ("b", 1, "late"), ("c", 5, "w")])
    got = {tuple(r)[:3] for r in spark.read.parquet(out).collect()}
    assert got == {("a", 1, "new"), ("a", 2, "identical"), ("b", 1, "new"), ("a", 3, "modified"), ("c", 5, "new")}
