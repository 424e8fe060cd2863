"""Streams give what batches give."""

from lectern.streaming.ingest import latest_versions, publish_batches, windowed_counts


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 {h:02d}:{m:02d}:00", f"v{k}{h}") for k in range(3) for h in range(4) for m in (5, 50)]
    df = spark.createDataFrame(rows, "key int, at string, v string").selectExpr("key", "cast(at as timestamp) at", "v")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = latest_versions(stream, "key", "at", "v").writeStream.format("memory").queryName("latest").outputMode("complete").start()
    w = windowed_counts(stream, "at", "key").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    p = publish_batches(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).start()
    for s in (q, w, p):
        s.processAllAvailable()
        s.stop()
    assert sorted(spark.table("latest").collect()) == sorted(latest_versions(df, "key", "at", "v").collect())
    assert sorted(spark.table("counts").collect()) == sorted(windowed_counts(df, "at", "key").collect())
    assert sorted(r.key for r in latest_versions(spark.read.parquet(str(tmp_path / "out")), "key", "at", "v").collect()) == [0, 1, 2]
