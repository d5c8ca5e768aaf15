from tessera.streaming import ingest


def test_incremental_ingestion(spark, tmp_path):
    inbox, manifest, chunks = tmp_path / "in", str(tmp_path / "manifest"), str(tmp_path / "chunks")

    def drop(rows, name):
        spark.createDataFrame(rows, "source_path string, text string").coalesce(1).write.mode("append").parquet(str(inbox))

    def run():
        stream = spark.readStream.schema("source_path string, text string").parquet(str(inbox))
        ingest.ingest_stream(spark, stream, "acme", manifest, chunks, str(tmp_path / "ck")).awaitTermination()
        return {r["source_path"]: r["text"] for r in ingest.current_chunks(spark, manifest, chunks).collect()}

    body = lambda word: f"{word} " * 30
    drop([("a", body("one")), ("b", body("two"))], "1")
    assert set(run()) == {"a", "b"}
    drop([("a", body("one")), ("b", body("changed"))], "2")
    got = run()
    assert got["b"].startswith("changed") and got["a"].startswith("one")
    assert spark.read.json(manifest).count() == 3


def test_cache_stream(spark, tmp_path):
    rows = [("k", 0, 1), ("k", 5, 2), ("k", 10, 3), ("j", 5, 4)]
    spark.createDataFrame(rows, "key string, ts_ms long, request_id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts_ms long, request_id long").parquet(str(tmp_path / "in"))
    q = ingest.cache_stream(stream, 10).writeStream.format("memory").queryName("cached").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["request_id"]: r["hit"] for r in spark.table("cached").collect()} == {1: False, 2: True, 3: False, 4: False}
