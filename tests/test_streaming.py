"""The scan as a stream: restarts, merging and sessions."""

from pyspark.sql import functions as F

from cairnlake.streaming import ingest as Y


def test_files_are_merged_once_and_updated(spark, tmp_path):
    folder, table, mark = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "mark")
    folder.mkdir()
    (folder / "a.JPG").write_bytes(b"12345")
    (folder / "b.pdf").write_bytes(b"1")
    run = lambda: Y.merge_into(Y.discovered(spark, str(folder)), table, mark, "path", ["kind"]).awaitTermination()
    run()
    assert {(r.kind, r.size_bytes) for r in Y.current(spark, table).collect()} == {("image", 5), ("pdf", 1)}
    (folder / "sub").mkdir()
    (folder / "sub/c.mp3").write_bytes(b"123")
    run()
    run()
    assert sorted(r.kind for r in Y.current(spark, table).collect()) == ["audio", "image", "pdf"]


def test_sessions_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id")
    events.write.parquet(str(tmp_path / "events"))
    stream = Y.sessions(Y.events(spark, str(tmp_path / "events"), events.schema), "user_id", "ts", "30 minutes")
    query = stream.writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = events.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    assert sorted(map(tuple, spark.table("sess").collect())) == sorted(map(tuple, batch.collect()))


def test_first_owner_of_equal_content(spark, tmp_path):
    rows = spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 00:01:00"), ("y", "2024-01-01 00:02:00")], "content_hash string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "r"))
    q = Y.first_owners(Y.events(spark, str(tmp_path / "r"), rows.schema)).writeStream.format("memory").queryName("own").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.content_hash for r in spark.table("own").collect()) == ["x", "y"]


def test_change_log(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "id long, v string")
    log = Y.change_log(old, new, "id", 7)
    assert {(r.id, r.change) for r in log.collect()} == {(2, "changed"), (3, "removed"), (4, "added")}
    assert Y.trimmed_log(log.union(log.withColumn("generation", F.lit(8).cast("long"))), 4).count() == 3
