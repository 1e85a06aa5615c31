from sediment.streaming.high_water import STATE, archived, ingest_stream, windowed_counts

SF = "/root/testdata/sf0.001"


def test_ingest_is_incremental_and_idempotent(spark, tmp_path):
    source, archive, checkpoint = (str(tmp_path / x) for x in ("in", "archive", "checkpoint"))
    one = "SELECT * FROM VALUES ('p', 'a', timestamp'2024-01-01', 'h1'), ('p', 'b', timestamp'2024-01-02', 'h2') t(partition, path, updated_at, sha256)"
    # late and unchanged: skipped; late but changed: taken; newer: taken; a new partition: taken
    two = "SELECT * FROM VALUES ('p', 'c', timestamp'2024-01-01', 'h3'), ('p', 'a', timestamp'2024-01-01', 'h9'), ('p', 'd', timestamp'2024-01-03', 'h4'), ('q', 'a', timestamp'2020-01-01', 'h5') t(partition, path, updated_at, sha256)"

    def run():
        stream = spark.readStream.schema(STATE).parquet(source)
        ingest_stream(stream, archive, checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["partition"], r["path"], r["sha256"]) for r in archived(spark, archive).collect())

    spark.sql(one).write.mode("append").parquet(source)
    assert run() == [("p", "a", "h1"), ("p", "b", "h2")]
    spark.sql(two).write.mode("append").parquet(source)
    want = [("p", "a", "h1"), ("p", "a", "h9"), ("p", "b", "h2"), ("p", "d", "h4"), ("q", "a", "h5")]
    assert run() == want
    assert run() == want


def test_windows_equal_a_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").groupBy().sum("n_events").first()[0] == events.count()
