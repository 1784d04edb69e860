"""Streams give the batch results."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusveil.config import SanitizeConfig
from corpusveil.operators import limiter, report
from corpusveil.plans.engine import Engine
from corpusveil.streaming import jobs


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_sanitized_stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"mail user{i}@example.com") for i in range(30)], "doc_id int, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    cfg = SanitizeConfig(style="placeholder")
    drained(jobs.sanitized_stream(jobs.documents_stream(spark, str(tmp_path / "in"), docs.schema, 1), cfg).select("doc_id", "sanitized"), "clean")
    assert sorted(map(tuple, spark.table("clean").collect())) == sorted(map(tuple, Engine(cfg).sanitize(docs).select("doc_id", "sanitized").collect()))


def test_running_metrics(spark, tmp_path):
    entries = spark.createDataFrame([("success" if i % 3 else "error", i) for i in range(20)], "status string, processing_time_ms long").withColumn("timestamp", F.current_timestamp())
    entries.repartition(4).write.parquet(str(tmp_path / "in"))
    drained(jobs.running_metrics(jobs.documents_stream(spark, str(tmp_path / "in"), entries.schema, 1)), "totals", "complete")
    assert spark.table("totals").first() == report.metrics(entries).first()


def test_rate_limiter_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i % 3, i, t0 + timedelta(seconds=i * 7 % 200)) for i in range(60)]
    events = spark.createDataFrame(sorted(rows, key=lambda r: r[2]), "user int, id int, ts timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    drained(jobs.rate_limited_stream(jobs.documents_stream(spark, str(tmp_path / "in"), events.schema, 1), "user", "ts", "id", 4, 60), "limited")
    got = {r.id: r.accepted for r in spark.table("limited").collect()}
    assert got == {r.id: r.accepted for r in limiter.rate_limited(events, "user", "ts", "id", 4, 60).collect()} and len(got) == 60
