"""The stream gives the batch's hours; late events are dropped."""

from foliospark.sources import table
from foliospark.streaming import events


def test_stream_equals_batch(spark, sf, tmp_path, same):
    folder = str(tmp_path / "in")
    table(spark, sf, "events").orderBy("ts").coalesce(1).write.parquet(folder)
    stream = events.hourly(events.read_events(spark, folder))
    job = stream.writeStream.outputMode("update").format("memory").queryName("hourly_events").option("checkpointLocation", str(tmp_path / "ck")).start()
    job.processAllAvailable()
    job.stop()
    same(spark.table("hourly_events").toPandas(), events.hourly(table(spark, sf, "events")).toPandas())


def test_sessions_count_all_events(spark, sf):
    rows = table(spark, sf, "events")
    assert events.sessions(rows).agg({"n": "sum"}).first()[0] == rows.count()
