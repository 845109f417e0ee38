"""Streams over files that are there, each run to its end."""

from pyspark.sql import functions as F

from webframe.streaming import frontier_stream as S


def test_links_reach_the_frontier_once(spark, tmp_path):
    source, folder = str(tmp_path / "links"), str(tmp_path / "frontier")
    kinds = "seq long, url string, level int"
    for n, rows in enumerate([[(1, "http://a/", 0), (2, "http://b/", 1), (3, "http://a/", 5)], [(4, "http://b/", 1), (5, "http://c/", 2)]]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kinds).parquet(source)
        S.stream_links_into(stream, folder, str(tmp_path / "state")).awaitTermination(60)
        found = {(r["seq"], r["url"], r["level"]) for r in spark.read.parquet(folder).collect()}
        assert found == {(1, "http://a/", 0), (2, "http://b/", 1), *([(5, "http://c/", 2)] if n else [])}


def test_rates_of_a_batch(spark):
    rows = [("2024-01-01 00:10:00", "done", 5), ("2024-01-01 00:50:00", "done", 7), ("2024-01-01 01:00:00", "error", 1)]
    events = spark.createDataFrame(rows, "ts string, status string, size long").withColumn("ts", F.to_timestamp("ts"))
    found = sorted((str(r["window_start"]), r["status"], r["n"], r["size"]) for r in S.fetch_rates(events).collect())
    assert found == [("2024-01-01 00:00:00", "done", 2, 12), ("2024-01-01 01:00:00", "error", 1, 1)]


def test_keys_come_again_after_their_time(spark, tmp_path):
    source, kinds = str(tmp_path / "events"), "k string, ts timestamp"
    batches = [["2024-01-01 00:00:00", "2024-01-01 00:05:00"], ["2024-01-01 02:00:00"], ["2024-01-01 02:30:00"], ["2024-01-01 05:00:00"], ["2024-01-01 05:01:00"]]
    for times in batches:
        spark.createDataFrame([("k", t) for t in times], "k string, ts string").select("k", F.to_timestamp("ts").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kinds).parquet(source)
        query = S.first_within(stream, "k", "ts", "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    found = sorted(str(r["ts"]) for r in spark.read.schema(kinds).parquet(str(tmp_path / "out")).collect())
    assert found[0].startswith("2024-01-01 00:0") and 2 <= len(found) < 6 and any(x.startswith("2024-01-01 05") for x in found)
