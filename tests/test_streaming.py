import time

from pyspark.sql import functions as F

from quillon.sources.tables import VersionedTables
from quillon.streaming.incremental import apply_batch, conversation_state, index_stream, windowed_counts

SCHEMA = "repo_id string, path string, language string, text string, file_hash string"


def test_incremental_index(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path / "i"))
    first = spark.createDataFrame([("r", "a.py", "python", "def f():\n    pass\n", "1"), ("r", "b.md", "markdown", "# T\nx\n", "1")], SCHEMA)
    assert apply_batch(t, first) == {"new": 2}
    assert apply_batch(t, first) == {"unchanged": 2}
    ids = {r["path"]: r["id"] for r in t.read("chunks").collect()}
    change = spark.createDataFrame([("r", "a.py", "python", "def g():\n    pass\n", "2"), ("r", "b.md", None, None, None)], SCHEMA)
    assert apply_batch(t, change) == {"changed": 1, "removed": 1}
    rows = t.read("chunks").collect()
    assert [r["symbol"] for r in rows] == ["g"] and rows[0]["id"] != ids["a.py"]
    assert [r["path"] for r in t.read("manifest").collect()] == ["a.py"]
    fresh = VersionedTables(spark, str(tmp_path / "f"))  # an update gives what a build from nothing gives
    apply_batch(fresh, change.where("text is not null"))
    assert sorted(map(tuple, fresh.read("chunks").collect())) == sorted(map(tuple, t.read("chunks").collect()))


def test_repositories_and_order_within_a_batch(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path / "i"))
    rows = [(r, "README.md", "markdown", f"# {r}\nx\n", r) for r in ("r", "s")]
    assert apply_batch(t, spark.createDataFrame(rows, SCHEMA)) == {"new": 2}
    assert {(r["repo_id"], r["path"]) for r in t.read("chunks").collect()} == {("r", "README.md"), ("s", "README.md")}
    before = t.current()
    assert apply_batch(t, spark.createDataFrame(rows, SCHEMA)) == {"unchanged": 2} and t.current() == before
    batch = [("r", "README.md", "markdown", "# new\n", "2", 1), ("r", "README.md", None, None, None, 2)]  # changed, then removed
    assert apply_batch(t, spark.createDataFrame(batch, SCHEMA + ", seq long")) == {"removed": 1}
    assert [(r["repo_id"], r["path"]) for r in t.read("manifest").collect()] == [("s", "README.md")]
    parts = before["tables"]["chunks"]["parts"]
    assert sum(t.current()["tables"]["chunks"]["parts"].get(k) != v for k, v in parts.items()) == 1


def test_index_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("r", "a.py", "python", "x = 1\n", "1")], SCHEMA).write.parquet(source)
    t = VersionedTables(spark, str(tmp_path / "i"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    index_stream(stream(), t, str(tmp_path / "c")).awaitTermination(60)
    spark.createDataFrame([("r", "b.py", "python", "y = 1\n", "1")], SCHEMA).write.mode("append").parquet(source)
    index_stream(stream(), t, str(tmp_path / "c")).awaitTermination(60)
    assert t.current()["version"] == 2 and t.read("manifest").count() == 2


def test_windows_and_conversations(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 01:10:00", "a", 4.0)], "id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["value"] for r in windowed_counts(events, "ts", "event_type").collect()) == [3.0, 4.0]
    source = str(tmp_path / "turns")
    schema = "conv_id string, turn int, question string, answer string"
    spark.createDataFrame([("c", i, f"q{i}", None if i == 2 else "a") for i in range(6)], schema).coalesce(1).write.parquet(source)
    turns = spark.readStream.schema(schema).parquet(source)
    q = conversation_state(turns, forget=None).writeStream.format("memory").queryName("conv").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    row = spark.sql("select * from conv").collect()[-1]
    assert (row["turns"], row["history"]) == (5, ["q3", "q4", "q5"])
    live = conversation_state(turns, forget="1 hour").writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "d")).trigger(processingTime="0 seconds").start()
    end = time.time() + 40
    while time.time() < end and not spark.sql("select * from live").count():
        time.sleep(0.5)
    live.stop()
    assert spark.sql("select * from live").collect()[-1]["turns"] == 5
