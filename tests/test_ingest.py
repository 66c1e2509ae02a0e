"""Sources and streams."""

import io
import zipfile

from pyspark.sql import functions as F

from graphloom.sources.files import archive_members, changed_files, file_delta, scan, with_language
from graphloom.storage import shared_dir, upsert, work_path
from graphloom.streaming.ingest import apply_transition, enqueue, messages, parse_messages, run_ingest, session_state, trimmed_recap, windowed_counts


def test_scan_archives_and_languages(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.sql").write_text("DECLARE @a INT\nGO\n")
    (tmp_path / "a" / "y.JAVA").write_text("class Y {}")
    (tmp_path / "a" / "z.bin").write_bytes(b"\0")
    files = with_language(scan(spark, str(tmp_path)))
    assert sorted(r.language for r in files.collect()) == ["java", "tsql"]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("ok/a.sql", "select 1")
        z.writestr("../evil.sql", "x")
        z.writestr("big.sql", "x" * 1000)
    archives = spark.createDataFrame([("u.zip", bytearray(data.getvalue())), ("bad.zip", bytearray(b"no zip"))], "path string, content binary")
    assert [(r.path, r.size_bytes) for r in archive_members(archives, 100).collect()] == [("ok/a.sql", 8)]


def test_delta(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    delta = file_delta(old, new)
    assert {tuple(r) for r in delta.collect()} == {("b", "MODIFIED"), ("c", "DELETED"), ("d", "ADDED")}
    assert {r.path for r in changed_files(new, delta).collect()} == {"b", "d"}
    assert file_delta(old, old).collect() == []


def test_replay_is_idempotent(spark):
    """Messages taken in twice, in two orders, leave the same table."""
    landing, dead, check = work_path(spark, "in"), work_path(spark, "dead"), f"{shared_dir(spark)}/work/check-{id(spark)}"
    schema = "index_run_id string, project_id string, source_id string, source_type string, trigger string"
    state = {"runs": spark.createDataFrame([], schema)}

    def process(df, number):
        after = upsert(state["runs"], df.dropDuplicates(["index_run_id"]), ["index_run_id"])
        state["runs"] = spark.createDataFrame(after.collect(), schema)

    one = spark.createDataFrame([("r1", "p", "s", "git", "manual"), ("r2", "p", "s", "git", "webhook")], schema)
    for _ in range(2):
        enqueue(one, landing)
        spark.createDataFrame([('{"x": 1}',), ("no json",)], "value string").write.mode("append").text(landing)
        run_ingest(messages(spark, landing), process, check, dead).awaitTermination()
    assert sorted(r.index_run_id for r in state["runs"].collect()) == ["r1", "r2"]
    assert spark.read.text(dead).count() == 4


def test_poison_messages(spark):
    raw = spark.createDataFrame([('{"index_run_id":"a","project_id":"p","trigger":"manual"}',), ('{"index_run_id":"a"}',), ("{",), (None,), ('{"index_run_id":"a","project_id":"p","trigger":"other"}',)], "value string")
    assert [r.message is not None for r in parse_messages(raw).collect()] == [True, False, False, False, False]


def test_run_transitions(spark):
    runs = spark.createDataFrame([("a", "pending", None, None, None), ("b", "running", "t0", None, None)], "run_id string, status string, started_at string, completed_at string, error string")
    changes = spark.createDataFrame([("a", "running", "t1", None), ("b", "failed", "t2", "boom")], "run_id string, status string, ts string, error string")
    assert sorted(map(tuple, apply_transition(runs, changes).collect())) == [("a", "running", "t1", None, None), ("b", "failed", "t0", "t2", "boom")]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:10", "s1", "q1"), (1, "2024-01-01 00:00:20", "s1", "q2"), (1, "2024-01-01 00:00:30", "s2", None), (2, "2024-01-01 00:00:40", "s9", "q3")], "user_id long, ts string, symbol string, query string")
    events = events.withColumn("ts", F.to_timestamp("ts")).withColumn("event_type", F.lit("e"))
    path = str(tmp_path / "events")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    for name, df, mode in (("state", session_state(stream.drop("event_type")), "update"), ("windows", windowed_counts(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    got = {r.user_id: (r.n_seen, r.last_queries) for r in spark.table("state").collect()}
    assert got == {1: (2, ["q1", "q2"]), 2: (1, ["q3"])}
    assert [r.n for r in spark.table("windows").collect()] == [4]


def test_recap():
    assert trimmed_recap(["a" * 40, "b" * 40, "c" * 40], 20) == ["b" * 40, "c" * 40]
    assert trimmed_recap(["x" * 9000], 500) == ["x" * 9000] and trimmed_recap([]) == []
