"""Request streams over several batches, and the package without its optional parts."""

import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from tilequarry.streaming.requests import run_latest, staging_gate

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "session long, request long, second long, staged boolean"


def test_requests_wait_until_their_image_is_staged(spark, tmp_path):
    batches = [
        [(1, 10, 1, False), (1, 11, 2, False), (2, 20, 1, False), (3, 30, 1, True), (3, 31, 2, False)],
        [(1, 12, 5, False), (2, 21, 6, True), (2, 22, 7, False)],
        [(1, 13, 9, True), (1, 14, 9, False), (3, 32, 8, False), (4, 40, 8, False)],
    ]
    for rows in batches:  # older files first
        spark.createDataFrame(rows, SCHEMA).select("session", "request", F.timestamp_seconds("second").alias("ts"), "staged").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session long, request long, ts timestamp, staged boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    staging_gate(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["session"], r["request"], r["s"]) for r in spark.read.parquet(f"{tmp_path}/out").select("session", "request", F.unix_seconds("at").alias("s")).collect())
    # Session 1's newest waits for second 9, 2's only one for second 6; 4's image never comes.
    assert got == [(1, 12, 9), (1, 14, 9), (2, 20, 6), (2, 22, 7), (3, 31, 2), (3, 32, 8)]


def test_staging_gate_reads_batches_of_many_files(spark, tmp_path, monkeypatch):
    """Events are written by several tasks, and a session's order holds over files and batches."""
    from tilequarry.plans import tile_queries as Q

    monkeypatch.setattr(Q, "GATE_ROWS", 50)
    monkeypatch.setattr(Q, "new_folder", lambda spark, name: f"{tmp_path}/{name}")
    rows = [(i, i * 7919 % 1000, i * 31 % 23, ("view", "click", "error")[i * 13 % 7 % 3]) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, second long, user_id long, event_type string").select("event_id", "user_id", "event_type", F.timestamp_seconds("second").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["session"], r["request"], r["s"]) for r in Q.staging_gate_stream(spark, str(tmp_path)).select("session", "request", F.unix_seconds("at").alias("s")).collect())
    want, parked, is_open = [], {}, set()
    for request, second, session, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "error":
            want += [(session, parked.pop(session), second)] if session in parked else []
            is_open.add(session)
        elif session in is_open:
            want.append((session, request, second))
        else:
            parked[session] = request
    assert got == sorted(want)
    assert len([f for f in os.listdir(f"{tmp_path}/gate/in") if f.endswith(".parquet")]) > 4


def test_newest_request_of_a_batch_runs_alone(spark, tmp_path):
    spark.createDataFrame([(1, 5), (1, 7), (2, 6)], "session long, request long").coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []

    def search(newest):
        assert "search" in newest.sparkSession.getTags()
        seen.extend(tuple(r) for r in newest.orderBy("session").collect())

    query = run_latest(spark.readStream.schema("session long, request long").parquet(f"{tmp_path}/in"), search, f"{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    assert seen == [(1, 7, 1), (2, 6, 0)]


def test_the_rest_works_without_the_optional_parts(tmp_path):
    """A copy without the llm folders and the pipeline still imports and registers its queries."""
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(s) <= set(q) and not [k for k in q if k.startswith('op') and k[2].isdigit()] and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
