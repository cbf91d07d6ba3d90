import json
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from leafaudit.operators import state
from leafaudit.sources import versioned
from leafaudit.streaming import agent_events, logs, status

EVENTS = "book string, page long, seq long, ts timestamp_ntz, state string, step string, message string, error string, chunk string"


def events(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "seq long")
    return df.select(
        F.lit("b").alias("book"), (F.col("seq") % 3).alias("page"), "seq",
        F.timestamp_seconds(F.col("seq")).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("seq") % 5 == 0, "running").otherwise("done").alias("state"),
        F.when(F.col("seq") % 5 == 0, "starting").otherwise("done").alias("step"),
        F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("error"),
        F.when(F.col("seq") % 4 == 0, F.concat(F.lit("✓ tool "), F.col("seq").cast("string"))).otherwise("x").alias("chunk"),
    )


def follow(spark, tmp_path, part):
    events(spark, part).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    status.status_state(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()


def test_status_stream_equals_batch_over_restarts(spark, tmp_path):
    out = str(tmp_path / "out")
    assert status.current_status(spark, out) is None and status.compact_status(spark, out) == 0
    expected = spark.createDataFrame([("b", p) for p in range(3)], "book string, page long")
    seen, folded = [], []
    for part in (range(20, 33), range(0, 10), range(10, 20), range(40, 41)):  # late events count too
        follow(spark, tmp_path, part)
        seen += part
        folded.append(status.compact_status(spark, out))
        assert rows(status.current_status(spark, out)) == rows(state.latest_status(events(spark, seen), expected))
    assert folded == [0, 1, 1, 1]
    assert len(list((tmp_path / "out" / "log").glob("batch=*"))) == 1


def test_folding_the_status_log_may_stop_anywhere(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    for part in (range(0, 9), range(9, 20), range(20, 30)):
        follow(spark, tmp_path, part)
    want = rows(status.current_status(spark, out))
    for step in ("publish", "drop_folders"):
        with monkeypatch.context() as m:
            m.setattr(versioned, step, lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
            with pytest.raises(RuntimeError, match="stopped"):
                status.compact_status(spark, out)
        assert rows(status.current_status(spark, out)) == want
    follow(spark, tmp_path, range(30, 31))
    status.compact_status(spark, out)
    assert rows(status.current_status(spark, out), "tool_calls") == rows(state.latest_status(events(spark, range(31)), status.current_status(spark, out).select("book", "page")), "tool_calls")


RECORDS = "job_id long, created_at timestamp, seen_at timestamp, running boolean"


def test_jobs_leave_after_a_day_unless_they_run(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    parts = [
        [(1, at(0), at(0), False), (2, at(0), at(0), True), (3, at(5), at(5), True), (4, at(6), at(6), False)],
        [(3, at(5), at(20), False), (5, at(25), at(25), False), (None, at(25), at(25), False)],
        [(2, at(0), at(31), False), (6, at(31), at(31), True), (None, at(31), at(31), False)],
        [(None, at(90), at(90), False)],
    ]
    kept, sizes = [], []
    for part in parts:
        spark.createDataFrame(part, RECORDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(RECORDS).parquet(str(tmp_path / "in"))
        query = logs.append_log_stream(status.job_retention_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        kept.append(sorted(r.job_id for r in status.retained_jobs(spark.read.parquet(str(tmp_path / "out"))).collect()))
    assert kept == [[1, 2, 3, 4], [2, 3, 4, 5], [5, 6], [6]]
    assert sizes == [4, 4, 2, 1]  # the state shrinks with the set


def test_jobs_are_held_in_buckets_of_ids(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    big = 2**53 + 1
    jobs = [(big + i, at(i % 40), at(i % 40), i % 7 == 0) for i in range(400)]
    ended = [(j, c, c + timedelta(hours=30), False) for j, c, _, runs in jobs if runs and j % 2]
    parts = [[r for r in jobs + ended if low <= r[2] < high] + [(None, at(high_h), at(high_h), False)] for low, high, high_h in ((at(0), at(20), 19), (at(20), at(80), 50))]
    now = at(50).timestamp()
    last = {j: (c, s, runs) for j, c, s, runs in sorted(jobs + ended, key=lambda r: r[2]) if s <= at(50)}
    parts[1] = [r for r in parts[1] if r[2] <= at(50)]
    want = sorted(j for j, (c, _, runs) in last.items() if runs or now - c.timestamp() <= 86400)
    for buckets in (1, 3, 1024):
        root = tmp_path / str(buckets)
        for part in parts:
            spark.createDataFrame(part, RECORDS).coalesce(1).write.mode("append").parquet(str(root / "in"))
            stream = spark.readStream.schema(RECORDS).parquet(str(root / "in"))
            query = logs.append_log_stream(status.job_retention_stream(stream, buckets=buckets), str(root / "out"), str(root / "ck"))
            query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= buckets
        got = status.retained_jobs(spark.read.parquet(str(root / "out"))).collect()
        assert sorted(r.job_id for r in got) == want
        assert all(r.created_at == last[r.job_id][0] for r in got)


def test_log_stream_reads_each_line_once(spark, tmp_path):
    lines = events(spark, range(30)).select("book", "page", "seq", "ts", "chunk")
    for part in (F.col("seq") < 9, F.col("seq") >= 9):
        logs.write_log_files(lines.filter(part), str(tmp_path / "in"))
        for _ in range(2):
            source = logs.read_log_stream(spark, str(tmp_path / "in"))
            logs.append_log_stream(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(lines)


def test_inbox_queues_each_file_by_its_own_name(spark, tmp_path):
    catalogue = spark.createDataFrame([("old-book",)], "slug string")
    steps = [["x/Old Book.pdf", "x/New Book.pdf", "x/notes.doc"], ["y/New Book.epub", "z/new_book.pdf", "z/Other.v2.pdf"], ["w/Other.v2.pdf", "w/noname"]]
    for n, step in enumerate(steps):
        for i, name in enumerate(step):
            (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / name).write_text("x" * (10 * n + i + 1))
        files = logs.read_inbox_stream(spark, str(tmp_path / "in")).withColumn("path", F.url_decode("path"))
        logs.inbox_stream(files, catalogue, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted([("old-book", 1, 1, "existing"), ("new-book", 1, 2, "created"), ("new-book", 2, 11 + 12, "existing"), ("other-v2", 1, 13, "created"), ("other-v2", 1, 21, "existing")])


def test_agent_events(spark):
    said = lambda *t: {"type": "assistant", "message": {"content": [{"type": "text", "text": x} for x in t] + [{"type": "image"}]}}
    tool = lambda sub, call: {"type": "tool_call", "subtype": sub, "tool_call": call}
    cases = [
        (said("a", "b"), "ab"), (said(), None), ({"type": "user", "text": "x"}, None),
        ({"type": "system", "subtype": "init", "model": "m"}, "[system] session started model=m"),
        ({"type": "system", "subtype": "init"}, "[system] session started"), ({"type": "system"}, "[system] system"),
        ({"type": "thinking", "subtype": "delta", "text": "hm"}, "hm"), ({"type": "thinking", "subtype": "completed"}, "\n"),
        ({"type": "thinking", "subtype": "other"}, None),
        (tool("started", {"readToolCall": {"args": {"path": "/x/y/z.html"}}}), "\n▶ read (started): z.html\n"),
        (tool("completed", {"writeToolCall": {"args": {"file": "a.txt"}}}), "✓ write (completed): a.txt\n"),
        (tool("odd", {"other": {"args": {}}}), "\n[tool] tool (odd)\n"),
        ({"type": "result", "subtype": "success"}, "\n[result] success\n"), ({"type": "result"}, "\n[result] done\n"),
        ({"type": "error", "message": "boom"}, "\n[error] boom\n"), ({"type": "error", "error": "bad"}, "\n[error] bad\n"),
        ({"type": "unknown"}, None),
    ]
    data = [(i, json.dumps(e)) for i, (e, _) in enumerate(cases)] + [(98, '{"type": "assistant", "cut'), (99, "   "), (97, "plain text")]
    df = spark.createDataFrame(data, "i int, line string")
    got = dict(agent_events.agent_event_decode(df).select("i", "chunk").collect())
    want = {i: w for i, (_, w) in enumerate(cases) if w} | {98: '{"type": "assistant", "cut\n', 97: "plain text\n"}
    assert got == want


def test_recent_jobs_keeps_one_row_per_job(spark, tmp_path):
    df = events(spark, range(6)).select((F.col("seq") % 3).alias("job_id"), F.col("ts").cast("timestamp").alias("created_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id long, created_at timestamp").parquet(str(tmp_path / "in"))
    out = status.recent_jobs(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    out.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "job_id") == [(0,), (1,), (2,)]
