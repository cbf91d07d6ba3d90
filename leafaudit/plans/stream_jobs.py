"""Stream jobs, each driven to completion over files derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafaudit.plans import derived as dv
from leafaudit.plans.registry import Inputs, job
from leafaudit.plans.state_jobs import NOW, latest_sql
from leafaudit.session import scratch_path
from leafaudit.streaming import agent_events, logs, status

CUT = "conv_id % 13 = 7"


def agent_lines(inp: Inputs):
    """conversations as JSON lines of an agent; some lines are cut off."""
    conv = inp.table("conversations")
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    said = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(text.alias("content")).alias("message")))
    asked = F.to_json(F.struct(F.lit("user").alias("type"), F.col("text")))
    opened = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("init").alias("subtype"), F.lit("m1").alias("model")))
    args = F.create_map(F.lit("path"), F.concat(F.lit("/tmp/dir/f"), F.col("turn").cast("string")))
    call = F.create_map(F.lit("readToolCall"), F.struct(args.alias("args")))
    tool = F.to_json(F.struct(F.lit("tool_call").alias("type"), F.lit("completed").alias("subtype"), call.alias("tool_call")))
    line = (
        F.when(F.expr(CUT), F.concat(F.lit('{"type": "assistant", "cut '), F.col("conv_id").cast("string")))
        .when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), tool)
        .when(F.col("role") == "assistant", said)
        .when(F.col("role") == "user", asked)
        .otherwise(opened)
    )
    return conv.select("conv_id", "turn", line.alias("line"))


@job(
    "agent_event_decode",
    lambda d: f"""
    SELECT conv_id, turn, CASE WHEN {CUT} THEN '{{"type": "assistant", "cut ' || conv_id || chr(10)
             WHEN role = 'assistant' AND turn % 4 = 3 THEN '✓ read (completed): f' || turn || chr(10)
             WHEN role = 'assistant' THEN text ELSE '[system] session started model=m1' END AS chunk
    FROM conversations WHERE {CUT} OR role = 'system' OR (role = 'assistant' AND (turn % 4 = 3 OR text <> ''))""",
)
def agent_event_decode(inp: Inputs):
    return agent_events.agent_event_decode(agent_lines(inp)).drop("line")


@job("log_stream", lambda d: f"SELECT book, page, seq, ts, chunk FROM ({dv.live_log(d)}) l")
def log_stream(inp: Inputs):
    """Two deliveries of rolled log files, the second after the stream has caught up."""
    root = scratch_path(inp.spark, "log-stream")
    lines = inp.derive(dv.live_log)
    early = F.col("chunk").startswith("text")
    for part in (early, ~early):
        logs.write_log_files(lines.filter(part), f"{root}/in")
        source = logs.read_log_stream(inp.spark, f"{root}/in")
        logs.append_log_stream(source, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return inp.spark.read.parquet(f"{root}/out")


def _seen(d) -> str:
    return f"SELECT DISTINCT book, page FROM ({dv.process_events(d)}) e"


@job("status_state", lambda d: latest_sql(d, expected=_seen))
def status_state(inp: Inputs):
    """Events in three deliveries, the log folded between them; it must equal the batch result."""
    root = scratch_path(inp.spark, "status")
    events = inp.derive(dv.process_events)
    schema = events.schema
    parts = [F.col("event_type") == "view", F.col("event_type") == "purchase", ~F.col("event_type").isin("view", "purchase")]
    for part in parts:
        events.filter(part).write.mode("append").parquet(f"{root}/in")
        stream = inp.spark.readStream.schema(schema).parquet(f"{root}/in")
        status.status_state(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
        status.compact_status(inp.spark, f"{root}/out")
    return status.current_status(inp.spark, f"{root}/out")


def _records(d) -> str:
    """What was heard of jobs: their start, and for some running ones their end 36 hours later."""
    return f"""
    SELECT seq AS job_id, ts AS created_at, ts AS seen_at, event_type = 'view' AND v % 5 = 0 AS running FROM ({dv.process_events(d)}) e
    UNION ALL
    SELECT seq, ts, ts + INTERVAL '36' HOUR, false FROM ({dv.process_events(d)}) e WHERE event_type = 'view' AND v % 5 = 0 AND seq % 3 = 0"""


@job(
    "job_retention_stream",
    lambda d: f"""
    SELECT job_id, min(created_at) AS created_at FROM ({_records(d)}) r WHERE seen_at <= TIMESTAMP '{NOW}' GROUP BY job_id
    HAVING epoch(TIMESTAMP '{NOW}') - floor(epoch(min(created_at))) <= 86400 OR max_by(running, seen_at)""",
)
def job_retention_stream(inp: Inputs):
    """Records in three deliveries in order of time, the last with a tick of the clock at NOW."""
    root = scratch_path(inp.spark, "retention")
    records = inp.derive(_records).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "seen_at")})
    now = F.lit(NOW).cast("timestamp")
    records = records.filter(F.col("seen_at") <= now)
    tick = inp.spark.range(1).select(F.lit(None).cast("bigint").alias("job_id"), now.alias("created_at"), now.alias("seen_at"), F.lit(False).alias("running"))
    cuts = [F.lit(None), F.lit("2024-01-12").cast("timestamp"), F.lit("2024-01-22").cast("timestamp"), F.lit(None)]
    schema = "job_id long, created_at timestamp, seen_at timestamp, running boolean"
    for i in range(3):
        low, high = (F.lit(True) if i == 0 else F.col("seen_at") >= cuts[i]), (F.lit(True) if i == 2 else F.col("seen_at") < cuts[i + 1])
        part = records.filter(low & high)
        (part.unionByName(tick) if i == 2 else part).write.mode("append").parquet(f"{root}/in")
        stream = inp.spark.readStream.schema(schema).parquet(f"{root}/in")
        logs.append_log_stream(status.job_retention_stream(stream), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return status.retained_jobs(inp.spark.read.parquet(f"{root}/out")).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def _sources(d) -> str:
    return f"SELECT source, text, doc_id FROM {d.table('documents')}"


@job(
    "inbox_stream",
    lambda d: f"""
    WITH f AS (SELECT source AS slug, doc_id % 3 = 0 AS late, count(*) AS n, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes FROM ({_sources(d)}) s GROUP BY ALL)
    SELECT slug, CAST(1 AS BIGINT) AS files, bytes, CASE WHEN slug LIKE 'src1%' OR (late AND EXISTS (SELECT 1 FROM f g WHERE g.slug = f.slug AND NOT g.late)) THEN 'existing' ELSE 'created' END AS action
    FROM f""",
)
def inbox_stream(inp: Inputs):
    """documents as one text file per source, in two deliveries, against a small catalogue."""
    root = scratch_path(inp.spark, "inbox")
    docs = inp.derive(_sources)
    catalogue = inp.keep(docs.filter("source like 'src1%'").select(F.col("source").alias("slug")).distinct(), "catalogue")
    late = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    for part in (~late, late):
        docs.filter(part).select("source", "text").repartition("source").write.mode("append").partitionBy("source").text(f"{root}/in")
        files = logs.read_inbox_stream(inp.spark, f"{root}/in", "*.txt")
        files = files.withColumn("path", F.regexp_replace("path", "/source=([^/]+)/[^/]*$", "/$1.txt"))
        logs.inbox_stream(files, catalogue, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return inp.spark.read.parquet(f"{root}/out").select("slug", "files", "bytes", "action")
