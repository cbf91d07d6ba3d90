"""Current page status kept from the event stream, and the retention of job records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafaudit.operators.state import PAGE, merged_status, status_columns, status_partials
from leafaudit.sources import versioned

PARTIAL = "batch"


def status_state(events: DataFrame, out: str, checkpoint: str):
    """Follow a stream of events into the status log at `out`.

    What a page's events add up to can be merged, so each batch writes only the sums of
    its own events, under its batch id (a repeated batch replaces itself): no state is
    held between batches, and late events count like any other. current_status merges the
    log; compact_status folds its past into one row per page."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*PAGE).agg(*status_partials()).write.mode("overwrite").parquet(f"{out}/log/{PARTIAL}={batch_id}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _log(spark: SparkSession, out: str) -> tuple[DataFrame | None, versioned.Version | None, list[int]]:
    """Rows of the folded past and of the batches after it; and those batches."""
    base = versioned.current(spark, f"{out}/base")
    last = base.epoch if base else -1
    batches = [int(k) for k in versioned.written_parts(spark, f"{out}/log", PARTIAL)]
    after = sorted(b for b in batches if b > last)
    rows = spark.read.parquet(*[f"{out}/log/{PARTIAL}={b}" for b in after]) if after else None
    if base and base.parts:
        past = versioned.read_parts(spark, base)
        rows = past if rows is None else past.unionByName(rows)
    return rows, base, after


def current_status(spark: SparkSession, out: str) -> DataFrame | None:
    """Status of every page that has events; None before the first batch."""
    rows, _, _ = _log(spark, out)
    return None if rows is None else merged_status(rows).select(*PAGE, *status_columns())


def compact_status(spark: SparkSession, out: str) -> int:
    """Fold the finished batches into the base, one row per page; how many it folded.

    The base names its last batch, and readers skip batches up to it, so a stop before
    the pointer moves or before the old folders are gone changes no result. The newest
    batch is left alone: a restarted stream may write it again."""
    rows, base, after = _log(spark, out)
    done = after[:-1]
    if not done:
        return 0
    folder, past = versioned.new_folder(f"{out}/base"), spark.read.parquet(*[f"{out}/log/{PARTIAL}={b}" for b in done])
    past = past.unionByName(versioned.read_parts(spark, base)) if base else past
    merged = merged_status(past)
    merged.write.parquet(folder)
    number = base.number + 1 if base else 0
    versioned.publish(spark, f"{out}/base", versioned.Version(number, past.schema.json(), {"": folder}, epoch=done[-1]))
    versioned.drop_folders(spark, [f"{out}/log/{PARTIAL}={b}" for b in done])
    versioned.drop_old(spark, f"{out}/base", keep=1)
    return len(done)


def recent_jobs(jobs: DataFrame) -> DataFrame:
    """Stream of job records, one per job id; ids older than 24 hours leave the state."""
    return jobs.withWatermark("created_at", "24 hours").dropDuplicatesWithinWatermark(["job_id"])


HELD = np.dtype([("job_id", "<i8"), ("created", "<i8"), ("seen", "<i8"), ("running", "?")])


def job_retention_stream(records: DataFrame, *, seconds: int = 86400, delay: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """Changes to the set of retained jobs: (job_id, created_at, action), action kept or dropped.

    records(job_id, created_at, seen_at, running): what was heard of a job and when;
    seen_at drives the clock, and the record seen last tells whether the job runs. Jobs are
    kept in buckets of ids, so that one call judges all jobs of a bucket at once; a bucket
    sets a timer at the earliest end among its jobs. A job that still runs has no end and is
    held until it is heard to have ended. Dropped jobs leave the state, and a bucket without
    jobs does too. Records without an id only move the clock. Records later than `delay`
    behind the clock are ignored. `buckets` belongs to the checkpoint: it must not change
    between runs; results do not depend on it."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(np.frombuffer(bytes(state.get[0]), HELD)) if state.exists else pd.DataFrame(np.empty(0, HELD))
        clock, first, said = state.getCurrentWatermarkMs(), held["created"].iloc[:0], []
        if not state.hasTimedOut:
            heard = pd.concat([f.loc[f["named"], ["job_id", "created", "seen", "running"]] for f in frames], ignore_index=True)
            by_job = heard.groupby("job_id")
            newest = heard.loc[by_job["seen"].idxmax()].set_index("job_id")
            held = held.set_index("job_id")
            first = by_job["created"].min()
            first = first[~first.index.isin(held.index)]
            said.append((first, "kept"))
            before = held["seen"].reindex(newest.index)
            newest = newest[before.isna() | (newest["seen"] >= before)]
            newest["created"] = pd.concat([held["created"], first]).loc[newest.index]
            held = pd.concat([held[~held.index.isin(newest.index)], newest[held.columns]]).reset_index()
        ends = (held["created"] // 1_000_000 + seconds + 1) * 1000 - 1
        over = ~held["running"].astype(bool) & (ends < clock)
        said.append((held[over].set_index("job_id")["created"], "dropped"))
        held, ends = held[~over], ends[~over & ~held["running"].astype(bool)]
        if len(held):
            state.update((held[list(HELD.names)].to_records(index=False, column_dtypes={n: HELD[n] for n in HELD.names}).tobytes(),))
            if len(ends):
                state.setTimeoutTimestamp(max(int(ends.min()), clock + 1))
        elif state.exists:
            state.remove()
        for jobs, action in said:
            if len(jobs):
                yield pd.DataFrame({"job_id": jobs.index, "created": jobs.to_numpy(), "action": action})

    micros = {n: F.unix_micros(f"{n}_at") for n in ("created", "seen")}
    changes = (
        records.withWatermark("seen_at", delay)
        .withColumns({"named": F.col("job_id").isNotNull(), "bucket": F.pmod(F.xxhash64("job_id"), F.lit(buckets)), **micros})
        .select("bucket", "seen_at", "named", F.coalesce("job_id", F.lit(0)).alias("job_id"), "created", "seen", F.coalesce("running", F.lit(False)).alias("running"))
        .groupBy("bucket")
        .applyInPandasWithState(follow, "job_id long, created long, action string", "jobs binary", "append", GroupStateTimeout.EventTimeTimeout)
    )
    return changes.select("job_id", F.timestamp_micros("created").alias("created_at"), "action")


def retained_jobs(changes: DataFrame) -> DataFrame:
    """Jobs that were kept and not dropped since: (job_id, created_at)."""
    n = F.sum(F.when(F.col("action") == "kept", 1).otherwise(-1))
    return changes.groupBy("job_id").agg(F.max("created_at").alias("created_at"), n.alias("n")).filter("n > 0").drop("n")
