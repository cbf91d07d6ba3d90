"""Log and inbox streams over rolled files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafaudit.functions.text import slugify

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
LOG_SCHEMA = "book string, page bigint, seq bigint, ts timestamp_ntz, chunk string"


def read_log_stream(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, max_files: int = 1000) -> DataFrame:
    """JSON-lines log files as a stream. Writers must roll files: a file is read once,
    when it first appears."""
    return (
        spark.readStream.schema(schema)
        .option("timestampNTZFormat", TS_FORMAT)
        .option("maxFilesPerTrigger", max_files)
        .json(path)
    )


def write_log_files(lines: DataFrame, path: str) -> None:
    """Add rolled JSON-lines files with full microsecond timestamps."""
    lines.write.mode("append").option("timestampNTZFormat", TS_FORMAT).json(path)


def append_log_stream(lines: DataFrame, out: str, checkpoint: str):
    """History and then new lines, each exactly once (file sink with its commit log)."""
    return (
        lines.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_inbox_stream(spark: SparkSession, path: str, suffix: str = "*.{pdf,epub}") -> DataFrame:
    """New inbox files as (path, size, arrived); contents stay on disk."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", suffix)
        .load(path)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("arrived"))
    )


INBOX_JOB = "slug string, files long, bytes long, action string"


def inbox_jobs(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One job per book and batch of new files: (slug, files, bytes, action).

    The slug is the file's name without its suffix, wherever it lies. The action is
    created where the book is new, existing where the catalogue or an earlier batch has
    it. What earlier batches had is kept as one flag per slug in the stream's state, so a
    batch reads neither the history nor more of the state than its own slugs."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    known = catalogue.select("slug").distinct().withColumn("listed", F.lit(True))
    named = files.select(slugify(stem).alias("slug"), "size").join(known, "slug", "left").select("slug", "size", F.coalesce("listed", F.lit(False)).alias("listed"))

    def queue(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = size = 0
        listed = state.exists
        for frame in frames:
            n, size, listed = n + len(frame), size + int(frame["size"].sum()), listed or bool(frame["listed"].any())
        state.update((True,))
        yield pd.DataFrame({"slug": [key[0]], "files": [n], "bytes": [size], "action": ["existing" if listed else "created"]})

    return named.groupBy("slug").applyInPandasWithState(queue, INBOX_JOB, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def inbox_stream(files: DataFrame, catalogue: DataFrame, out: str, checkpoint: str):
    """Write the jobs of new files, each exactly once (file sink with its commit log)."""
    return append_log_stream(inbox_jobs(files, catalogue), out, checkpoint)
