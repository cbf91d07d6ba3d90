"""Sinks: partitioned pages, issue snapshots, keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafaudit.sources import versioned

BUCKET = "_bucket"


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages laid out by book and language, ordered by page inside each file.

    Range partitioning on (book, lang, page) splits a large book over many tasks
    and gives every task a contiguous slice, so no task writes many folders."""
    (
        pages.repartitionByRange("book", "lang", "page")
        .sortWithinPartitions("book", "lang", "page")
        .write.mode("overwrite")
        .partitionBy("book", "lang")
        .parquet(path)
    )


def write_issue_snapshot(issues: DataFrame, path: str, *, stage: str, epoch: int | None = None, full_run: bool = True) -> int:
    """Publish the issues of a run as the new snapshot; the number of issues.

    A run without issues drops the snapshot if it was a full one, else leaves it. Readers
    see the old or the new snapshot, wherever a writer stops. With an epoch a run is
    written once: a repeated run, or one older than the snapshot, changes nothing and gets
    the count of the snapshot that stands. The count is observed during the write, so the
    issues are computed once."""
    spark = issues.sparkSession
    last = versioned.current(spark, path)
    if last and epoch is not None and last.epoch is not None and epoch <= last.epoch:
        return last.rows or 0
    folder, seen = versioned.new_folder(path), Observation("issues")
    counted = issues.withColumn("stage", F.lit(stage))
    counted.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(folder)
    n = int(seen.get["n"])
    if n or full_run:
        number = last.number + 1 if last else 0
        versioned.publish(spark, path, versioned.Version(number, counted.schema.json(), {"": folder} if n else {}, epoch, n))
    return n


def read_issue_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot that stands (without rows after a clean run), None before the first."""
    return versioned.read_current(spark, path)


def keyed_upsert(base: DataFrame, updates: DataFrame, vanished: DataFrame, keys: list[str]) -> DataFrame:
    """New index content: keys in the batch replaced, vanished keys removed, others kept."""
    touched = updates.select(*keys).unionByName(vanished.select(*keys)).distinct()
    return base.join(touched, keys, "left_anti").unionByName(updates)


def upsert_index(updates: DataFrame, vanished: DataFrame, path: str, keys: list[str], *, buckets: int = 64) -> int:
    """Apply a batch to the index at path; the number of the version it made.

    The index is cut into buckets by a hash of the keys. Only buckets with a key of the
    batch are read and rewritten, to a folder of their own; the new version takes the
    folders of all others over. Applying a batch again gives the same rows. The first
    batch sets the number of buckets."""
    spark = updates.sparkSession
    last = versioned.current(spark, path)
    buckets = last.buckets if last else buckets
    part = versioned.bucket_of(keys, buckets)
    touched = updates.select(*keys).unionByName(vanished.select(*keys)).select(part.alias("b")).distinct()
    hit = [str(r.b) for r in touched.collect()]  # at most `buckets` numbers
    empty = spark.createDataFrame([], updates.schema)
    base = versioned.read_parts(spark, last, hit) if last else empty
    new = keyed_upsert(base, updates, vanished, keys).withColumn(BUCKET, part)
    folder = versioned.new_folder(path)
    new.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
    kept = {k: v for k, v in last.parts.items() if k not in hit} if last else {}
    number = last.number + 1 if last else 0
    parts = kept | versioned.written_parts(spark, folder, BUCKET)
    versioned.publish(spark, path, versioned.Version(number, updates.schema.json(), parts, buckets=buckets))
    return number


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    return versioned.read_current(spark, path)
