"""Helpers shared by the operators: shared-folder tables, renamed inputs and Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafaudit.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage through a table in the shared folder, which outlives executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh(*names: str) -> list[str]:
    """Column names that no input column has."""
    tail = uuid.uuid4().hex[:12]
    return [f"_{n}_{tail}" for n in names]


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def document_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that name a document: its id and a hash of its text. Rows that share
    both are one document listed more than once, and are treated alike."""
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("text_hash")]


def same_key(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Null-safe equality of equally named columns."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def each_batch(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to at most that many rows, so that long texts stay within memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
