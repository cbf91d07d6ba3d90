"""Training-data pipeline over documents: quality, line dedup, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
Every stage keeps null-text and empty documents unless its own rule drops them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafaudit.llm import lines, near, packing, quality, secrets
from leafaudit.llm.common import fresh, read_table, same_key, stored, text_or_empty
from leafaudit.llm.jobs import held_out, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def own_columns(stage: Stage) -> Stage:
    """Columns beyond those of documents bear fresh names inside the stage, whatever they
    are called (`score`, `_before`, `TEXT`), and get their names and places back after it."""

    @wraps(stage)
    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = list(docs.columns)
        inside = [c if c in COLUMNS else fresh(f"own{i}")[0] for i, c in enumerate(names)]
        return stage(spark, docs.toDF(*inside), sf_dir).select(*inside).toDF(*names)

    return run_apart


@own_columns
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go. Labels serve for training only."""
    scored = quality.score_quality(docs, read_table(spark, sf_dir, "labels"), ~held_out())
    return scored.filter("predicted = 1").select(*docs.columns)


@own_columns
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines are deleted, however short; a document that loses all
    its text that way goes. n_chars follows the text."""
    kept = lines.drop_repeated_lines(docs).filter(~((F.col("n_removed") > 0) & (F.trim("text") == "")))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


@own_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents alike in five-word shingles (Jaccard 0.8), the one of
    least id stays; of rows that share id and text, one."""
    found = near.near_components(docs, width=5, num=8, den=10)
    copies = stored(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "row").distinct(), "near-copies")
    doc_id, row = fresh("doc_id", "row")
    keyed = docs.withColumns({doc_id: F.col("doc_id"), row: F.xxhash64("doc_id", F.xxhash64(text_or_empty()))})
    copies = copies.withColumnsRenamed({"doc_id": doc_id, "row": row})
    return keyed.join(copies, same_key(keyed, copies, [doc_id, row]), "left_anti").dropDuplicates([doc_id, row]).select(*docs.columns)


@own_columns
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets are masked; every document stays. n_chars follows the text."""
    (before,) = fresh("before")
    out = secrets.mask_secrets(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens. Columns beyond id and text take no part."""
    return packing.pack(docs.toDF(*[c if c in COLUMNS else fresh(f"own{i}")[0] for i, c in enumerate(docs.columns)]), vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: The classifier, the similarity components and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
