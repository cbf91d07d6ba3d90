"""File sources: page HTML, manifests, plans, lexicon and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafaudit.operators.corpus import page_scan


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Page corpus below root: <book>/output/<lang>/page_NNNN.html, one row per file."""
    raw = (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "page_*.html")
        .text(root)
        .select(
            F.col("value").alias("html"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("mtime"),
        )
    )
    return page_scan(raw)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path, size and time of files; contents are never read (the column is pruned).

    Spark's file sources leave out files of length 0, so an empty asset shows up as
    missing when the inventory comes from here."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )


def read_documents(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Whole small files (JSON manifests, plans) as (path, json); parsing is left to the scans."""
    return (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    )


def read_lines(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    )


LANGUAGES = T.ArrayType(
    T.StructType([T.StructField("code", T.StringType()), T.StructField("role", T.StringType())])
)
BOOK_MANIFEST = T.StructType(
    [
        T.StructField("slug", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("source_lang", T.StringType()),
        T.StructField("library_state", T.StringType()),
        T.StructField("page_count", T.LongType()),
        T.StructField("languages", LANGUAGES),
        T.StructField("page_chrome", T.MapType(T.StringType(), T.StringType())),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def book_manifests(documents: DataFrame, folder: str = "folder") -> DataFrame:
    """Parse book manifests; a missing one gets the defaults, an unreadable one is marked."""
    m = F.from_json("json", BOOK_MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    status = (
        F.when(F.col("json").isNull(), "missing").when(F.col("m._corrupt_record").isNotNull(), "corrupt").otherwise("ok")
    )
    default = F.array(F.struct(F.lit("en").alias("code"), F.lit("primary").alias("role")))
    return documents.withColumn("m", m).select(
        F.col(folder).alias("folder"),
        F.coalesce("m.slug", F.col(folder)).alias("slug"),
        F.col("m.title").alias("title"),
        F.col("m.author").alias("author"),
        F.coalesce("m.source_lang", F.lit("en")).alias("source_lang"),
        F.col("m.library_state").alias("library_state"),
        F.coalesce("m.page_count", F.lit(0)).cast("bigint").alias("page_count"),
        F.coalesce("m.languages", default).alias("languages"),
        F.col("m.page_chrome").alias("page_chrome"),
        status.alias("status"),
    )


def book_manifest_scan(documents: DataFrame, folder: str = "folder") -> DataFrame:
    """One row per book and language."""
    books = book_manifests(documents, folder)
    return books.select(
        "folder", "slug", "title", "source_lang", "page_count", "status", F.inline("languages")
    ).withColumnRenamed("code", "lang")
