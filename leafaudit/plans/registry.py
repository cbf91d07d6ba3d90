"""Registry of named jobs: a Spark callable and, where one exists, its check SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from leafaudit.functions.dialect import DuckDialect, SparkDialect
from leafaudit.plans import derived
from leafaudit.session import scratch_path


@dataclass
class Inputs:
    """Access to the given tables and to inputs derived from them."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def dialect(self) -> SparkDialect:
        return SparkDialect(self.sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    def derive(self, view: Callable[..., str], *args) -> DataFrame:
        return self.spark.sql(view(self.dialect, *args))

    def stored(self, view: Callable[..., str], label: str) -> DataFrame:
        """A derived input that several branches of one job read, written once to the
        shared folder: each branch then scans only its own columns."""
        return self.keep(self.derive(view), label)

    def keep_objects(self) -> DataFrame:
        """Page objects as a table, from which this job's later views of them are derived."""
        if not self.dialect.objects:
            path = scratch_path(self.spark, "page-objects")
            self.derive(derived.page_objects).write.parquet(path)
            self.dialect.objects = f"SELECT * FROM parquet.`{path}`"
        return self.derive(derived.page_objects)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        return self.spark.read.parquet(path)


JOBS: dict[str, Callable[[Inputs], DataFrame]] = {}
CHECKS: dict[str, Callable[[DuckDialect], str]] = {}


def job(name: str, check: Callable[[DuckDialect], str] | None = None):
    def register(fn: Callable[[Inputs], DataFrame]):
        if name in JOBS:
            raise ValueError(f"duplicate job {name}")
        JOBS[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


MODULES = [
    "corpus_jobs",
    "asset_jobs",
    "issue_jobs",
    "state_jobs",
    "library_jobs",
    "box_jobs",
    "figure_jobs",
    "lexicon_jobs",
    "assembly_jobs",
    "stream_jobs",
]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"leafaudit.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()

    def wire(fn):
        return lambda spark, sf_dir: fn(Inputs(spark, sf_dir))

    return {name: wire(fn) for name, fn in JOBS.items()}


def oracle_sql() -> dict[str, str]:
    load_all()
    duck = DuckDialect()
    return {name: check(duck) for name, check in CHECKS.items()}
