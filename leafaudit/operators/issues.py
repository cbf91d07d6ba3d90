"""Failure lines, issue classes, rollups and repair targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafaudit.operators.ordered import top_n

# Message parts that decide an issue's category, first match wins.
CATEGORY_RULES = [
    (
        "layout_overflow",
        ["overflow", "clipped text/content", "rendered page width", "rendered page height", "exactly one a4 sheet"],
    ),
    ("missing_asset", ["missing image:", "empty image"]),
    ("blank_content", ["no meaningful visible content", "blank page shell"]),
    ("missing_asset", ["missing css:", "missing js:"]),
]
OTHER_CATEGORY = "html_validation"

# Failure text that means a usage limit or a sign-in problem.
QUOTA_MARKERS = [
    "resource_exhausted", "quota reached", "quota exhausted", "rate limited", "too many requests", "429", "resets in",
]
AUTH_MARKERS = ["not authenticated", "not logged in", "authentication required", "account ineligible", "oauth"]

PAGE_FAILURE = r"^FAIL\s+([^/\s]+)/page_(\d+)\.html:\s*(.+)$"
EXTRACTOR_FAILURE = r"(?i)^FAIL extractor did not create referenced figure:\s*page\s+(\d+):\s*(.+)$"


def _has_any(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def issue_category(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit(OTHER_CATEGORY)
    for name, parts in reversed(CATEGORY_RULES):
        out = F.when(_has_any(low, parts), F.lit(name)).otherwise(out)
    return out


def blocker_class(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(_has_any(low, QUOTA_MARKERS), F.lit("quota")).when(_has_any(low, AUTH_MARKERS), F.lit("auth")).otherwise("other")
    )


def parse_failures(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Issue rows from log lines; lines of any other form are ignored."""
    text = F.trim(F.col(line))
    is_page = text.rlike(PAGE_FAILURE)
    is_extractor = text.rlike(EXTRACTOR_FAILURE)
    pick = lambda pattern, i: F.regexp_extract(text, pattern, i)
    message = F.when(is_page, F.trim(pick(PAGE_FAILURE, 3))).otherwise(
        F.concat(F.lit("Extractor did not create referenced figure: "), F.trim(pick(EXTRACTOR_FAILURE, 2)))
    )
    return lines.filter(is_page | is_extractor).select(
        *keys,
        F.when(is_page, pick(PAGE_FAILURE, 2)).otherwise(pick(EXTRACTOR_FAILURE, 1)).cast("bigint").alias("page"),
        F.when(is_page, pick(PAGE_FAILURE, 1)).otherwise("all").alias("lang"),
        F.when(is_page, issue_category(message)).otherwise("missing_asset").alias("category"),
        message.alias("message"),
    )


def repair_rollup(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted distinct categories (a fixed small set) per page over all languages."""
    return issues.groupBy(*keys, "page").agg(
        F.array_sort(F.collect_set("category")).alias("categories"), F.count("*").alias("n_issues")
    )


def repair_targets(
    requested: DataFrame, issues: DataFrame, config: DataFrame, *, translation: str = "vi"
) -> DataFrame:
    """Requested pages that the report names, with the translate flag."""
    reported = issues.groupBy("book", "page").agg(F.bool_or(F.col("lang") == translation).alias("_tr"))
    return (
        requested.select("book", "page")
        .distinct()
        .join(reported, ["book", "page"])
        .join(config.select("book", F.col("translate").alias("_cfg")), "book", "left")
        .select("book", "page", (F.coalesce("_cfg", F.lit(True)) | F.col("_tr")).alias("translate"))
    )


FINDINGS = ["plan", "source", "structure", "asset"]


def page_verdicts(expected: DataFrame, delivered: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per expected page: (book, lang, page, verdict, n_issues, layout).

    delivered(book, lang, page, empty, valid) comes from the content gate; findings(book,
    lang, page, kind) has a row per issue of the kinds in FINDINGS, or layout. A page is
    missing, empty (one issue), refused by the gate (one issue, and nothing else of it is
    judged), faulty (all its findings) or ok. Layout findings are counted apart: they stop the
    book and not the page. All sources meet in one aggregation on the page's key, so no
    table is joined and partial counts are combined before the shuffle."""
    keys = ["book", "lang", "page"]
    state = F.when(F.col("empty"), "empty").when(~F.col("valid"), "refused").otherwise("present")
    marks = (
        expected.select(*keys, F.lit("expected").alias("kind"))
        .unionByName(delivered.select(*keys, state.alias("kind")))
        .unionByName(findings.select(*keys, "kind"))
    )
    has = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    counted = marks.groupBy(*keys).agg(
        has("expected").alias("_expected"), has("empty").alias("_empty"), has("refused").alias("_refused"),
        has("present").alias("_present"), has(*FINDINGS).alias("_found"), has("layout").alias("layout"),
    )
    verdict = (
        F.when(F.expr("_empty + _refused + _present") == 0, "missing")
        .when(F.col("_empty") > 0, "empty").when(F.col("_refused") > 0, "refused").when(F.col("_found") > 0, "faulty").otherwise("ok")
    )
    issues = F.when(verdict.isin("empty", "refused"), F.lit(1)).when(verdict == "faulty", F.col("_found")).otherwise(0)
    return counted.filter("_expected > 0").select(*keys, verdict.alias("verdict"), issues.cast("bigint").alias("n_issues"), "layout")


def broken_pages(verdicts: DataFrame) -> DataFrame:
    """Every page that is missing or has an issue in some language; the list behind verify_rollup's count."""
    missing = F.count_if(F.col("verdict") == "missing")
    return verdicts.filter("verdict <> 'ok'").groupBy("book", "page").agg(missing.alias("missing"), F.sum("n_issues").alias("n_issues"))


def verify_rollup(verdicts: DataFrame, assembly: DataFrame, *, shown: int = 10) -> DataFrame:
    """Per book: missing pages, issues, broken pages, layout findings, assembly and whether it is ready.

    A book is ready if no page is missing or has an issue, no page fails its layout, and every
    language was assembled; assembly(book, lang, ok). The summary names the first `shown`
    missing pages; broken_pages lists them all."""
    pages = verdicts.groupBy("book", "page").agg(
        F.count_if(F.col("verdict") == "missing").alias("_missing"), F.sum("n_issues").alias("_issues"),
        F.bool_or(F.col("verdict") != "ok").alias("_broken"), F.sum("layout").alias("_layout"),
    )
    books = pages.groupBy("book").agg(
        F.sum("_missing").alias("missing"), F.sum("_issues").alias("invalid"), F.count_if("_broken").alias("broken"), F.sum("_layout").alias("layout")
    )
    first = top_n(verdicts.filter("verdict = 'missing'").select("book", "page").distinct(), ["book"], [F.col("page").asc()], shown)
    first = first.groupBy("book").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: p.cast("string")), ",").alias("first_missing")
    )
    built = assembly.groupBy("book").agg(F.bool_and("ok").alias("assembled"))
    sound = (F.col("missing") == 0) & (F.col("invalid") == 0) & (F.col("layout") == 0)
    assembled = F.coalesce("assembled", F.lit(False))
    return (
        books.join(first, "book", "left")
        .join(built, "book", "left")
        .select(
            "book", "missing", "invalid", "broken", "layout", F.coalesce("first_missing", F.lit("")).alias("first_missing"),
            assembled.alias("assembled"), (sound & assembled).alias("ready"),
        )
    )
