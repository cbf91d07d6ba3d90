"""Pipeline state: status, progress, runs, usage and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafaudit.functions.text import strip
from leafaudit.operators.issues import blocker_class
from leafaudit.operators.ordered import by_width, explode_range, islands, ordered_columns, top_n, trailing_window

# Fixed values of the status contract.
STATES = ["idle", "queued", "running", "done", "failed", "cancelled"]
TOOL_STARTED = "▶ "
TOOL_DONE = "✓ "
PAGE = ["book", "page"]


def _seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def status_domain_check(events: DataFrame) -> DataFrame:
    """Invalid status rows with the reason and the corrected state, step and error."""
    bad_page = F.col("payload_page").isNotNull() & (F.col("payload_page") != F.col("page"))
    bad_state = ~F.coalesce(F.col("state").isin(STATES), F.lit(False))
    bad_step = F.coalesce(F.col("step"), F.lit("")) == ""
    reason = (
        F.when(bad_page, "page mismatch").when(bad_state, "invalid state").when(bad_step, "missing step")
    )
    return (
        events.withColumn("reason", reason)
        .filter("reason is not null")
        .select(
            "book",
            "page",
            "seq",
            "state",
            "step",
            "reason",
            F.lit("failed").alias("fixed_state"),
            F.lit("failed").alias("fixed_step"),
            F.coalesce(F.nullif("error", F.lit("")), F.lit("invalid process status payload")).alias("fixed_error"),
        )
    )


def tool_label(chunk: Column) -> Column:
    """Label of a finished tool, else null."""
    text = strip(chunk)
    return F.when(text.startswith(TOOL_DONE), F.left(strip(F.substring(text, 3, 1 << 30)), F.lit(200)))


def status_aggregates() -> list[Column]:
    """Mergeable aggregates of a page's events; the same list serves batch and stream."""
    order = F.col("seq")
    label = tool_label(F.col("chunk"))
    return [
        F.max_by(F.struct("state", "step", "message", "error", "ts"), order).alias("now"),
        F.max(F.when((F.col("state") == "running") & (F.col("step") == "starting"), F.col("ts"))).alias("last_start"),
        F.min_by("ts", order).alias("first_ts"),
        F.count_if(label.isNotNull()).alias("tool_calls"),
        F.max_by(label, F.when(label.isNotNull(), order)).alias("last_tool"),
    ]


def status_partials() -> list[Column]:
    """status_aggregates with the order of their picks, so that sums of parts can be merged."""
    order = F.col("seq")
    label = tool_label(F.col("chunk"))
    return [*status_aggregates(), F.max(order).alias("now_at"), F.min(order).alias("first_at"), F.max(F.when(label.isNotNull(), order)).alias("tool_at")]


def merged_status(parts: DataFrame) -> DataFrame:
    """One row per page from status_partials of parts of its events."""
    return parts.groupBy(*PAGE).agg(
        F.max_by("now", "now_at").alias("now"),
        F.max("last_start").alias("last_start"),
        F.min_by("first_ts", "first_at").alias("first_ts"),
        F.sum("tool_calls").alias("tool_calls"),
        F.max_by("last_tool", "tool_at").alias("last_tool"),
        F.max("now_at").alias("now_at"),
        F.min("first_at").alias("first_at"),
        F.max("tool_at").alias("tool_at"),
    )


def status_columns() -> list[Column]:
    return [
        F.coalesce("now.state", F.lit("idle")).alias("state"),
        F.coalesce("now.step", F.lit("idle")).alias("step"),
        F.col("now.message").alias("message"),
        F.col("now.error").alias("error"),
        F.coalesce("last_start", "first_ts").alias("started_at"),
        F.col("now.ts").alias("updated_at"),
        F.coalesce("tool_calls", F.lit(0)).cast("bigint").alias("tool_calls"),
        "last_tool",
    ]


def latest_status(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Current status of every expected page; pages without events are idle."""
    current = events.groupBy(*PAGE).agg(*status_aggregates())
    return expected.select(*PAGE).join(current, PAGE, "left").select(*PAGE, *status_columns())


def expected_pages(books: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Pages 1..page_count of every book."""
    return explode_range(books, ["book", *(keep or [])], F.lit(1), F.col("page_count"), "page")


def pending_pages(books: DataFrame, with_source: DataFrame, valid: DataFrame) -> DataFrame:
    """Expected pages that have a source but lack a valid output in a required language.

    books(book, page_count, languages array), with_source(book, page), valid(book, page, lang)."""
    wanted = expected_pages(books, ["languages"]).join(with_source.select(*PAGE).distinct(), PAGE, "left_semi")
    wanted = wanted.select(*PAGE, F.explode("languages").alias("lang"))
    lacking = wanted.join(valid.select(*PAGE, "lang").distinct(), [*PAGE, "lang"], "left_anti")
    return lacking.groupBy(*PAGE).agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("missing_langs"))


def contiguous_groups(pages: DataFrame) -> DataFrame:
    """Ranges of consecutive page numbers per book."""
    return islands(pages, ["book"], "page")


def next_batch(pending: DataFrame, size: int = 8) -> DataFrame:
    """The first `size` pending pages of each book."""
    return top_n(pending.select(*PAGE).distinct(), ["book"], [F.col("page").asc()], size).drop("rk")


def run_summary(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and blockers per run; attempts(keys, page, seq, ok, error)."""
    kind = blocker_class(F.col("error"))
    failed = ~F.col("ok")
    blocked = failed & kind.isin("quota", "auth")
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("ok")).alias("completed"),
        F.count_if(failed).alias("failed"),
        F.bool_or(failed & (kind == "quota")).alias("quota_blocked"),
        F.bool_or(failed & (kind == "auth")).alias("auth_blocked"),
        F.max_by(F.when(blocked, F.col("error")), F.when(blocked, F.col("seq"))).alias("blocker_message"),
        F.max("ts").alias("finished_at"),
    )


def run_failures(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The failed map of a run as rows: last error per page that never succeeded later."""
    last = attempts.groupBy(*keys, "page").agg(F.max_by(F.struct("ok", "error"), "seq").alias("last"))
    return last.filter(~F.col("last.ok")).select(*keys, "page", F.col("last.error").alias("error"))


def resume_state(books: DataFrame, pending: DataFrame, runs: DataFrame, now: str, poll_seconds: int = 900) -> DataFrame:
    """completed / blocked_auth / pending_quota / partial, with resume time and remaining wait."""
    left = pending.groupBy("book").agg(F.countDistinct("page").alias("pending"))
    agg = runs.groupBy("book").agg(
        F.bool_or("quota_blocked").alias("quota"), F.bool_or("auth_blocked").alias("auth"), F.max("finished_at").alias("finished_at")
    )
    wait = F.expr(f"make_dt_interval(0, 0, 0, {int(poll_seconds)})")
    resume = F.when(F.col("status") == "pending_quota", F.col("finished_at") + wait).when(
        F.col("status") == "partial", F.col("finished_at")
    )
    status = (
        F.when(F.coalesce("pending", F.lit(0)) == 0, "completed")
        .when(F.coalesce("auth", F.lit(False)), "blocked_auth")
        .when(F.coalesce("quota", F.lit(False)), "pending_quota")
        .otherwise("partial")
    )
    remaining = _seconds(F.col("resume_after")) - _seconds(F.lit(now))
    return (
        books.select("book")
        .join(left, "book", "left")
        .join(agg, "book", "left")
        .withColumn("status", status)
        .withColumn("resume_after", resume)
        .select(
            "book",
            F.coalesce("pending", F.lit(0)).cast("bigint").alias("pending"),
            "status",
            "resume_after",
            F.greatest(F.coalesce(remaining, F.lit(0)), F.lit(0)).cast("bigint").alias("wait_seconds"),
        )
    )


def collapse_repeats(log: DataFrame) -> DataFrame:
    """Drop a chunk identical to the one just before it on the same page.

    Before the first chunk stands an empty one, so a leading empty chunk goes as well."""
    seen = ordered_columns(log, PAGE, ["seq"], by_width("seq"), lags={"_prev": "chunk"})
    return seen.filter(~F.coalesce("_prev", F.lit("")).eqNullSafe(F.col("chunk"))).drop("_prev")


def running_tool_count(log: DataFrame) -> DataFrame:
    """Finished-tool count and last tool label as of each chunk."""
    marked = log.withColumn("_label", tool_label(F.col("chunk"))).withColumn("_done", F.col("_label").isNotNull().cast("int"))
    out = ordered_columns(
        marked, PAGE, ["seq"], by_width("seq"), sums={"tool_calls": "_done"}, lasts={"last_tool": "_label"}
    )
    return out.drop("_label", "_done")


def rolling_activity(log: DataFrame) -> DataFrame:
    """Activity preview: the last four text fragments, at most 200 characters from the end."""
    text = strip(F.col("chunk"))
    is_text = (text != "") & ~text.startswith("[") & ~text.startswith(TOOL_STARTED) & ~text.startswith(TOOL_DONE)
    fragments = log.filter(is_text).withColumn("_frag", F.left(text, F.lit(100)))
    ranked = ordered_columns(fragments, PAGE, ["seq"], by_width("seq"), rank="_rank")

    def build(df: DataFrame, w) -> DataFrame:
        return df.withColumn("_joined", F.array_join(F.collect_list("_frag").over(w), " … "))

    joined = F.col("_joined")
    preview = F.when(F.length(joined) > 200, F.concat(F.lit("…"), F.right(joined, F.lit(199)))).otherwise(joined)
    return (
        trailing_window(ranked, PAGE, "_rank", 4, build)
        .withColumn("activity", preview)
        .select(*log.columns, "activity")
    )


def log_tail(log: DataFrame, n: int = 200) -> DataFrame:
    """Last n lines per page, numbered in order."""
    tail = top_n(log, PAGE, [F.col("seq").desc()], n)
    size = tail.groupBy(*PAGE).agg(F.max("rk").alias("_m"))
    return tail.join(size, PAGE).withColumn("line_no", (F.col("_m") - F.col("rk") + 1).cast("bigint")).drop("_m", "rk")


def retain_latest(versions: DataFrame, keys: list[str], order: list[str], keep: int = 20) -> DataFrame:
    """Versions beyond the newest `keep` of their group, i.e. those to delete.

    Only the keep-th newest version of a group is searched (top-n before the shuffle);
    the list is then a comparison against it."""
    newest = top_n(versions, keys, [F.col(c).desc() for c in order], keep)
    floor = (
        newest.groupBy(*keys)
        .agg(F.min(F.struct(*order)).alias("_floor"), F.count("*").alias("_n"))
        .filter(F.col("_n") == keep)
        .drop("_n")
    )
    return versions.join(floor, keys).filter(F.struct(*order) < F.col("_floor")).drop("_floor")


def usage_bands(usage: DataFrame) -> DataFrame:
    """Latest percent per limit, used share, colour band, and group and account totals."""
    limit = ["account", "grp", "limit_name"]
    latest = usage.groupBy(*limit).agg(F.max_by("percent", F.struct("ts", "seq")).alias("percent"))
    latest = latest.withColumn("used", 100 - F.col("percent")).withColumn(
        "band", F.when(F.col("used") > 90, "red").when(F.col("used") > 75, "amber").otherwise("green")
    )
    group = latest.groupBy("account", "grp").agg(F.max("used").alias("group_used"), F.count("*").alias("group_limits"))
    account = group.groupBy("account").agg(F.max("group_used").alias("account_used"))
    return latest.join(group, ["account", "grp"]).join(account, "account")


def job_retention(jobs: DataFrame, now: str, seconds: int = 86400) -> DataFrame:
    """Jobs kept at `now`: younger than the limit or still running."""
    age = _seconds(F.lit(now)) - _seconds(F.col("created_at"))
    return jobs.filter((age <= seconds) | F.col("running"))


def book_status_rollup(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Progress counts per book from per-page flags (split, page_pdf, published)."""
    counts = pages.groupBy("book").agg(
        F.count("*").alias("pipeline_pages"),
        F.count_if("page_pdf").alias("page_pdf_done"),
        F.count_if(F.col("split") & ~F.col("page_pdf")).alias("pending_page_pdf"),
        F.count_if("published").alias("published"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return books.join(counts, "book", "left").select(
        "book",
        F.coalesce(F.nullif("page_count", F.lit(0)), "pipeline_pages", F.lit(0)).cast("bigint").alias("page_count"),
        *[zero(c) for c in ("pipeline_pages", "page_pdf_done", "pending_page_pdf", "published")],
    )
