"""Jobs on pipeline state."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafaudit.operators import state
from leafaudit.plans import derived as dv
from leafaudit.plans.registry import Inputs, job

NOW = "2024-01-15 00:00:00"


@job(
    "status_domain_check",
    lambda d: f"""
    SELECT book, page, seq, state, step,
           CASE WHEN payload_page <> page THEN 'page mismatch' WHEN state = 'paused' THEN 'invalid state' ELSE 'missing step' END AS reason,
           'failed' AS fixed_state, 'failed' AS fixed_step,
           coalesce(nullif(error, ''), 'invalid process status payload') AS fixed_error
    FROM ({dv.raw_status(d)}) r WHERE payload_page <> page OR state = 'paused' OR step = ''""",
)
def status_domain_check(inp: Inputs):
    return state.status_domain_check(inp.derive(dv.raw_status))


def _expected(d) -> str:
    return f"SELECT book, unnest(range(1, page_count + 1)) AS page FROM ({dv.process_books(d)}) b"


def latest_sql(d, view=dv.process_events, expected=_expected) -> str:
    return f"""
    WITH e AS ({view(d)}),
    a AS (SELECT book, page, max_by(state, seq) AS state, max_by(step, seq) AS step,
             arg_max_null(message, seq) AS message, arg_max_null(error, seq) AS error, max_by(ts, seq) AS updated_at,
             coalesce(max(ts) FILTER (WHERE state = 'running' AND step = 'starting'), min_by(ts, seq)) AS started_at,
             count(*) FILTER (WHERE chunk LIKE '✓ %') AS tool_calls,
             max_by(substr(chunk, 3), seq) FILTER (WHERE chunk LIKE '✓ %') AS last_tool
          FROM e GROUP BY book, page)
    SELECT x.book, x.page, coalesce(state, 'idle') AS state, coalesce(step, 'idle') AS step, message, error,
           started_at, updated_at, coalesce(tool_calls, 0) AS tool_calls, last_tool
    FROM ({expected(d)}) x LEFT JOIN a ON a.book = x.book AND a.page = x.page"""


@job("latest_status", latest_sql)
def latest_status(inp: Inputs):
    books = inp.derive(dv.process_books)
    return state.latest_status(inp.derive(dv.process_events), state.expected_pages(books))


def _with_source(d) -> str:
    return f"SELECT book, page FROM ({dv.process_events(d)}) e WHERE event_type IN ('view', 'signup', 'click')"


def _valid(d) -> str:
    return f"""SELECT book, page, CASE WHEN v % 2 = 0 THEN 'en' ELSE 'vi' END AS lang
               FROM ({dv.process_events(d)}) e WHERE event_type = 'purchase'"""


def _pending(d) -> str:
    return f"""
    SELECT x.book, x.page, string_agg(l.lang, ',' ORDER BY l.lang) AS missing_langs
    FROM ({_expected(d)}) x, (VALUES ('en'), ('vi')) l(lang)
    WHERE EXISTS (SELECT 1 FROM ({_with_source(d)}) s WHERE s.book = x.book AND s.page = x.page)
      AND NOT EXISTS (SELECT 1 FROM ({_valid(d)}) v WHERE v.book = x.book AND v.page = x.page AND v.lang = l.lang)
    GROUP BY x.book, x.page"""


def pending(inp: Inputs):
    books = inp.derive(dv.process_books).withColumn("languages", F.array(F.lit("en"), F.lit("vi")))
    return state.pending_pages(books, inp.derive(_with_source), inp.derive(_valid))


@job("pending_pages", _pending)
def pending_pages(inp: Inputs):
    return pending(inp)


@job(
    "next_batch",
    lambda d: f"""SELECT book, page FROM (SELECT book, page, row_number() OVER (PARTITION BY book ORDER BY page) rk
                  FROM ({_pending(d)}) p) q WHERE rk <= 8""",
)
def next_batch(inp: Inputs):
    return state.next_batch(pending(inp))


def _error_pages(d) -> str:
    return f"SELECT book, page FROM ({dv.process_events(d)}) e WHERE event_type = 'error'"


@job(
    "contiguous_groups",
    lambda d: f"""
    SELECT book, min(page) AS first, max(page) AS last, count(*) AS n FROM (
      SELECT book, page, page - row_number() OVER (PARTITION BY book ORDER BY page) AS g
      FROM (SELECT DISTINCT book, page FROM ({_error_pages(d)}) p) q) r GROUP BY book, g""",
)
def contiguous_groups(inp: Inputs):
    return state.contiguous_groups(inp.derive(_error_pages))


def _attempts(d) -> str:
    return f"""SELECT book, CAST(floor(seq / 1000) AS BIGINT) AS run, page, seq, ts, event_type = 'purchase' AS ok, error
               FROM ({dv.process_events(d)}) e WHERE event_type IN ('purchase', 'error')"""


def _runs(d) -> str:
    blocked = "NOT ok AND (error LIKE 'RESOURCE%' OR error LIKE 'OAuth%')"
    return f"""
    SELECT book, run, count(*) AS processed, count(*) FILTER (WHERE ok) AS completed, count(*) FILTER (WHERE NOT ok) AS failed,
           bool_or(NOT ok AND coalesce(error LIKE 'RESOURCE%', false)) AS quota_blocked,
           bool_or(NOT ok AND coalesce(error LIKE 'OAuth%', false)) AS auth_blocked,
           max_by(error, seq) FILTER (WHERE {blocked}) AS blocker_message, max(ts) AS finished_at
    FROM ({_attempts(d)}) a GROUP BY book, run"""


@job("run_summary", _runs)
def run_summary(inp: Inputs):
    return state.run_summary(inp.derive(_attempts), ["book", "run"])


@job(
    "run_failures",
    lambda d: f"""SELECT book, run, page, error FROM (
      SELECT *, row_number() OVER (PARTITION BY book, run, page ORDER BY seq DESC) rk FROM ({_attempts(d)}) a) b
      WHERE rk = 1 AND NOT ok""",
)
def run_failures(inp: Inputs):
    return state.run_failures(inp.derive(_attempts), ["book", "run"])


@job(
    "resume_state",
    lambda d: f"""
    WITH p AS (SELECT book, count(*) AS pending FROM ({_pending(d)}) p GROUP BY book),
    r AS (SELECT book, bool_or(quota_blocked) q, bool_or(auth_blocked) a, max(finished_at) f FROM ({_runs(d)}) r GROUP BY book),
    s AS (SELECT b.book, coalesce(pending, 0) AS pending, f,
            CASE WHEN coalesce(pending, 0) = 0 THEN 'completed' WHEN coalesce(a, false) THEN 'blocked_auth'
                 WHEN coalesce(q, false) THEN 'pending_quota' ELSE 'partial' END AS status
          FROM ({dv.process_books(d)}) b LEFT JOIN p ON p.book = b.book LEFT JOIN r ON r.book = b.book),
    t AS (SELECT *, CASE status WHEN 'pending_quota' THEN f + INTERVAL 900 SECOND
                                WHEN 'partial' THEN f END AS resume_after FROM s)
    SELECT book, pending, status, resume_after,
           CAST(greatest(coalesce(floor(epoch(resume_after)) - epoch(TIMESTAMP '{NOW}'), 0), 0) AS BIGINT) AS wait_seconds FROM t""",
)
def resume_state(inp: Inputs):
    runs = state.run_summary(inp.derive(_attempts), ["book", "run"])
    return state.resume_state(inp.derive(dv.process_books), pending(inp), runs, NOW)


def _page_flags(d) -> str:
    return f"""
    SELECT book, page, true AS split, bool_or(event_type = 'view') AS page_pdf, bool_or(event_type = 'purchase') AS published
    FROM ({dv.process_events(d)}) e GROUP BY book, page"""


@job(
    "book_status_rollup",
    lambda d: f"""
    SELECT b.book, b.page_count, count(f.page) AS pipeline_pages, count(*) FILTER (WHERE page_pdf) AS page_pdf_done,
           count(*) FILTER (WHERE split AND NOT page_pdf) AS pending_page_pdf, count(*) FILTER (WHERE published) AS published
    FROM ({dv.process_books(d)}) b LEFT JOIN ({_page_flags(d)}) f ON f.book = b.book GROUP BY b.book, b.page_count""",
)
def book_status_rollup(inp: Inputs):
    return state.book_status_rollup(inp.derive(dv.process_books), inp.derive(_page_flags))


@job(
    "collapse_repeats",
    lambda d: f"""SELECT book, page, seq, ts, chunk FROM (
      SELECT *, lag(chunk) OVER (PARTITION BY book, page ORDER BY seq) AS p FROM ({dv.live_log(d)}) l) q
      WHERE coalesce(p, '') IS DISTINCT FROM chunk""",
)
def collapse_repeats(inp: Inputs):
    return state.collapse_repeats(inp.derive(dv.live_log))


@job(
    "running_tool_count",
    lambda d: f"""
    SELECT book, page, seq, ts, chunk, CAST(sum(CASE WHEN chunk LIKE '✓ %' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS tool_calls,
           last_value(CASE WHEN chunk LIKE '✓ %' THEN substr(chunk, 3) END IGNORE NULLS) OVER w AS last_tool
    FROM ({dv.live_log(d)}) l WINDOW w AS (PARTITION BY book, page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def running_tool_count(inp: Inputs):
    return state.running_tool_count(inp.derive(dv.live_log))


@job(
    "rolling_activity",
    lambda d: f"""
    SELECT book, page, seq, ts, chunk, CASE WHEN length(j) > 200 THEN '…' || right(j, 199) ELSE j END AS activity FROM (
      SELECT *, array_to_string(list(left(trim(chunk), 100)) OVER (PARTITION BY book, page ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ' … ') AS j
      FROM ({dv.live_log(d)}) l WHERE chunk NOT LIKE '[%' AND chunk NOT LIKE '✓ %' AND chunk NOT LIKE '▶ %') q""",
)
def rolling_activity(inp: Inputs):
    return state.rolling_activity(inp.derive(dv.live_log))


@job(
    "log_tail_n",
    lambda d: f"""
    SELECT book, page, seq, ts, chunk, row_number() OVER (PARTITION BY book, page ORDER BY seq) AS line_no FROM (
      SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY seq DESC) AS rk FROM ({dv.live_log(d)}) l) q WHERE rk <= 200""",
)
def log_tail_n(inp: Inputs):
    return state.log_tail(inp.derive(dv.live_log))


@job(
    "retain_latest_n",
    lambda d: f"""SELECT book, page, ts, seq FROM (
      SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY ts DESC, seq DESC) AS rk FROM ({dv.live_log(d)}) l) q
      WHERE rk > 20""",
)
def retain_latest_n(inp: Inputs):
    versions = inp.derive(dv.live_log).select("book", "page", "ts", "seq")
    return state.retain_latest(versions, ["book", "page"], ["ts", "seq"])


@job(
    "usage_bands",
    lambda d: f"""
    WITH l AS (SELECT account, grp, limit_name, percent, 100 - percent AS used FROM (
      SELECT *, row_number() OVER (PARTITION BY account, grp, limit_name ORDER BY ts DESC, seq DESC) rk FROM ({dv.usage(d)}) u) q WHERE rk = 1)
    SELECT *, CASE WHEN used > 90 THEN 'red' WHEN used > 75 THEN 'amber' ELSE 'green' END AS band,
           max(used) OVER (PARTITION BY account, grp) AS group_used, count(*) OVER (PARTITION BY account, grp) AS group_limits,
           max(used) OVER (PARTITION BY account) AS account_used FROM l""",
)
def usage_bands(inp: Inputs):
    return state.usage_bands(inp.derive(dv.usage))


def _jobs(d) -> str:
    return f"""SELECT seq AS job_id, book, ts AS created_at, event_type = 'view' AND v % 5 = 0 AS running
               FROM ({dv.process_events(d)}) e"""


@job(
    "job_retention_24h",
    lambda d: f"""SELECT * FROM ({_jobs(d)}) j
      WHERE epoch(TIMESTAMP '{NOW}') - floor(epoch(created_at)) <= 86400 OR running""",
)
def job_retention_24h(inp: Inputs):
    return state.job_retention(inp.derive(_jobs), NOW)
