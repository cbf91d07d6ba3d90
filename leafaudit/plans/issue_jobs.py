"""Jobs on failure lines, issue rollups and repair targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafaudit.operators import assembly, assets, corpus, fidelity, issues, visual_plans
from leafaudit.plans import derived as dv
from leafaudit.plans.corpus_jobs import gate_sql
from leafaudit.plans import asset_jobs  # noqa: F401  (its check is part of the one of page_verdicts)
from leafaudit.plans.registry import CHECKS, Inputs, job
from leafaudit.session import scratch_path
from leafaudit.sources import sinks


def _issues(d) -> str:
    return f"""
    SELECT book, CASE WHEN p THEN CAST(regexp_extract(line, '/page_([0-9]+)', 1) AS BIGINT) ELSE at_page END AS page,
           CASE WHEN p THEN regexp_extract(line, '^FAIL ([^/ ]+)/', 1) ELSE 'all' END AS lang,
           CASE WHEN NOT p THEN 'missing_asset'
                WHEN line LIKE '%overflow%' THEN 'layout_overflow'
                WHEN line LIKE '%Missing image:%' OR line LIKE '%Empty image%' OR line LIKE '%Missing CSS:%' THEN 'missing_asset'
                WHEN line LIKE '%blank page shell%' THEN 'blank_content' ELSE 'html_validation' END AS category
    FROM (SELECT *, line LIKE 'FAIL %/page_%' AS p FROM ({dv.failure_lines(d)}) l) l
    WHERE p OR line LIKE 'FAIL extractor did not create%'"""


@job(
    "repair_rollup",
    lambda d: f"""
    SELECT book, page, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) AS n_issues
    FROM ({_issues(d)}) i GROUP BY book, page""",
)
def repair_rollup(inp: Inputs):
    found = issues.parse_failures(inp.derive(dv.failure_lines), ["book"])
    return issues.repair_rollup(found, ["book"]).withColumn("categories", F.array_join("categories", ","))


@job(
    "issue_snapshot_sink",
    lambda d: f"SELECT book, page, lang, category, count(*) AS n FROM ({_issues(d)}) i GROUP BY ALL",
)
def issue_snapshot_sink(inp: Inputs):
    found = issues.parse_failures(inp.derive(dv.failure_lines), ["book"])
    path = scratch_path(inp.spark, "issue-snapshot")
    for epoch, run in ((1, found.limit(5)), (2, found), (2, found.limit(3)), (1, found.limit(0))):
        sinks.write_issue_snapshot(run, path, stage="final-validation", epoch=epoch)
    return sinks.read_issue_snapshot(inp.spark, path).groupBy("book", "page", "lang", "category").agg(F.count("*").alias("n"))


def _requested(d) -> str:
    return f"SELECT DISTINCT book, page FROM ({dv.process_events(d)}) e WHERE event_type = 'signup'"


def _config(d) -> str:
    return f"SELECT book, page_count % 2 = 0 AS translate FROM ({dv.process_books(d)}) b"


@job(
    "repair_targets",
    lambda d: f"""
    SELECT r.book, r.page, any_value(c.translate) OR bool_or(i.lang = 'vi') AS translate
    FROM ({_requested(d)}) r JOIN ({_issues(d)}) i ON r.book = i.book AND r.page = i.page
    JOIN ({_config(d)}) c ON c.book = r.book GROUP BY r.book, r.page""",
)
def repair_targets(inp: Inputs):
    found = issues.parse_failures(inp.derive(dv.failure_lines), ["book"])
    return issues.repair_targets(inp.derive(_requested), found, inp.derive(_config))


@job(
    "blocker_classify",
    lambda d: f"""
    SELECT book, page, seq, CASE WHEN error LIKE 'RESOURCE%' THEN 'quota' WHEN error LIKE 'OAuth%' THEN 'auth' ELSE 'other' END AS blocker
    FROM ({dv.process_events(d)}) e WHERE error IS NOT NULL""",
)
def blocker_classify(inp: Inputs):
    events = inp.derive(dv.process_events).filter("error is not null")
    return events.select("book", "page", "seq", issues.blocker_class(F.col("error")).alias("blocker"))


PAGE = ["book", "lang", "page"]


def gated(pages):
    """(book, lang, page, valid, empty) of delivered pages, each decided in its row."""
    marked = pages.withColumn("empty", F.col("html") == "")
    return corpus.content_gate(marked, [*PAGE, "empty"]).select(*PAGE, "valid", "empty")


def verdicts(inp: Inputs):
    """What verification says of every page, and whether its books can be assembled."""
    pages = inp.stored(dv.delivered, "delivered")
    source = inp.derive(dv.corpus).select(*PAGE, "html")
    gate = inp.keep(gated(pages), "gate")
    lost = fidelity.token_loss(source, pages.filter("html <> ''"), PAGE).select(*PAGE).distinct()
    moved = fidelity.structure_divergence(inp.derive(dv.published).filter("lang <> 'en'"), pages, PAGE)
    plans = inp.derive(dv.page_plans)
    planned = visual_plans.plan_problems(plans).select(*PAGE, F.explode("problems"))
    gaps = assets.asset_gaps(inp.derive(dv.delivered_assets), inp.derive(dv.inventory), PAGE)
    findings = inp.derive(dv.layout_findings)
    for kind, found in (("source", lost), ("structure", moved), ("plan", planned), ("asset", gaps)):
        findings = findings.unionByName(found.select(*PAGE, F.lit(kind).alias("kind")))
    judged = issues.page_verdicts(source.select(*PAGE), gate, findings)
    return inp.keep(judged, "page-verdicts"), assembly.assembly_verdicts(source, gate)


def _verdicts(d) -> str:
    """Page by page from the rules of the inputs; text loss by multisets of tokens."""
    count = lambda view, cond="true": f"coalesce((SELECT count(*) FROM ({view}) v WHERE v.book = c.book AND v.page = c.page AND {cond}), 0)"
    lost = f"SELECT DISTINCT book, page FROM (SELECT * FROM ({dv.tokens(d, dv.corpus(d))}) s EXCEPT ALL SELECT * FROM ({dv.tokens(d, dv.delivered(d))}) r) m"
    return f"""
    SELECT book, lang, page, CASE WHEN num % 7 = 3 THEN 'missing' WHEN page % 19 = 4 THEN 'empty' WHEN NOT valid THEN 'refused' WHEN found > 0 THEN 'faulty' ELSE 'ok' END AS verdict,
           CAST(CASE WHEN num % 7 = 3 THEN 0 WHEN page % 19 = 4 OR NOT valid THEN 1 ELSE found END AS BIGINT) AS n_issues, CAST(layout AS BIGINT) AS layout
    FROM (SELECT c.book, c.lang, c.page, c.num, g.valid, CASE WHEN c.page % 37 = 9 THEN 1 ELSE 0 END AS layout,
                 {count(lost)} + {count(CHECKS['asset_gaps'](d), 'v.page % 3 = 0')} + CASE WHEN c.page % 16 IN (5, 11) THEN 1 ELSE 0 END
                 + CASE WHEN c.lang <> 'en' AND c.page % 11 = 7 AND c.page % 23 <> 6 THEN 1 ELSE 0 END AS found
          FROM ({dv.corpus(d)}) c JOIN ({gate_sql(d)}) g ON g.book = c.book AND g.page = c.page) q"""


@job("page_verdicts", _verdicts)
def page_verdicts(inp: Inputs):
    return verdicts(inp)[0]


@job(
    "verify_rollup",
    lambda d: f"""
    WITH v AS MATERIALIZED ({_verdicts(d)}),
    m AS (SELECT book, page, row_number() OVER (PARTITION BY book ORDER BY page) rk FROM (SELECT DISTINCT book, page FROM v WHERE verdict = 'missing') x),
    a AS (SELECT book, bool_and(ok) AS ok FROM (
            SELECT book, lang, coalesce(bool_and(verdict NOT IN ('empty', 'refused')) FILTER (WHERE verdict <> 'missing'), false) AS ok FROM v GROUP BY book, lang) l GROUP BY book)
    SELECT v.book, CAST(count(*) FILTER (WHERE verdict = 'missing') AS BIGINT) AS missing, CAST(sum(n_issues) AS BIGINT) AS invalid,
           count(DISTINCT page) FILTER (WHERE verdict <> 'ok') AS broken, CAST(sum(layout) AS BIGINT) AS layout,
           coalesce((SELECT string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FROM m WHERE m.book = v.book AND rk <= 10), '') AS first_missing,
           any_value(a.ok) AS assembled, any_value(a.ok) AND bool_and(verdict = 'ok' AND layout = 0) AS ready
    FROM v JOIN a ON a.book = v.book GROUP BY v.book""",
)
def verify_rollup(inp: Inputs):
    return issues.verify_rollup(*verdicts(inp))


@job(
    "verify_broken_pages",
    lambda d: f"""
    SELECT book, page, count(*) FILTER (WHERE verdict = 'missing') AS missing, CAST(sum(n_issues) AS BIGINT) AS n_issues
    FROM ({_verdicts(d)}) v WHERE verdict <> 'ok' GROUP BY book, page""",
)
def verify_broken_pages(inp: Inputs):
    return issues.broken_pages(verdicts(inp)[0])
