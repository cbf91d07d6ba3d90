"""Jobs on manifests, catalogue, readiness and language."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafaudit.operators import corpus, library
from leafaudit.plans import derived as dv
from leafaudit.plans.corpus_jobs import gate_sql
from leafaudit.plans.registry import Inputs, job
from leafaudit.plans.state_jobs import _page_flags
from leafaudit.session import scratch_path
from leafaudit.sources import files, sinks


@job(
    "book_manifest_scan",
    lambda d: f"""
    WITH m AS (SELECT folder, json, json LIKE '%}}' AS good FROM ({dv.manifest_docs(d)}) m),
    p AS (SELECT folder, json, coalesce(good, false) AS good, CASE WHEN good THEN json::JSON END AS j FROM m),
    l AS (SELECT *, CASE WHEN (j->'languages') IS NULL THEN '[{{"code": "en", "role": "primary"}}]'::JSON ELSE j->'languages' END AS langs FROM p)
    SELECT folder, coalesce(j->>'slug', folder) AS slug, j->>'title' AS title, coalesce(j->>'source_lang', 'en') AS source_lang,
           coalesce(CAST(j->>'page_count' AS BIGINT), 0) AS page_count,
           CASE WHEN json IS NULL THEN 'missing' WHEN NOT good THEN 'corrupt' ELSE 'ok' END AS status,
           x->>'code' AS lang, x->>'role' AS role
    FROM (SELECT *, unnest(CAST(langs AS JSON[])) AS x FROM l) q""",
)
def book_manifest_scan(inp: Inputs):
    return files.book_manifest_scan(inp.derive(dv.manifest_docs))


@job(
    "page_spec_select",
    lambda d: f"""
    SELECT DISTINCT p.book, p.page FROM ({dv.doc_pages(d)}) p JOIN ({dv.page_specs(d)}) s ON s.book = p.book
    WHERE p.page <= s.page_count AND (p.page <= floor(s.page_count / 2) OR p.page = s.page_count)""",
)
def page_spec_select(inp: Inputs):
    pages = inp.derive(dv.doc_pages).select("book", "page").distinct()
    return library.page_spec_select(inp.derive(dv.page_specs), pages)


def page_listing(d) -> str:
    return f"SELECT book, lang, page, url NOT LIKE '%#%' AS has_source FROM ({dv.corpus(d)}) c"


def overview(inp: Inputs):
    return library.overview_rollup(inp.derive(dv.host_books), inp.derive(page_listing))


def _overview(d) -> str:
    words = "list_transform(string_split(replace(b.book, '-', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2)))"
    return f"""
    SELECT b.book, CASE WHEN b.title = '' THEN array_to_string({words}, ' ') ELSE b.title END AS title, b.source_lang,
           coalesce(b.library_state, 'active') AS library_state, CAST(b.page_count AS BIGINT) AS page_count,
           CAST(count(*) FILTER (WHERE has_source) AS BIGINT) AS page_pdf_done,
           CAST(count(*) FILTER (WHERE lang = b.source_lang) AS BIGINT) AS published
    FROM ({dv.host_books(d)}) b LEFT JOIN ({page_listing(d)}) p ON p.book = b.book
    GROUP BY b.book, b.title, b.source_lang, b.library_state, b.page_count"""


@job("overview_rollup", _overview)
def overview_rollup(inp: Inputs):
    return overview(inp)


@job(
    "language_readiness",
    lambda d: f"""
    WITH g AS (SELECT p.book, p.lang, p.page, g.valid FROM ({dv.published(d)}) p JOIN ({gate_sql(d)}) g ON g.book = p.book AND g.page = p.page),
    r AS (SELECT book, CAST(page_count AS BIGINT) AS page_count, unnest(['en', 'fr']) AS lang FROM ({dv.host_books(d)}) b),
    k AS (SELECT book, lang, page, row_number() OVER (PARTITION BY book, lang ORDER BY page) rk FROM g WHERE NOT valid),
    c AS (SELECT r.book, r.lang, any_value(r.page_count) AS page_count, count(g.page) AS found, count(*) FILTER (WHERE NOT g.valid) AS invalid
          FROM r LEFT JOIN g ON g.book = r.book AND g.lang = r.lang GROUP BY r.book, r.lang)
    SELECT book, lang, found, invalid,
           CASE WHEN found = 0 THEN 'No rendered HTML pages'
                WHEN page_count > 0 AND found <> page_count THEN 'Expected ' || page_count || ' pages, found ' || found
                WHEN invalid > 0 THEN invalid || ' blank/invalid page(s): [' ||
                  (SELECT string_agg(CAST(page AS VARCHAR), ', ' ORDER BY page) FROM k WHERE k.book = c.book AND k.lang = c.lang AND rk <= 10) || ']'
                ELSE 'ready' END AS status,
           bool_and(page_count > 0 AND found - invalid = page_count) OVER (PARTITION BY book) AS book_complete
    FROM c""",
)
def language_readiness(inp: Inputs):
    books = inp.derive(dv.host_books).select("book", "page_count", F.array(F.lit("en"), F.lit("fr")).alias("languages"))
    gate = corpus.content_gate(inp.derive(dv.published), ["book", "lang", "page"])
    return library.language_readiness(books, inp.keep(gate.select("book", "lang", "page", "valid"), "gate"))


def _status(d) -> str:
    return f"""SELECT book, CASE n % 4 WHEN 0 THEN 'failed' ELSE 'complete' END AS status, n % 6 = 1 AS running
               FROM ({dv.host_books(d)}) b WHERE book LIKE '%.com'"""


def _index(d) -> str:
    return f"SELECT book, CASE n % 3 WHEN 0 THEN 'archived' WHEN 1 THEN 'done' END AS library_state FROM ({dv.host_books(d)}) b"


def _packages(d) -> str:
    return f"SELECT book FROM ({dv.corpus(d)}) c WHERE url LIKE '%?page=%'"


@job(
    "catalog_enrich",
    lambda d: f"""
    SELECT o.book, o.title, o.page_count, o.page_pdf_done, o.published,
           o.book IN (SELECT book FROM ({_packages(d)}) p) AS has_package, coalesce(s.running, false) AS running,
           coalesce(s.status, 'idle') AS status,
           CASE WHEN i.library_state IN ('active', 'done') THEN i.library_state ELSE coalesce(o.library_state, 'active') END AS library_state
    FROM ({_overview(d)}) o LEFT JOIN ({_status(d)}) s ON s.book = o.book LEFT JOIN ({_index(d)}) i ON i.book = o.book""",
)
def catalog_enrich(inp: Inputs):
    return library.catalog_enrich(
        inp.derive(dv.host_books), overview(inp), inp.derive(_status), inp.derive(_index), inp.derive(_packages)
    )


@job(
    "page_preview",
    lambda d: f"""
    SELECT book, page, coalesce(nullif(trim((CASE WHEN page_pdf THEN 'page-pdf ' ELSE '' END) || (CASE WHEN published THEN 'html' ELSE '' END)), ''), 'pending') AS flags,
           greatest(c - 20, 0) AS more
    FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page) rk, count(*) OVER (PARTITION BY book) c FROM ({_page_flags(d)}) f) q
    WHERE rk <= 20""",
)
def page_preview(inp: Inputs):
    return library.page_preview(inp.derive(_page_flags))


@job(
    "priority_coalesce",
    lambda d: f"""
    SELECT doc_id, CASE WHEN manifest_author <> '' THEN manifest_author
             WHEN trim(document_author) <> '' AND lower(document_author) NOT IN ('unknown', 'none') THEN trim(document_author)
             WHEN slug LIKE '%-by-%' THEN 'S' || substr(source, 2) || ' Press' ELSE 'Unknown' END AS author
    FROM ({dv.authors(d)}) a""",
)
def priority_coalesce(inp: Inputs):
    author = library.author_of(F.col("manifest_author"), F.col("document_author"), F.col("slug"))
    return inp.derive(dv.authors).select("doc_id", author.alias("author"))


def _detect_sql(d) -> str:
    arms = []
    for code, (marks, words) in library.LANGUAGE_MARKERS.items():
        m = f"(length(low) - length(translate(low, '{marks}', '')))"
        w = " + ".join(f"(length(low) - length(replace(low, ' {x} ', ''))) // {len(x) + 2}" for x in words)
        arms.append(f"SELECT doc_id, '{code}' AS code, {m} AS m, {w} AS w FROM t")
    return f"""
    WITH t AS (SELECT doc_id, lower(text) AS low, CASE WHEN lower(declared) = 'vie' THEN 'vi' ELSE string_split(lower(declared), '-')[1] END AS known FROM ({dv.detect_docs(d)}) x),
    s AS ({' UNION ALL '.join(arms)}),
    b AS (SELECT doc_id, arg_max(code, (m + w, code)) AS code FROM s WHERE m >= 5 OR w >= 5 GROUP BY doc_id)
    SELECT t.doc_id, CASE WHEN known IN ('vi', 'fr', 'de', 'es') THEN known ELSE coalesce(b.code, 'en') END AS detected
    FROM t LEFT JOIN b ON b.doc_id = t.doc_id"""


@job("lang_detect", _detect_sql)
def lang_detect(inp: Inputs):
    return library.lang_detect(inp.derive(dv.detect_docs)).select("doc_id", "detected")


def _base(d) -> str:
    return f"SELECT book, page, md5(url) AS entry FROM ({dv.corpus(d)}) c WHERE lang <> 'es'"


def _updates(d) -> str:
    return f"""SELECT book, page, md5(html) AS entry FROM ({dv.rendered(d)}) r WHERE html LIKE '%class="ad2"%' OR html LIKE '%addendum%'"""


def _vanished(d) -> str:
    return f"SELECT book, page FROM ({dv.corpus(d)}) c WHERE url LIKE '%#%'"


@job(
    "keyed_upsert",
    lambda d: f"""
    SELECT * FROM ({_updates(d)}) u UNION ALL
    SELECT b.* FROM ({_base(d)}) b
    WHERE NOT EXISTS (SELECT 1 FROM ({_updates(d)}) u WHERE u.book = b.book AND u.page = b.page)
      AND NOT EXISTS (SELECT 1 FROM ({_vanished(d)}) v WHERE v.book = b.book AND v.page = b.page)""",
)
def keyed_upsert(inp: Inputs):
    """The base is written as the first version of an index, the batch as the second."""
    path = scratch_path(inp.spark, "index")
    base = inp.derive(_base)
    sinks.upsert_index(base, base.limit(0), path, ["book", "page"])
    sinks.upsert_index(inp.derive(_updates), inp.derive(_vanished), path, ["book", "page"])
    return sinks.read_index(inp.spark, path)


@job(
    "partitioned_page_sink",
    lambda d: f"SELECT book, lang, page, md5(html) AS digest FROM ({dv.corpus(d)}) c",
)
def partitioned_page_sink(inp: Inputs):
    path = scratch_path(inp.spark, "pages")
    sinks.write_pages(inp.derive(dv.corpus).select("book", "lang", "page", "html"), path)
    return inp.spark.read.parquet(path).select("book", "lang", "page", F.md5("html").alias("digest"))
