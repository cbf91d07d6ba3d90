"""Jobs on chunks, pagination and assembled books."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafaudit.operators import assembly, corpus
from leafaudit.plans import derived as dv
from leafaudit.plans.registry import Inputs, job

KEYS = ["book", "lang"]


def _chunks(d, view=dv.corpus, size: int = 40) -> str:
    return f"""SELECT *, CAST(floor((row_number() OVER (PARTITION BY book, lang ORDER BY page) - 1) / {size}) AS BIGINT) AS chunk FROM ({view(d)}) v"""


@job(
    "fixed_chunks",
    lambda d: f"""SELECT book, lang, chunk, count(*) AS pages, min(page) AS first_page, max(page) AS last_page
                  FROM ({_chunks(d, size=5)}) c GROUP BY book, lang, chunk""",
)
def fixed_chunks(inp: Inputs):
    pages = inp.derive(dv.corpus).select(*KEYS, "page")
    return assembly.chunk_ranges(assembly.fixed_chunks(pages, KEYS, 5), KEYS)


@job(
    "column_rebalance",
    lambda d: f"""
    SELECT source, doc_id, CASE WHEN n >= 6 THEN CAST(floor((rn - 1) / floor((n + 2) / 3)) + 1 AS BIGINT) END AS "column"
    FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) rn, count(*) OVER (PARTITION BY source) n FROM documents) q""",
)
def column_rebalance(inp: Inputs):
    return assembly.column_rebalance(inp.table("documents").select("source", "doc_id"), ["source"], "doc_id")


def _blocks(d) -> str:
    """Blocks from the given paragraphs themselves and what each kind of page makes of them."""
    count = lambda x: f"len(regexp_extract_all(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '[a-zA-Z'']+'))"
    weight = lambda n: f"CASE WHEN {n} = 0 THEN 0 ELSE CAST(ceil(({n}) / 10.5) AS INTEGER) * 10 + 2 END"
    group = lambda w: f"CASE WHEN {w} = 0 THEN 10 ELSE {w} END"
    return f"""
    SELECT book, page, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM (
      SELECT book, page, list_prepend(20, CASE page % 6 WHEN 0 THEN list_transform(ns, lambda n: {group(weight('n'))}) WHEN 1 THEN list_transform(ns, lambda n: {weight('n')})
               WHEN 2 THEN CASE WHEN len(ns) = 0 THEN [] ELSE [{weight('list_sum(ns)')}] END
               WHEN 3 THEN list_transform(ns, lambda n: {weight('n + 1')})
               WHEN 4 THEN [coalesce(list_sum(list_transform(ns, lambda n: {group(weight('n'))})), 10)]
               ELSE list_transform(ns, lambda n: {weight('n')} + 12) END) AS ws
      FROM (SELECT book, page, list_transform(string_split(a, '<p>')[2:], lambda x: {count('x')}) AS ns
            FROM (SELECT book, page, regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), '</?(b|br)>|</p>', ' ', 'g') AS a FROM ({dv.corpus(d)}) c) x) y) z"""


@job(
    "greedy_pagination",
    lambda d: f"""
    WITH RECURSIVE b AS MATERIALIZED (SELECT * FROM ({_blocks(d)}) b WHERE true),
    r AS (SELECT book, page, n, w, 1 AS sheet, w AS used FROM b WHERE n = 1
          UNION ALL
          SELECT b.book, b.page, b.n, b.w, CASE WHEN r.used + b.w > 320 THEN r.sheet + 1 ELSE r.sheet END,
                 CASE WHEN r.used + b.w > 320 THEN b.w ELSE r.used + b.w END
          FROM r JOIN b ON b.book = r.book AND b.page = r.page AND b.n = r.n + 1)
    SELECT book, page, CAST(n - 1 AS BIGINT) AS block, CAST(w AS INTEGER) AS weight, CAST(sheet AS INTEGER) AS sheet FROM r""",
)
def greedy_pagination(inp: Inputs):
    return assembly.greedy_pagination(inp.derive(dv.paginated), ["book", "page"])


def _gate(d) -> str:
    return f"SELECT book, lang, page, html NOT LIKE '%pdf-render%' AS valid FROM ({dv.assembly_pages(d)}) p"


def _section(d) -> str:
    body = "replace(trim(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), ' ' || chr(9) || chr(10) || chr(13)), '../assets/', 'assets/')"
    return f"""'<section class="book-sheet" id="page-' || printf('%04d', page) || '" data-page="' || page || '">' || chr(10)
      || '  <main class="book-page book-page--sheet">' || chr(10) || '    <article class="sheet-flow prose-page">' || chr(10)
      || {body} || chr(10) || '    </article>' || chr(10) || '  </main>' || chr(10) || '</section>'"""


@job(
    "book_assembly",
    lambda d: f"""
    SELECT book, lang, chunk, count(*) AS pages, min(page) AS first_page, max(page) AS last_page,
           md5(string_agg({_section(d)}, chr(10) ORDER BY page)) AS digest
    FROM ({_chunks(d, dv.assembly_pages)}) c
    WHERE NOT EXISTS (SELECT 1 FROM ({_gate(d)}) g WHERE g.book = c.book AND g.lang = c.lang AND NOT g.valid)
    GROUP BY book, lang, chunk""",
)
def book_assembly(inp: Inputs):
    pages = inp.derive(dv.assembly_pages)
    gate = inp.keep(corpus.content_gate(pages, ["book", "lang", "page"]).select("book", "lang", "page", "valid"), "gate")
    return assembly.book_assembly(pages, gate).withColumn("digest", F.md5("html")).drop("html")


@job(
    "lint_assembled",
    lambda d: f"SELECT book, lang, page, 'prose_stylesheet' AS rule FROM ({dv.assembly_pages(d)}) p WHERE html NOT LIKE '%prose-page.css%' "
    f"UNION ALL SELECT book, lang, page, 'sheet_article' FROM ({dv.assembly_pages(d)}) p",
)
def lint_assembled(inp: Inputs):
    return corpus.lint_assembled(inp.derive(dv.assembly_pages), ["book", "lang", "page"]).drop("message")
