"""Jobs on page text and structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafaudit.functions import text as tx
from leafaudit.operators import corpus, fidelity
from leafaudit.plans import derived as dv
from leafaudit.plans.registry import Inputs, job

KEYS = ["book", "page"]


@job(
    "page_scan",
    lambda d: f"""
    SELECT page AS page_id, {d.extract('path', '/library/([^/]+)/')} AS book,
           {d.extract('path', '/output/([^/]+)/')} AS lang,
           CAST({d.extract('path', 'page_([0-9]+)[.]html$')} AS BIGINT) AS page,
           CAST(strlen(html) AS BIGINT) AS bytes
    FROM ({dv.page_files(d)}) f WHERE {d.matches('path', 'page_[0-9]+[.]html$')}""",
)
def page_scan(inp: Inputs):
    files = inp.derive(dv.page_files).withColumnRenamed("page", "page_id")
    return corpus.page_scan(files).select(
        "page_id", "book", "lang", "page", F.octet_length("html").cast("bigint").alias("bytes")
    )


@job(
    "visible_tokens",
    lambda d: f"SELECT book, page, token, count(*) AS n FROM ({dv.tokens(d, dv.corpus(d))}) t GROUP BY ALL",
)
def visible_tokens(inp: Inputs):
    return corpus.visible_tokens(inp.derive(dv.corpus), KEYS)


def _no_raw(d, expr="html"):
    out = d.replace_all(expr, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style"):
        out = d.replace_all(out, rf"(?is)(<{tag}\b[^>]*>).*?(</{tag}\s*>)", "$1$2")
    return out


def _duck_attrs(raw: str) -> str:
    body = f"regexp_replace({raw}, '^</?[a-zA-Z][^\\s/>]*|/?>$', '', 'g')"
    pat = "([^\\s\"''<>/=]+)(?:\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''<>]+))?"
    ignored = ", ".join(f"'{a}'" for a in tx.IGNORED_ATTRIBUTES)
    return f"""CASE WHEN {raw} LIKE '</%' THEN '' ELSE array_to_string(list_sort(list_transform(list_filter(list_zip(
        regexp_extract_all({body}, '{pat}', 1), regexp_extract_all({body}, '{pat}', 2)),
        lambda p: lower(p[1]) NOT IN ({ignored})),
        lambda p: lower(p[1]) || '=' || replace(regexp_replace(p[2], '^["'']|["'']$', '', 'g'), '&amp;', '&'))), ' ') END"""


def _duck_tags(d, view: str) -> str:
    return f"""
    SELECT book, page, i - 1 AS pos,
           CASE WHEN raw LIKE '</%' THEN 'end' WHEN raw LIKE '%/>' THEN 'startend' ELSE 'start' END AS kind,
           lower(regexp_extract(raw, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS tag, {_duck_attrs('raw')} AS attrs
    FROM (SELECT book, page, unnest(tags) AS raw, generate_subscripts(tags, 1) AS i
          FROM (SELECT book, page, regexp_extract_all({_no_raw(d)}, '</?[a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS tags
                FROM ({view}) v) a) b"""


@job("tag_events", lambda d: f"SELECT * FROM ({_duck_tags(d, dv.corpus(d))}) t")
def tag_events(inp: Inputs):
    events = corpus.tag_events(inp.derive(dv.corpus), KEYS)
    return events.withColumn("attrs", tx.attributes_text(F.col("attrs")))


@job(
    "structure_divergence",
    lambda d: f"""
    WITH a AS ({_duck_tags(d, dv.corpus(d))}), b AS ({_duck_tags(d, dv.rendered(d))}),
    na AS (SELECT book, page, count(*) n FROM a GROUP BY ALL), nb AS (SELECT book, page, count(*) n FROM b GROUP BY ALL),
    x AS (SELECT coalesce(a.book, b.book) book, coalesce(a.page, b.page) page, coalesce(a.pos, b.pos) pos
          FROM a FULL JOIN b ON a.book = b.book AND a.page = b.page AND a.pos = b.pos
          WHERE a.pos IS NULL OR b.pos IS NULL OR a.kind <> b.kind OR a.tag <> b.tag OR a.attrs <> b.attrs)
    SELECT x.book, x.page, CAST(min(pos) AS BIGINT) AS first_diff, any_value(na.n) AS source_len, any_value(nb.n) AS translated_len
    FROM x JOIN na ON x.book = na.book AND x.page = na.page JOIN nb ON x.book = nb.book AND x.page = nb.page
    GROUP BY x.book, x.page""",
)
def structure_divergence(inp: Inputs):
    return fidelity.structure_divergence(inp.derive(dv.corpus), inp.derive(dv.rendered), KEYS)


def _loss(d) -> str:
    return f"""
    SELECT book, page, token, count(*) AS missing FROM (
      SELECT * FROM (SELECT s.* FROM ({dv.tokens(d, dv.corpus(d))}) s
                     WHERE EXISTS (SELECT 1 FROM ({dv.rendered(d)}) r WHERE r.book = s.book AND r.page = s.page)) s
      EXCEPT ALL SELECT * FROM ({dv.tokens(d, dv.rendered(d))}) r) m GROUP BY ALL"""


@job("token_loss", _loss)
def token_loss(inp: Inputs):
    return fidelity.token_loss(inp.derive(dv.corpus), inp.derive(dv.rendered), KEYS)


@job(
    "top_missing_tokens",
    lambda d: f"""
    WITH m AS ({_loss(d)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY missing DESC, token COLLATE "C") AS rk FROM m)
    SELECT book, page, CAST(sum(missing) AS BIGINT) AS total_missing,
           string_agg(CASE WHEN missing > 1 THEN token || '×' || missing ELSE token END, ', ' ORDER BY rk)
             FILTER (WHERE rk <= 20) AS missing_text
    FROM r GROUP BY book, page""".replace(' COLLATE "C"', ""),
)
def top_missing_tokens(inp: Inputs):
    loss = fidelity.token_loss(inp.derive(dv.corpus), inp.derive(dv.rendered), KEYS)
    return fidelity.top_missing_tokens(loss, KEYS)


def gate_sql(d) -> str:
    return f"""
    SELECT book, page, has_shell, has_article, has_marker, has_content,
           has_shell AND has_article AND NOT has_marker AND has_content AS valid
    FROM (SELECT book, page, lower(html) LIKE '%<main%' AND lower(html) LIKE '%book-page%' AS has_shell,
                 lower(html) LIKE '%<article%' AS has_article, lower(html) LIKE '%pdf-render%' AS has_marker,
                 html NOT LIKE '%<article hidden%' AND regexp_matches(
                   {dv.visible_text(d, "regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), '&(#160|#xA0|emsp|mdash);', ' ', 'g')")},
                   '[\\p{{L}}\\p{{N}}]') AS has_content
          FROM ({dv.published(d)}) p) q"""


@job("content_gate", gate_sql)
def content_gate(inp: Inputs):
    return corpus.content_gate(inp.derive(dv.published), KEYS)


@job(
    "lint_rules",
    lambda d: f"""
    WITH p AS (SELECT p.book, p.lang, p.page, p.html, c.foot_left,
                      regexp_extract(p.html, '(?s)<header class="running-head">(.*?)</header>', 1) AS head
               FROM ({dv.published(d)}) p LEFT JOIN ({dv.book_chrome(d)}) c ON p.book = c.book)
    SELECT book, lang, page, rule, message FROM (
      SELECT *, 'legacy_footer' AS rule, 'use .book-footer not .page-copyright' AS message FROM p WHERE html LIKE '%page-copyright%'
      UNION ALL SELECT *, 'heading_full_stop', 'h3.section-title ending with ''.'' needs a run-in heading' FROM p
        WHERE regexp_matches(html, '<h3 class="section-title">[^<]+\\.</h3>')
      UNION ALL SELECT *, 'ascii_figure', 'ascii-figure must be an extracted figure' FROM p WHERE html LIKE '%ascii-figure%'
      UNION ALL SELECT *, 'caption_below_code', 'listing caption must be above code' FROM p
        WHERE regexp_matches(html, '(?s)<figure class="listing">.*?<pre class="code-block">.*?</pre>\\s*<figcaption>')
      UNION ALL SELECT *, 'author_in_head', 'author in running-head (belongs in footer)' FROM p
        WHERE foot_left <> '' AND head <> '' AND contains(head, foot_left)
      UNION ALL SELECT *, 'figure_stylesheet', 'link figures-page.css for diagrams' FROM p
        WHERE html LIKE '%figure class="diagram"%' AND html NOT LIKE '%figures-page.css%'
      UNION ALL SELECT *, 'code_stylesheet', 'link code-page.css for code' FROM p
        WHERE html LIKE '%code-block%' AND html NOT LIKE '%code-page.css%'
      UNION ALL SELECT *, 'forbidden_marker', 'forbidden pdf-render marker' FROM p WHERE html LIKE '%pdf-render%'
      UNION ALL SELECT *, 'sheet_shell', 'missing main.book-page.book-page--sheet shell' FROM p
        WHERE html LIKE '%<main%' AND html NOT LIKE '%book-page--sheet%') x""",
)
def lint_rules(inp: Inputs):
    pages = inp.derive(dv.published).join(inp.derive(dv.book_chrome).select("book", "foot_left"), "book", "left")
    return corpus.lint_rules(pages, ["book", "lang", "page"])


@job("language_union", lambda d: f"SELECT DISTINCT lang FROM ({dv.corpus(d)}) c")
def language_union(inp: Inputs):
    return inp.derive(dv.corpus).select("lang").distinct()
