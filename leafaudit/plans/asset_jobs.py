"""Jobs on asset references and page rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafaudit.operators import assets, rewrite
from leafaudit.plans import derived as dv
from leafaudit.plans.registry import Inputs, job

PAGE = ["book", "lang", "page"]



def _asset_refs(d) -> str:
    return f"""
    SELECT book, lang, page, 'css' AS kind, '../assets/' || name || '.css?v=2' AS ref, name || '.css' AS f
      FROM ({dv.asset_names(d)}) n WHERE page % 4 = 0
    UNION ALL SELECT book, lang, page, 'image', '../assets/images/' || name || '.png', 'images/' || name || '.png'
      FROM ({dv.asset_names(d)}) n WHERE page % 4 = 1
    UNION ALL SELECT book, lang, page, 'js', '../assets/' || name || '.js#x', name || '.js'
      FROM ({dv.asset_names(d)}) n WHERE page % 4 = 2
    UNION ALL SELECT book, lang, page, 'image', c, replace(substr(c, 11), '%20', ' ')
      FROM (SELECT book, lang, page, unnest(list_transform(string_split(
              '../assets/images/' || name || '.png 1x, ../assets/images/hi%20res/' || name || '.png 2x', ','),
              lambda c: string_split(trim(c), ' ')[1])) AS c
            FROM ({dv.asset_names(d)}) n WHERE page % 4 = 3) s WHERE c <> ''"""


@job(
    "asset_gaps",
    lambda d: f"""
    WITH r AS (SELECT DISTINCT * FROM ({_asset_refs(d)}) x),
         i AS (SELECT * FROM ({dv.inventory(d)}) y)
    SELECT book, lang, page, kind, ref, CASE WHEN i.size IS NULL THEN 'missing' ELSE 'empty' END AS problem
    FROM (SELECT *, CASE WHEN starts_with(ref, '../') THEN '/library/' || book || '/output/assets/' || f
                    ELSE '/library/' || book || '/output/' || lang || '/' || ref END AS path FROM r) r
    LEFT JOIN i ON i.path = r.path
    WHERE i.size IS NULL OR i.size = 0""",
)
def asset_gaps(inp: Inputs):
    return assets.asset_gaps(inp.derive(dv.asset_pages), inp.derive(dv.inventory), PAGE)


@job(
    "image_src_lint",
    lambda d: f"""
    WITH s AS (SELECT DISTINCT book, lang, page, src FROM (
                 SELECT book, lang, page, '../assets/images/' || name || '.png' AS src FROM ({dv.asset_names(d)}) n WHERE page % 4 = 1
                 UNION ALL SELECT book, lang, page, 'https://cdn.example.com/' || name || '.png' FROM ({dv.asset_names(d)}) n WHERE page % 4 = 1) u),
         i AS (SELECT path FROM ({dv.inventory(d)}) y)
    SELECT book, lang, page, src,
           CASE WHEN NOT ok THEN 'invalid img src' ELSE 'missing image file' END AS issue
    FROM (SELECT *, regexp_matches(src, '^(\\.\\./assets/|assets/)images/[a-zA-Z0-9_./-]+\\.(png|jpg|jpeg|gif|webp|svg)$') AS ok,
                 '/library/' || book || '/output/' || substr(src, 4) AS path FROM s) q
    WHERE NOT ok OR path NOT IN (SELECT path FROM i)""",
)
def image_src_lint(inp: Inputs):
    return assets.image_src_lint(inp.derive(dv.asset_pages), inp.derive(dv.inventory), PAGE)


def _duck_urls(expr: str) -> str:
    out = f"""regexp_replace({expr}, '((?i:\\b(?:src|href|poster|data)\\s*=\\s*)["''])assets/', '\\1../assets/', 'g')"""
    for _ in range(4):
        out = f"""regexp_replace({out}, '(?i)(\\bsrcset\\s*=\\s*"(?:[^"]*,\\s*)?)assets/', '\\1../assets/', 'g')"""
    return f"""regexp_replace({out}, '(?i)(url\\(\\s*["'']?)assets/', '\\1../assets/', 'g')"""


@job(
    "asset_url_rewrite",
    lambda d: f"""
    SELECT book, page, n <> html AS changed, md5(n) AS digest
    FROM (SELECT *, {_duck_urls('html')} AS n FROM ({dv.rewrite_pages(d)}) p) q""",
)
def asset_url_rewrite(inp: Inputs):
    out = rewrite.asset_url_rewrite(inp.derive(dv.rewrite_pages))
    return out.select("book", "page", "changed", F.md5("html").alias("digest"))


@job(
    "asset_url_assembled",
    lambda d: f"""
    SELECT book, page, n <> html AS changed, md5(n) AS digest
    FROM (SELECT *, replace(html, '../assets/', 'assets/') AS n FROM ({dv.rewrite_pages(d)}) p) q""",
)
def asset_url_assembled(inp: Inputs):
    out = rewrite.asset_url_rewrite(inp.derive(dv.rewrite_pages), assembled=True)
    return out.select("book", "page", "changed", F.md5("html").alias("digest"))


def _normalised(d) -> str:
    head = """regexp_replace(html, '(?s)<header class="running-head">.*?</header>',
        '<header class="running-head">' || chr(10) || '        <span class="rh-left">' || head_left || '</span>' || chr(10)
        || '        <span class="rh-center"></span>' || chr(10) || '        <span class="rh-right">' || page || '</span>' || chr(10)
        || '      </header>')"""
    foot = """'<footer class="book-footer">' || chr(10) || '        <span>' || foot_left || '</span>' || chr(10)
        || '        <span>' || foot_right || '</span>' || chr(10) || '      </footer>'"""
    run_in = "h3"
    for _ in range(3):
        run_in = f"""regexp_replace({run_in}, '(?s)<h3 class="section-title">\\s*([^<]*?\\.)</h3>\\s*<p(?:\\s[^>]*)?>\\s*(.*?)\\s*</p>',
            '<p class="no-indent"><strong class="run-in">\\1</strong> \\2</p>', 'g')"""
    return f"""
    WITH p AS (SELECT p.*, c.head_left, c.foot_left, c.foot_right FROM ({dv.published(d)}) p
               JOIN ({dv.book_chrome(d)}) c ON p.book = c.book),
    a AS (SELECT *, {head} AS h1, {foot} AS foot FROM p),
    b AS (SELECT *, regexp_replace(h1, '(?s)<footer class="page-copyright">.*?</footer>', foot, 'g') AS h2 FROM a),
    c AS (SELECT *, CASE WHEN h2 NOT LIKE '%book-footer%' AND foot_left <> ''
                    THEN regexp_replace(h2, '</article>', '      ' || foot || chr(10) || '    </article>') ELSE h2 END AS h3 FROM b),
    e AS (SELECT *, {run_in} AS h4 FROM c)
    SELECT book, page, h5 <> html AS changed, md5(h5) AS digest FROM (
      SELECT *, regexp_replace(h4, '<figure class="diagram">\\s*<pre class="code-block">',
                '<figure class="code-snippet"><pre class="code-block">', 'g') AS h5 FROM e) f"""


@job("layout_normalize", _normalised)
def layout_normalize(inp: Inputs):
    pages = inp.derive(dv.published).join(inp.derive(dv.book_chrome), "book", "left")
    return rewrite.layout_normalize(pages).select("book", "page", "changed", F.md5("html").alias("digest"))


def _source_times(d) -> str:
    return f"SELECT book, page, page * 7 % 1000 AS mtime FROM ({dv.corpus(d)}) c"


def _derived_times(d) -> str:
    return f"SELECT book, page, page * 13 % 1000 AS mtime FROM ({dv.rendered(d)}) c"


@job(
    "stale_artifacts",
    lambda d: f"""
    SELECT s.book, s.page, s.mtime AS source_mtime, t.mtime AS derived_mtime,
           CASE WHEN t.mtime IS NULL THEN 'missing' ELSE 'older' END AS reason
    FROM ({_source_times(d)}) s LEFT JOIN ({_derived_times(d)}) t ON s.book = t.book AND s.page = t.page
    WHERE t.mtime IS NULL OR t.mtime < s.mtime""",
)
def stale_artifacts(inp: Inputs):
    return assets.stale_artifacts(inp.derive(_source_times), inp.derive(_derived_times), ["book", "page"])
