"""Idempotent page rewrites: asset prefixes and layout normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafaudit.operators.assets import BOOK_PREFIX, PAGE_PREFIX

# Page classes that keep their own running head and footer.
FRONT_MATTER = (
    r'(?i)class="[^"]*\b(?:title-page|cover|flap|toc|copy|ded|preface-page|chapter-page|'
    r"chapter-body-page|manning-chapter-opener)\b"
)
CHAPTER_PAGE = r"(?i)\bchapter-(?:body-)?page\b"
INDEX_PAGE = r"(?i)\bindex-page\b"


def page_asset_urls(html: Column) -> Column:
    """Point bare assets/ URLs of a per-page document at ../assets/."""
    out = F.regexp_replace(html, r"""((?i:\b(?:src|href|poster|data)\s*=\s*)["'])assets/""", "$1" + PAGE_PREFIX)
    for q in ('"', "'"):
        # first candidate of a srcset value, then every following one from the last match on
        candidate = rf"(?i)(\bsrcset\s*=\s*{q}(?:[^{q}]*?,\s*)??|(?!^)\G[^{q}]*?,\s*)assets/"
        out = F.regexp_replace(out, candidate, "$1" + PAGE_PREFIX)
    return F.regexp_replace(out, r"""(?i)(url\(\s*["']?)assets/""", "$1" + PAGE_PREFIX)


def book_asset_urls(html: Column) -> Column:
    """The reverse mapping, for text that moves into an assembled document."""
    return F.replace(html, F.lit(PAGE_PREFIX), F.lit(BOOK_PREFIX))


def asset_url_rewrite(pages: DataFrame, html: str = "html", *, assembled: bool = False) -> DataFrame:
    new = book_asset_urls(F.col(html)) if assembled else page_asset_urls(F.col(html))
    return pages.withColumn("_new", new).withColumn("changed", F.col("_new") != F.col(html)).drop(html).withColumnRenamed(
        "_new", html
    )


def _literal(text: Column) -> Column:
    """Escape text for use as a regular-expression replacement."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def _running_head(html: Column, left: Column, page: Column) -> Column:
    new = F.concat(
        F.lit("$1"),
        F.lit('<header class="running-head">\n        <span class="rh-left">'),
        _literal(left),
        F.lit('</span>\n        <span class="rh-center"></span>\n        <span class="rh-right">'),
        page.cast("string"),
        F.lit("</span>\n      </header>"),
    )
    return F.regexp_replace(html, F.lit(r'(?s)^(.*?)<header class="running-head">.*?</header>'), new)


def _footer(html: Column, left: Column, right: Column) -> Column:
    block = F.concat(
        F.lit('<footer class="book-footer">\n        <span>'), left,
        F.lit("</span>\n        <span>"), right, F.lit("</span>\n      </footer>"),
    )
    swapped = F.regexp_replace(html, F.lit(r'(?s)<footer class="page-copyright">.*?</footer>'), _literal(block))
    inserted = F.regexp_replace(
        swapped, F.lit(r"(?s)^(.*?)</article>"), F.concat(F.lit("$1      "), _literal(block), F.lit("\n    </article>"))
    )
    return F.when((left == "") & (right == ""), html).otherwise(
        F.when(~swapped.contains("book-footer") & (left != ""), inserted).otherwise(swapped)
    )


RUN_IN = r'(?s)<h3 class="section-title">\s*([^<]*?\.)</h3>\s*<p(?:\s[^>]*)?>\s*(.*?)\s*</p>'


def _run_in_headings(html: Column) -> Column:
    """Repeat the rewrite as often as the page has such headings, which reaches the
    fixpoint even where headings are stacked on each other."""
    rounds = F.size(F.regexp_extract_all(html, F.lit(r'<h3 class="section-title">[^<]+\.</h3>'), F.lit(0)))
    steps = F.when(rounds > 0, F.sequence(F.lit(1), rounds)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        steps,
        html,
        lambda h, _: F.regexp_replace(h, RUN_IN, '<p class="no-indent"><strong class="run-in">$1</strong> $2</p>'),
    )


def layout_normalize(pages: DataFrame, *, html: str = "html", page: str = "page") -> DataFrame:
    """Running head, footer, run-in headings, listing captions and unlabelled code.

    pages already carries head_left, foot_left, foot_right of its book."""
    text = F.col(html)
    exempt = text.rlike(FRONT_MATTER) | text.rlike(CHAPTER_PAGE) | text.rlike(INDEX_PAGE)
    chrome = {c: F.coalesce(F.col(c), F.lit("")) for c in ("head_left", "foot_left", "foot_right")}
    staged = pages.withColumn(
        "_h", F.when(exempt, text).otherwise(_running_head(text, chrome["head_left"], F.col(page)))
    ).withColumn("_h", F.when(exempt, F.col("_h")).otherwise(_footer(F.col("_h"), chrome["foot_left"], chrome["foot_right"])))
    new = _run_in_headings(F.col("_h"))
    new = F.regexp_replace(
        new,
        r'<figure class="diagram">\s*<figcaption>(Listing \d+-\d+)<br>([^<]+)</figcaption>\s*<pre class="code-block">',
        '<figure class="listing"><figcaption><strong>$1</strong><br>$2</figcaption><pre class="code-block">',
    )
    new = F.regexp_replace(
        new, r'<figure class="diagram">\s*<pre class="code-block">', '<figure class="code-snippet"><pre class="code-block">'
    )
    return (
        staged.withColumn("_h", new)
        .withColumn("changed", F.col("_h") != F.col(html))
        .drop(html)
        .withColumnRenamed("_h", html)
    )
