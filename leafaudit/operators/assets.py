"""Asset references: extraction, gaps, URL lint and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafaudit.functions import paths as px

# Fixed values of the image URL contract.
PAGE_PREFIX = "../assets/"
BOOK_PREFIX = "assets/"
VALID_IMAGE = r"^(\.\./assets/|assets/)images/[a-zA-Z0-9_./-]+\.(png|jpg|jpeg|gif|webp|svg)$"


def _found(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def _style_text(html: Column) -> Column:
    """CSS text of a page: style elements and style attributes."""
    blocks = _found(html, r"(?is)<style\b[^>]*>(.*?)</style>")
    inline = _found(html, r"""(?is)\sstyle\s*=\s*("[^"]*"|'[^']*')""")
    return F.array_join(F.concat(blocks, F.transform(inline, lambda s: F.substring(s, F.lit(2), F.length(s) - 2))), "\n")


def page_references(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Distinct (kind, ref) per page: stylesheet links, image-like sources and scripts."""
    t = F.col(html)
    css = _found(t, r"""(?i)<link\s+[^>]*href=["']([^"']+)["']""")
    js = _found(t, r"""(?i)<script\s+[^>]*src=["']([^"']+)["']""")
    sets = F.flatten(
        F.transform(
            _found(t, r"""(?i)<(?:source|img)\s+[^>]*srcset=["']([^"']+)["']"""),
            lambda v: F.filter(
                F.transform(F.split(v, ","), lambda c: F.regexp_extract(c, r"^\s*(\S+)", 1)), lambda c: c != ""
            ),
        )
    )
    images = F.transform(
        F.concat(
            _found(t, r"""(?i)<img\s+[^>]*src=["']([^"']+)["']"""),
            _found(t, r"""(?i)<(?:video|object)\s+[^>]*(?:poster|data)=["']([^"']+)["']"""),
            _found(_style_text(t), r"""(?i)url\(\s*["']?([^"')]+)["']?\s*\)"""),
            sets,
        ),
        lambda r: F.trim(r),
    )
    tagged = lambda arr, kind: F.transform(
        F.array_distinct(arr), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref"))
    )
    return pages.select(*keys, F.inline(F.concat(tagged(css, "css"), tagged(images, "image"), tagged(js, "js"))))


def asset_gaps(
    pages: DataFrame,
    inventory: DataFrame,
    keys: list[str],
    *,
    base_dir: str = "base_dir",
    ignore_page_figures: bool = False,
) -> DataFrame:
    """Local references that are missing, empty or contain a raw blank.

    inventory(path, size). Paths are made distinct before they meet the inventory,
    so an asset used by every page is looked up once; page rows then join only the
    faulty paths."""
    refs = page_references(pages, [*keys, base_dir]).filter(px.is_local(F.col("ref")))
    refs = refs.withColumn("clean", px.clean_url(F.col("ref")))
    if ignore_page_figures:
        dynamic = F.lower("clean").contains("_fig_") & px.base_name(F.col("clean")).startswith("page_")
        refs = refs.filter(~((F.col("kind") == "image") & dynamic))
    refs = refs.withColumn("path", px.resolve(F.col(base_dir), F.col("clean"))).drop("clean", base_dir)
    faulty = (
        refs.select("path")
        .distinct()
        .join(inventory.select("path", "size"), "path", "left")
        .filter("size is null or size = 0")
        .select("path", F.when(F.col("size").isNull(), "missing").otherwise("empty").alias("problem"))
    )
    blanks = refs.filter(F.col("ref").contains(" ")).select(*keys, "kind", "ref", F.lit("raw blank").alias("problem"))
    gaps = refs.join(faulty, "path").select(*keys, "kind", "ref", "problem")
    return gaps.unionByName(blanks)


def image_src_lint(pages: DataFrame, inventory: DataFrame, keys: list[str], *, context: str = "per-page") -> DataFrame:
    """Image URLs outside the allowed pattern, with the wrong prefix, or without a file.

    pages carries out_dir (the book's output folder) and lang."""
    srcs = _found(F.col("html"), r"""(?is)<img\s+[^>]*\bsrc\s*=\s*("[^"]*"|'[^']*')""")
    refs = pages.select(
        *keys, "out_dir", "lang", F.explode(F.array_distinct(F.transform(srcs, lambda s: F.substring(s, F.lit(2), F.length(s) - 2)))).alias("src")
    )
    src = F.col("src")
    if context == "per-page":
        wrong = ~src.startswith(PAGE_PREFIX)
        message = "per-page HTML must use ../assets/"
    else:
        wrong = src.startswith("../")
        message = "assembled book must use assets/ not ../assets/"
    refs = refs.withColumn(
        "issue",
        F.when(~src.rlike(VALID_IMAGE), F.lit("invalid img src")).when(wrong, F.lit(message)),
    )
    bad = refs.filter("issue is not null").select(*keys, "src", "issue")
    target = F.concat(F.col("out_dir"), F.lit("/"), F.regexp_replace(src, r"^\.\./", ""))
    checked = refs.filter("issue is null").withColumn("path", target)
    absent = checked.select("path").distinct().join(inventory.select("path"), "path", "left_anti")
    missing = checked.join(absent, "path", "left_semi").select(*keys, "src", F.lit("missing image file").alias("issue"))
    return bad.unionByName(missing)


def stale_artifacts(sources: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Sources whose derived artifact is older or absent; both sides carry mtime."""
    d = derived.select(*keys, F.col("mtime").alias("derived_mtime"))
    return (
        sources.select(*keys, F.col("mtime").alias("source_mtime"))
        .join(d, keys, "left")
        .filter("derived_mtime is null or derived_mtime < source_mtime")
        .withColumn("reason", F.when(F.col("derived_mtime").isNull(), "missing").otherwise("older"))
    )
