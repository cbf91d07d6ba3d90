"""Chunks, pagination, column layout and book assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafaudit.functions import text as tx
from leafaudit.functions.text import page_key, strip
from leafaudit.operators.ordered import by_width, ordered_columns
from leafaudit.operators.rewrite import book_asset_urls

# Fixed values of the sheet layout; weights are tenths of a line.
SHEET_LINES = 320
HEADING_WEIGHT = 20
FIGURE_WEIGHT = 60
CHROME_CLASS = r"""(?i)\sclass\s*=\s*["']?[^"'>]*(running-head|book-footer)"""
CHILDLESS = ["img", "br", "hr", "input", "meta", "link", "base", "col", "embed"]
APOSTROPHE = r"&(#39|#x27|apos);"
REFERENCE = r"&#?[a-zA-Z0-9]+;"
LEAD_TAG = "x-lead"
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def fixed_chunks(pages: DataFrame, keys: list[str], size: int = 40, page: str = "page") -> DataFrame:
    """Number ordered pages into parts of `size`, with the part number from 0."""
    ranked = ordered_columns(pages, keys, [page], by_width(page), rank="_rn")
    return ranked.withColumn("chunk", F.floor((F.col("_rn") - 1) / size).cast("bigint")).drop("_rn")


def chunk_ranges(chunked: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    return chunked.groupBy(*keys, "chunk").agg(
        F.count("*").alias("pages"), F.min(page).alias("first_page"), F.max(page).alias("last_page")
    )


def column_rebalance(entries: DataFrame, keys: list[str], order: str, columns: int = 3, least: int = 6) -> DataFrame:
    """Column 1..n of each ordered entry with ceil(n / columns) entries per column."""
    total = entries.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = ordered_columns(entries, keys, [order], by_width(order), rank="_rn").join(total, keys)
    per = F.floor((F.col("_n") + columns - 1) / columns)
    return ranked.withColumn(
        "column", F.when(F.col("_n") >= least, F.floor((F.col("_rn") - 1) / per) + 1).cast("bigint")
    ).drop("_rn", "_n")


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _events(body: Column) -> Column:
    """Tags in order, each with what its element is and with the text behind it."""

    def part(event: Column) -> Column:
        return _let(F.regexp_extract(event, tx.TAG, 0), lambda raw: F.struct(raw.alias("raw"), tx.tag_name(raw).alias("tag"), F.substring(event, F.length(raw) + 1, F.length(event)).alias("text")))

    def shape(event: Column) -> Column:
        raw, tag, text = event["raw"], event["tag"], event["text"]
        spoken = F.when(text.contains("&"), F.regexp_replace(F.regexp_replace(text, APOSTROPHE, "'"), REFERENCE, " ")).otherwise(text)
        chrome = tag.isin("header", "footer") | (raw.contains("-") & raw.rlike(CHROME_CLASS))
        kind = F.when(chrome, "chrome").when(tag.isin("p", "li"), "prose").when(tag.isin(*HEADINGS), "heading")
        broken = text.contains("\n")
        return F.struct(
            tag.alias("tag"),
            F.when(tag == LEAD_TAG, "lead").when(raw.startswith("</"), "end").when(raw.endswith("/>") | tag.isin(*CHILDLESS), "whole").otherwise("start").alias("step"),
            kind.when(tag.isin("figure", "table", "img"), "figure").when(tag == "pre", "code").otherwise("group").alias("kind"),
            F.when(text == "", 0).otherwise(F.size(F.regexp_extract_all(spoken, F.lit(r"[a-zA-Z']+"), F.lit(0)))).alias("words"),
            ((text != "") & text.rlike(r"\S")).alias("full"),
            F.when(broken, _newlines(text)).otherwise(0).alias("lines"),
            F.when(broken, _newlines(F.regexp_extract(text, r"^\s*", 0))).otherwise(0).alias("before"),
            F.when(broken, _newlines(F.regexp_extract(text, r"\s*$", 0))).otherwise(0).alias("after"),
        )

    led = F.concat(F.lit(f"<{LEAD_TAG}/>"), tx.without_raw_text(body))
    return F.transform(F.transform(F.regexp_extract_all(led, F.lit(tx.TAG_WITH_TEXT), F.lit(0)), part), shape)


def _weight_after(total: Column, words: Column, lines: Column, kind: Column, since: Column, words_since: Column) -> Column:
    """The running weight after an element ends: its own weight replaces that of its children."""
    said, inner = words - words_since, total - since
    own = (
        F.when(kind == "chrome", 0)
        .when(kind == "prose", F.when(said == 0, 0).otherwise(F.ceil(said / 10.5).cast("int") * 10 + 2))
        .when(kind == "heading", HEADING_WEIGHT)
        .when(kind == "figure", FIGURE_WEIGHT)
        .when(kind == "code", (lines + 1) * 15 + 20)
        .otherwise(F.when(inner == 0, 10).otherwise(inner))
    )
    return since + own


FRAMES = "array<struct<tag:string,kind:string,weight:int,words:int>>"
FOLD_START = {
    "open": f"CAST(array() AS {FRAMES})", "weight": "0", "words": "0", "lines": "0", "blank": "0", "begun": "false",
    "recent": "CAST(array() AS array<int>)", "done": "CAST(array() AS array<array<int>>)",
}


def block_weights(body: Column) -> Column:
    """Weights of the blocks of a page, in tenths of lines: its top elements, and text between them.

    One fold over the page's tags with the open elements, innermost first, as its stack. An
    end tag closes its nearest open element and what is still open inside it; one without an
    open element is ignored; what is open at the end is closed then. An element without a
    weight of its own (a list, section, quotation or span) weighs what it holds, at any
    depth, and one line if that is nothing; a list item counts all its words, those of lists
    inside it too. Headers and footers weigh nothing and are no blocks on top, nor are comments."""

    def with_block(s: Column, when: Column, weight: Column) -> list[Column]:
        # Parts of 256 weights, so that adding one never copies all that came before.
        turn = F.size(s["recent"]) >= 256
        return [
            F.when(when & turn, F.array(weight)).when(when, F.array_append(s["recent"], weight)).otherwise(s["recent"]).alias("recent"),
            F.when(when & turn, F.array_append(s["done"], s["recent"])).otherwise(s["done"]).alias("done"),
        ]

    def ended(s: Column, depth: Column) -> Column:
        """Close the `depth` innermost elements."""
        total = F.aggregate(F.slice(s["open"], F.lit(1), depth), s["weight"], lambda w, f: _weight_after(w, s["words"], s["lines"], f["kind"], f["weight"], f["words"]))
        outer = F.element_at(s["open"], -1)

        def leave(weight: Column) -> Column:
            top = (depth == F.size(s["open"])) & (outer["kind"] != "chrome")
            rest = F.filter(s["open"], lambda f, i: i >= depth)
            return F.struct(rest.alias("open"), weight.alias("weight"), *[s[c].alias(c) for c in ("words", "lines", "blank", "begun")], *with_block(s, top, weight - outer["weight"]))

        return _let(total, leave)

    def started(s: Column, e: Column) -> Column:
        frame = F.struct(e["tag"].alias("tag"), e["kind"].alias("kind"), s["weight"].alias("weight"), s["words"].alias("words"))
        fresh = (e["kind"] == "code") & ~F.exists(s["open"], lambda f: f["kind"] == "code")
        return F.struct(
            F.concat(F.array(frame), s["open"]).alias("open"), s["weight"].alias("weight"), s["words"].alias("words"),
            F.when(fresh, 0).otherwise(s["lines"]).alias("lines"), F.when(fresh, 0).otherwise(s["blank"]).alias("blank"),
            (s["begun"] & ~fresh).alias("begun"), s["recent"].alias("recent"), s["done"].alias("done"),
        )

    def whole(s: Column, e: Column) -> Column:
        def add(weight: Column) -> Column:
            top = (F.size(s["open"]) == 0) & (e["kind"] != "chrome")
            return F.struct(*[s[c].alias(c) if c != "weight" else weight.alias(c) for c in list(FOLD_START)[:-2]], *with_block(s, top, weight - s["weight"]))

        return _let(_weight_after(s["weight"], s["words"], F.lit(0), e["kind"], s["weight"], s["words"]), add)

    def read(s: Column, e: Column) -> Column:
        """The text behind a tag; lines are those of the code block it stands in, if any."""
        lines = F.when(s["begun"], s["blank"] + e["before"]).otherwise(0) + e["lines"] - e["before"] - e["after"]
        return F.struct(
            s["open"].alias("open"), s["weight"].alias("weight"), (s["words"] + e["words"]).alias("words"),
            F.when(e["full"], s["lines"] + lines).otherwise(s["lines"]).alias("lines"),
            F.when(e["full"], e["after"]).otherwise(s["blank"] + e["lines"]).alias("blank"),
            (s["begun"] | e["full"]).alias("begun"),
            *with_block(s, e["full"] & (F.size(s["open"]) == 0), F.lit(0)),
        )

    def tagged(s: Column, e: Column) -> Column:
        at = F.array_position(s["open"]["tag"], e["tag"]).cast("int")
        return F.when(e["step"] == "start", started(s, e)).when(e["step"] == "whole", whole(s, e)).when(e["step"] == "end", _let(at, lambda k: F.when(k > 0, ended(s, k)).otherwise(s))).otherwise(s)

    def step(s: Column, e: Column) -> Column:
        return _let(tagged(s, e), lambda t: F.when(e["full"] | (e["lines"] > 0), read(t, e)).otherwise(t))

    def finish(s: Column) -> Column:
        rest = F.when(F.size(s["open"]) > 0, ended(s, F.size(s["open"]))).otherwise(s)
        return _let(rest, lambda t: F.flatten(F.array_append(t["done"], t["recent"])))

    start = F.struct(*[F.expr(v).alias(c) for c, v in FOLD_START.items()])
    return F.aggregate(_events(body), start, step, finish)


def greedy_pagination(pages: DataFrame, keys: list[str], html: str = "html", limit: int = SHEET_LINES) -> DataFrame:
    """Sheet of every block of the page's article, without its header and footer: filled in
    order, a block that would overflow starts a new sheet.

    The running weight resets at each break, so it is a fold over the page's own blocks
    and not a window sum; it runs inside the row. The fold keeps the number of blocks of
    each full sheet, from which the sheet of every block is laid out once."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("full"))

    def step(s: Column, w: Column) -> Column:
        turn = (s["used"] + w > limit) & (s["held"] > 0)
        return F.struct(
            F.when(turn, w).otherwise(s["used"] + w).alias("used"),
            F.when(turn, 1).otherwise(s["held"] + 1).alias("held"),
            F.when(turn, F.array_append(s["full"], s["held"])).otherwise(s["full"]).alias("full"),
        )

    sizes = F.aggregate("_w", start, step, lambda s: F.array_append(s["full"], s["held"]))
    sheets = F.flatten(F.transform(sizes, lambda n, i: F.array_repeat((i + 1).cast("int"), n)))
    folded = pages.select(*keys, block_weights(page_body(F.col(html))).alias("_w")).withColumn("_s", sheets)
    return folded.select(*keys, F.posexplode(F.arrays_zip(F.col("_w").alias("weight"), F.col("_s").alias("sheet")))).select(
        *keys, F.col("pos").cast("bigint").alias("block"), F.col("col.weight").alias("weight"), F.col("col.sheet").alias("sheet")
    )


def page_body(html: Column) -> Column:
    """Printable content: article, else main, else body, else all."""
    pick = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*)</{tag}>", 1)
    has = lambda tag: html.rlike(rf"(?is)<{tag}[^>]*>.*</{tag}>")
    return strip(
        F.when(has("article"), pick("article")).when(has("main"), pick("main")).when(has("body"), pick("body")).otherwise(html)
    )


def page_section(html: Column, page: Column) -> Column:
    key = F.regexp_replace(page_key(page), "_", "-")
    return F.concat(
        F.lit('<section class="book-sheet" id="'), key, F.lit('" data-page="'), page.cast("string"),
        F.lit('">\n  <main class="book-page book-page--sheet">\n    <article class="sheet-flow prose-page">\n'),
        book_asset_urls(page_body(html)),
        F.lit("\n    </article>\n  </main>\n</section>"),
    )


def book_assembly(pages: DataFrame, valid: DataFrame, *, size: int = 40) -> DataFrame:
    """Ordered page sections joined per part of a (book, lang); nothing for a book with an invalid page.

    A part never holds more than `size` pages, so no row grows with the book.
    valid(book, lang, page, valid) comes from the content gate."""
    keys = ["book", "lang"]
    refused = valid.filter(~F.col("valid")).select(*keys).distinct()
    chunked = fixed_chunks(pages.join(refused, keys, "left_anti").select(*keys, "page", "html"), keys, size)
    section = page_section(F.col("html"), F.col("page"))
    return (
        chunked.select(*keys, "chunk", "page", section.alias("s"))
        .groupBy(*keys, "chunk")
        .agg(
            F.count("*").alias("pages"),
            F.min("page").alias("first_page"),
            F.max("page").alias("last_page"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "s"))), lambda x: x["s"]), "\n").alias("html"),
        )
    )


def refused_books(valid: DataFrame) -> DataFrame:
    """Books that cannot be assembled, with the number of pages that stand in the way."""
    return valid.filter(~F.col("valid")).groupBy("book", "lang").agg(F.count("*").alias("invalid_pages"))


def assembly_verdicts(expected: DataFrame, valid: DataFrame) -> DataFrame:
    """Whether each (book, lang) of `expected` can be assembled: it has pages, and none is invalid.

    The same rule by which book_assembly leaves books out, from the gate's flags alone, so
    that no page body is read for it."""
    keys = ["book", "lang"]
    built = valid.groupBy(*keys).agg(F.bool_and("valid").alias("ok"))
    return expected.select(*keys).distinct().join(built, keys, "left").select(*keys, F.coalesce("ok", F.lit(False)).alias("ok"))
