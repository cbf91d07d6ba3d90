"""Page corpus operators: tokens, tags, content gate, lint."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafaudit.functions import text as tx

#: Names of character references (as written, with or without their semicolon) for text without letters or digits.
BLANK_REFERENCES = sorted(n for n, value in html5.items() if not any(c.isalnum() for c in value))
NUMBERED = r"&#(?:[0-9]+|[xX][0-9a-fA-F]+);?"
NAMED = r"&([a-zA-Z][a-zA-Z0-9]*;?)"

# Fixed values of the page contract.
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
]
HIDDEN_TAGS = ["script", "style", "template", "noscript"]
CHROME_CLASSES = ["running-head", "book-footer", "page-nav"]
FORBIDDEN_MARKER = "pdf-render"


def page_scan(pages: DataFrame, path: str = "path") -> DataFrame:
    """Book, language and page number from the path; paths that do not parse are dropped."""
    pattern = r"([^/]+)/output/([^/]+)/page_(\d+)\.html$"
    part = lambda i: F.regexp_extract(path, pattern, i)
    return (
        pages.filter(F.col(path).rlike(pattern))
        .withColumn("book", part(1))
        .withColumn("lang", part(2))
        .withColumn("page", part(3).cast("bigint"))
    )


def visible_tokens(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Count of every normalised visible word per page."""
    tokens = pages.select(*keys, F.explode(tx.visible_words(F.col(html))).alias("token"))
    return tokens.groupBy(*keys, "token").agg(F.count("*").alias("n"))


def tag_events(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One row per start, end or self-closing tag, in document order."""
    events = pages.select(*keys, F.posexplode(tx.tag_array(F.col(html))).alias("pos", "raw"))
    return events.select(
        *keys,
        F.col("pos").cast("bigint").alias("pos"),
        tx.tag_kind(F.col("raw")).alias("kind"),
        tx.tag_name(F.col("raw")).alias("tag"),
        tx.tag_attributes(F.col("raw")).alias("attrs"),
    )


def tag_signature(html: Column) -> Column:
    """The page's tag events as one array of strings (kind, name, attributes)."""
    return F.transform(
        tx.tag_array(html),
        lambda raw: F.concat_ws(
            " ", tx.tag_kind(raw), tx.tag_name(raw), tx.attributes_text(tx.tag_attributes(raw))
        ),
    )


def _attr(tag: Column, name: str) -> Column:
    """Lower-cased value of a parsed tag's attribute, empty where it has none."""
    at = F.array_position(tag["names"], name).cast("int")
    quoted = F.when(at > 0, F.try_element_at(tag["values"], at)).otherwise("")
    return F.lower(F.regexp_replace(quoted, r"""^["']|["']$""", ""))


def _has_words(text: Column) -> Column:
    """Letters or digits in text, as written or as a character reference. A name that is
    not one of a blank reference stays as it is read: letters."""
    bare = F.regexp_replace(F.regexp_replace(text, NUMBERED, " "), NAMED, " ")
    named = F.exists(F.regexp_extract_all(text, F.lit(NAMED), F.lit(1)), lambda n: ~n.isin(BLANK_REFERENCES))

    def letter(ref: Column) -> Column:
        digits = F.regexp_replace(ref, "[&#;xX]", "")
        code = F.when(F.lower(ref).contains("x"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(real, code).otherwise(32)), 8, "0")), "UTF-32").rlike(r"[\p{L}\p{N}]")

    numbered = F.exists(F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(0)), letter)
    return bare.rlike(r"[\p{L}\p{N}]") | (text.contains("&") & (named | numbered))


def _own_hidden(raw: Column, name: Column) -> Column:
    style = F.regexp_replace(_attr(raw, "style"), r"\s+", "")
    classes = F.split(F.trim(_attr(raw, "class")), r"\s+")
    return (
        name.isin(HIDDEN_TAGS)
        | F.array_contains(raw["names"], "hidden")
        | (_attr(raw, "aria-hidden") == "true")
        | F.arrays_overlap(classes, F.array(*map(F.lit, CHROME_CLASSES)))
        | style.contains("display:none")
        | style.contains("visibility:hidden")
        | style.rlike(r"(?:^|;)opacity:0(?:\.0+)?(?:;|$)")
    )


def _visual(raw: Column, name: Column) -> Column:
    has = lambda *names: F.greatest(*[F.length(_attr(raw, n)) for n in names], F.lit(0)) > 0
    return (
        has("data-visual-id")
        | ((name == "img") & has("src", "srcset"))
        | name.isin("svg", "canvas", "math", "hr")
        | (name.isin("video", "audio") & has("src", "poster"))
        | (name.isin("object", "embed", "iframe") & has("data", "src"))
        | ((name == "input") & (_attr(raw, "type") != "hidden"))
        | _attr(raw, "style").contains("url(")
    )


def _events_for_gate(html: Column) -> Column:
    """Tags with the text that follows them, reduced to what the gate needs."""

    def parse(event: Column) -> Column:
        raw = F.regexp_extract(event, tx.TAG, 0)
        body = F.when(raw.startswith("</"), "").otherwise(F.regexp_replace(raw, r"^<[a-zA-Z][^\s/>]*|/?>$", ""))
        names = F.regexp_extract_all(F.lower(body), F.lit(tx.ATTRIBUTE), F.lit(1))
        values = F.regexp_extract_all(body, F.lit(tx.ATTRIBUTE), F.lit(2))
        tail = F.substring(event, F.length(raw) + 1, F.length(event))
        return F.struct(tx.tag_name(raw).alias("name"), tx.tag_kind(raw).alias("kind"), names.alias("names"), values.alias("values"), tail.alias("tail"))

    def shape(raw: Column) -> Column:
        name, kind = raw["name"], raw["kind"]
        blank = F.coalesce(
            F.nullif(_attr(raw, "data-intentionally-blank"), F.lit("")), _attr(raw, "data-blank-page")
        ).isin("1", "true", "yes")
        start = kind != "end"
        return F.struct(
            name.alias("tag"),
            F.when(kind == "end", F.lit("e"))
            .when((kind == "startend") | name.isin(VOID_TAGS), F.lit("v"))
            .otherwise(F.lit("s"))
            .alias("kind"),
            (start & _own_hidden(raw, name)).alias("hides"),
            (start & _visual(raw, name)).alias("visual"),
            (start & (name == "article") & blank).alias("blank"),
            _has_words(raw["tail"]).alias("words"),
        )

    events = F.regexp_extract_all(tx.without_raw_text(html), F.lit(tx.TAG_WITH_TEXT), F.lit(0))
    return F.transform(F.transform(events, parse), shape)


def article_probe(html: Column) -> Column:
    """Fold the page's tags over an open-element stack, inside the row.

    The stack is one string, innermost element first: "|tag:AH" where A says the
    element lies in an article and H that it is hidden. An end tag cuts the stack
    after its innermost match, which also closes elements left open."""

    def step(state: Column, ev: Column) -> Column:
        stack = state["stack"]
        top = F.when(stack == "", F.lit("00")).otherwise(F.right(F.substring_index(stack, "|", 2), F.lit(2)))
        is_end = ev["kind"] == "e"
        in_article = (F.substring(top, 1, 1) == "1") | (ev["tag"] == "article")
        hidden = (F.substring(top, 2, 1) == "1") | ev["hides"]
        entry = F.concat(
            F.lit("|"), ev["tag"], F.lit(":"), F.when(in_article, "1").otherwise("0"), F.when(hidden, "1").otherwise("0")
        )
        key = F.concat(F.lit("|"), ev["tag"], F.lit(":"))
        at = F.instr(stack, key)
        popped = F.when(at > 0, F.substring(stack, at + F.length(key) + 2, F.length(stack))).otherwise(stack)
        after = F.when(is_end, popped).when(ev["kind"] == "s", F.concat(entry, stack)).otherwise(stack)
        after_flags = F.right(F.substring_index(after, "|", 2), F.lit(2))
        readable = (after != "") & (after_flags == "10")
        return F.struct(
            after.alias("stack"),
            (state["article"] | (~is_end & (ev["tag"] == "article"))).alias("article"),
            (state["blank"] | ev["blank"]).alias("blank"),
            (state["words"] | (ev["words"] & readable)).alias("words"),
            (
                state["visual"]
                | (~is_end & ev["visual"] & in_article & ~hidden & (ev["tag"] != "article"))
            ).alias("visual"),
        )

    start = F.struct(
        F.lit("").alias("stack"),
        *[F.lit(False).alias(n) for n in ("article", "blank", "words", "visual")],
    )
    return F.aggregate(_events_for_gate(html), start, step)


def content_gate(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Shell, article, marker and visible-content flags per page; valid means all hold."""
    low = F.lower(F.col(html))
    probed = pages.select(
        *keys,
        (low.contains("<main") & low.contains("book-page")).alias("has_shell"),
        low.contains("<article").alias("has_article"),
        low.contains(FORBIDDEN_MARKER).alias("has_marker"),
        article_probe(F.col(html)).alias("probe"),
    )
    content = F.col("probe.words") | F.col("probe.visual") | F.col("probe.blank")
    return probed.select(
        *keys,
        "has_shell",
        (F.col("has_article") & F.col("probe.article")).alias("has_article"),
        "has_marker",
        content.alias("has_content"),
        (F.col("has_shell") & F.col("has_article") & F.col("probe.article") & ~F.col("has_marker") & content).alias(
            "valid"
        ),
    )


def _rules(rows: list[tuple[Column, str, str]]) -> Column:
    found = [F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(msg).alias("message"))) for cond, rule, msg in rows]
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def lint_rules(pages: DataFrame, keys: list[str], html: str = "html", foot_left: str = "foot_left") -> DataFrame:
    """In-text page rules; one row per (page, rule). foot_left is the book's footer author, or null."""
    t = F.col(html)
    head = F.regexp_extract(t, r'(?s)<header class="running-head">(.*?)</header>', 1)
    author = F.col(foot_left)
    rules = _rules(
        [
            (t.contains("page-copyright"), "legacy_footer", "use .book-footer not .page-copyright"),
            (
                t.rlike(r'<h3 class="section-title">[^<]+\.</h3>'),
                "heading_full_stop",
                "h3.section-title ending with '.' needs a run-in heading",
            ),
            (t.contains("ascii-figure"), "ascii_figure", "ascii-figure must be an extracted figure"),
            (
                t.rlike(r'(?s)<figure class="listing">.*?<pre class="code-block">.*?</pre>\s*<figcaption>'),
                "caption_below_code",
                "listing caption must be above code",
            ),
            (
                author.isNotNull() & (author != "") & (head != "") & (F.instr(head, author) > 0),
                "author_in_head",
                "author in running-head (belongs in footer)",
            ),
            (
                t.contains('figure class="diagram"') & ~t.contains("figures-page.css"),
                "figure_stylesheet",
                "link figures-page.css for diagrams",
            ),
            (t.contains("code-block") & ~t.contains("code-page.css"), "code_stylesheet", "link code-page.css for code"),
            (t.contains(FORBIDDEN_MARKER), "forbidden_marker", "forbidden pdf-render marker"),
            (
                t.contains("<main") & ~t.contains("book-page--sheet"),
                "sheet_shell",
                "missing main.book-page.book-page--sheet shell",
            ),
        ]
    )
    return pages.select(*keys, F.inline(rules))


def lint_assembled(books: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Rules for an assembled book document."""
    t = F.col(html)
    rules = _rules(
        [
            (~t.contains("prose-page.css"), "prose_stylesheet", "assembled book must link assets/prose-page.css"),
            (~t.contains("book-page--sheet"), "sheet_shell", "each sheet needs main.book-page.book-page--sheet"),
            (~t.contains("sheet-flow prose-page"), "sheet_article", "each sheet needs article.sheet-flow.prose-page"),
        ]
    )
    return books.select(*keys, F.inline(rules))
