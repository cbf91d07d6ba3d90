"""Library-level jobs: page specs, overviews, readiness, catalogue, language detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafaudit.functions.text import title_from_slug
from leafaudit.operators.ordered import explode_range, top_n

# Letters and common words that point to a language. The Vietnamese
# row is the original one; the others cover the languages of the sample corpus.
LANGUAGE_MARKERS = {
    "vi": (
        "ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ",
        ["và", "của", "là", "trong", "một", "những"],
    ),
    "fr": ("éèêàçùôîâœ", ["le", "les", "des", "et", "dans", "une"]),
    "de": ("äöüß", ["der", "die", "und", "das", "nicht", "für"]),
    "es": ("ñáíóú", ["el", "los", "que", "por", "una", "con"]),
}
MARKER_THRESHOLD = 5
DEFAULT_LANGUAGE = "en"


def page_spec_select(specs: DataFrame, pages: DataFrame, *, strict: bool = False) -> DataFrame:
    """Pages named by each book's spec ("1-5,8"), clamped to 1..page_count.

    Ranges are clamped before they are expanded, so a spec cannot outgrow its book.
    strict fails on a malformed part; otherwise such parts are skipped and en/em
    dashes count as hyphens."""
    spec = F.col("spec") if strict else F.translate("spec", "–—", "--")
    part = F.explode(F.split(F.replace(spec, F.lit(" "), F.lit("")), ","))
    parts = specs.select("book", "page_count", part.alias("part"))
    well_formed = F.col("part").rlike(r"^\d{1,18}(-\d{1,18})?$")
    if strict:
        checked = F.when(well_formed, F.col("part")).otherwise(
            F.raise_error(F.concat(F.lit("malformed page spec: "), F.col("part")))
        )
        parts = parts.withColumn("part", checked)
    else:
        parts = parts.filter(well_formed)
    low = F.regexp_extract("part", r"^(\d+)", 1).cast("bigint")
    high = F.coalesce(F.nullif(F.regexp_extract("part", r"-(\d+)$", 1), F.lit("")).cast("bigint"), low)
    wanted = explode_range(parts, ["book"], F.greatest(low, F.lit(1)), F.least(high, F.col("page_count")), "page").distinct()
    return pages.join(wanted, ["book", "page"], "left_semi")


def overview_rollup(books: DataFrame, page_files: DataFrame) -> DataFrame:
    """Headline counts from file names only; page bodies are not read.

    page_files(book, lang, page, has_source) comes from a listing."""
    src = F.col("source_lang")
    counts = page_files.groupBy("book", "lang").agg(F.count("*").alias("n"), F.count_if("has_source").alias("s"))
    joined = counts.join(books.select("book", "source_lang"), "book")
    per_book = joined.groupBy("book").agg(
        F.sum("s").alias("page_pdf_done"), F.sum(F.when(F.col("lang") == src, F.col("n")).otherwise(0)).alias("published")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return books.join(per_book, "book", "left").select(
        "book",
        F.coalesce(F.nullif("title", F.lit("")), title_from_slug(F.col("book"))).alias("title"),
        "source_lang",
        F.coalesce("library_state", F.lit("active")).alias("library_state"),
        zero("page_count"),
        zero("page_pdf_done"),
        zero("published"),
    )


def language_readiness(books: DataFrame, pages: DataFrame, *, shown: int = 10) -> DataFrame:
    """Per required (book, lang): ready or the reason to skip it, and the book's verdict.

    The reason names the first `shown` invalid pages. books(book, page_count, languages array); pages(book, lang, page, valid)."""
    required = books.select("book", "page_count", F.explode("languages").alias("lang"))
    counts = pages.groupBy("book", "lang").agg(
        F.count("*").alias("found"), F.count_if(~F.col("valid")).alias("invalid")
    )
    first = top_n(pages.filter(~F.col("valid")).select("book", "lang", "page"), ["book", "lang"], [F.col("page").asc()], shown)
    first = first.groupBy("book", "lang").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: p.cast("string")), ", ").alias("bad")
    )
    found, invalid = F.coalesce("found", F.lit(0)), F.coalesce("invalid", F.lit(0))
    reason = (
        F.when(found == 0, F.lit("No rendered HTML pages"))
        .when(
            (F.col("page_count") > 0) & (found != F.col("page_count")),
            F.concat(F.lit("Expected "), F.col("page_count"), F.lit(" pages, found "), found),
        )
        .when(invalid > 0, F.concat(invalid, F.lit(" blank/invalid page(s): ["), F.col("bad"), F.lit("]")))
        .otherwise("ready")
    )
    per_lang = (
        required.join(counts, ["book", "lang"], "left")
        .join(first, ["book", "lang"], "left")
        .withColumn("status", reason)
        .withColumn("_full", (F.col("page_count") > 0) & (found - invalid == F.col("page_count")))
    )
    verdict = per_lang.groupBy("book").agg(F.bool_and("_full").alias("book_complete"))
    return per_lang.join(verdict, "book").select(
        "book", "lang", found.cast("bigint").alias("found"), invalid.cast("bigint").alias("invalid"), "status", "book_complete"
    )


def catalog_enrich(books: DataFrame, overview: DataFrame, status: DataFrame, index: DataFrame, packages: DataFrame) -> DataFrame:
    """Catalogue row per book, ordered by lower-case title.

    Library state: the index value if it is valid, else the manifest's, else active."""
    packed = packages.select("book").distinct().withColumn("has_package", F.lit(True))
    state = F.col("index_state")
    return (
        books.select("book")
        .join(overview, "book", "left")
        .join(status.select("book", "status", "running"), "book", "left")
        .join(index.select("book", F.col("library_state").alias("index_state")), "book", "left")
        .join(packed, "book", "left")
        .select(
            "book",
            "title",
            "page_count",
            "page_pdf_done",
            "published",
            F.coalesce("has_package", F.lit(False)).alias("has_package"),
            F.coalesce("running", F.lit(False)).alias("running"),
            F.coalesce("status", F.lit("idle")).alias("status"),
            F.when(state.isin("active", "done"), state)
            .otherwise(F.coalesce("library_state", F.lit("active")))
            .alias("library_state"),
        )
        .orderBy(F.lower(F.coalesce("title", "book")), "book")
    )


def page_preview(pages: DataFrame, n: int = 20) -> DataFrame:
    """First n pages of each book with their flags, and how many more there are."""
    flags = F.array_join(
        F.filter(
            F.array(F.when(F.col("page_pdf"), F.lit("page-pdf")), F.when(F.col("published"), F.lit("html"))),
            lambda f: f.isNotNull(),
        ),
        " ",
    )
    shown = top_n(pages.select("book", "page", "page_pdf", "published"), ["book"], [F.col("page").asc()], n)
    total = pages.groupBy("book").agg(F.count("*").alias("_all"))
    return shown.join(total, "book").select(
        "book",
        "page",
        F.coalesce(F.nullif(flags, F.lit("")), F.lit("pending")).alias("flags"),
        F.greatest(F.col("_all") - n, F.lit(0)).cast("bigint").alias("more"),
    )


def priority_coalesce(candidates: list[tuple[Column, list[str]]], default: Column) -> Column:
    """First candidate that is not null, blank or in its own list of ignored values."""
    usable = [F.when((F.trim(c) != "") & ~F.lower(F.trim(c)).isin([*ignored, ""]), F.trim(c)) for c, ignored in candidates]
    return F.coalesce(*usable, default)


def author_of(manifest_author: Column, document_author: Column, slug: Column) -> Column:
    inferred = F.when(slug.contains("-by-"), title_from_slug(F.element_at(F.split(slug, "-by-"), -1)))
    return priority_coalesce(
        [(manifest_author, []), (document_author, ["unknown", "none"]), (inferred, [])], F.lit("Unknown")
    )


def crop_box(diagnosed: Column, fallback: Column, computed: Column) -> Column:
    return F.coalesce(diagnosed, fallback, computed)


MARKER_WORDS = [w for _, words in LANGUAGE_MARKERS.values() for w in words]


def _marker_counts(parts: Column) -> Column:
    """How many marker words of each language stand between the blanks a text is split at.

    One pass over the words keeps the markers and their places. A blank serves one of two
    equal words, so of equal words in a row every other one counts."""
    found = F.transform(parts, lambda w, i: F.when(w.isin(MARKER_WORDS), F.struct(i.alias("at"), w.alias("word"))))
    inner = F.filter(found, lambda m: m.isNotNull() & (m["at"] > 0) & (m["at"] < F.size(parts) - 1))
    zero = F.struct(F.lit(-1).alias("at"), F.lit("").alias("word"), F.lit(False).alias("counted"), *[F.lit(0).alias(code) for code in LANGUAGE_MARKERS])

    def step(acc: Column, m: Column) -> Column:
        counted = ~((m["at"] == acc["at"] + 1) & (m["word"] == acc["word"]) & acc["counted"])
        sums = [(acc[code] + (counted & m["word"].isin(words)).cast("int")).alias(code) for code, (_, words) in LANGUAGE_MARKERS.items()]
        return F.struct(m["at"].alias("at"), m["word"].alias("word"), counted.alias("counted"), *sums)

    return F.aggregate(inner, zero, step)


def lang_detect(docs: DataFrame, *, text: str = "text", declared: str = "declared") -> DataFrame:
    """Declared language if it is a known one, else the best language with enough markers.

    A whole text is gone through inside its row, once for the marker words and once for
    its letters beyond ASCII, in which the marker letters of all languages are counted."""
    low = F.lower(F.col(text))
    first = F.split(F.lower(F.coalesce(F.col(declared), F.lit(""))), "-")[0]
    known = F.when(first == "vie", "vi").otherwise(first)
    sure = F.coalesce(known.isin(list(LANGUAGE_MARKERS)), F.lit(False))
    scored = docs.withColumn("_low", F.when(~sure, low))
    scored = scored.withColumn("_parts", F.split("_low", " ", -1))
    scored = scored.withColumn("_words", _marker_counts(F.col("_parts"))).withColumn("_letters", F.regexp_replace("_low", r"[\x00-\x7f]+", ""))
    ranking = []
    for code, (marks, _) in LANGUAGE_MARKERS.items():
        m, w = F.length("_letters") - F.length(F.translate("_letters", marks, "")), F.col(f"_words.{code}")
        enough = (m >= MARKER_THRESHOLD) | (w >= MARKER_THRESHOLD)
        ranking.append(F.when(enough, F.struct((m + w).alias("score"), F.lit(code).alias("code"))))
    best = F.array_max(F.array(*ranking))
    return scored.withColumn("_best", best).withColumn(
        "detected", F.when(sure, known).otherwise(F.coalesce("_best.code", F.lit(DEFAULT_LANGUAGE)))
    ).drop("_best", "_words", "_letters", "_low", "_parts")
