"""Visual plans, figure manifests and their reconciliation with page references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafaudit.functions.paths import base_name
from leafaudit.functions.text import canonical_id
from leafaudit.operators.boxes import PAGE, RASTER, RECONSTRUCT

# Fixed values of the visual plan contract.
STRATEGIES = [RECONSTRUCT, RASTER]
LAYOUT_MODES = ["source-anchored", "flow"]
PIXEL_TYPES = [
    "artwork", "illustration", "complex-illustration", "map", "technical-illustration", "technical-drawing",
    "engineering-drawing", "engineering-schematic", "architectural-drawing", "construction-detail",
    "composite-engineering-sheet", "dense-technical-diagram",
]
RECONSTRUCT_TYPES = [
    "icon", "simple-icon", "pictogram", "glyph", "symbol", "exercise-marker", "section-marker", "family-tree",
    "familytree", "pedigree", "org-chart", "orgchart", "organization-chart", "organisational-chart",
    "organizational-chart", "flowchart", "flow-chart", "timeline", "worksheet-diagram", "worksheet", "form", "table",
]
BASIC_LABEL = (
    r"(?i)\b(?:icon|pictogram|glyph|exercise[\s_-]+marker|section[\s_-]+marker|family[\s_-]+tree|pedigree|"
    r"organi[sz]ation(?:al)?[\s_-]+chart|org[\s_-]+chart|flow[\s_-]*chart|worksheet[\s_-]+diagram)\b"
)
IMAGE_REF = r"(?i)page_(\d{4})_fig_([A-Za-z0-9_.-]+)\.png"
VISUAL_ID = r"""(?i)data-visual-id=["']([^"']+)["']"""
REGION_ID = r"""(?i)data-source-region=["']([^"']+)["']"""
LAYOUT_MODE = r"""(?i)data-layout-mode=["']([^"']+)["']"""
FACSIMILE_MARK = r"""(?i)data-page-facsimile=["']true["']"""
FACSIMILE_TYPE = "composite-engineering-sheet"
FIDELITY_TARGET = 0.99

FIGURE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("complexity", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("bbox_normalized", T.ArrayType(T.DoubleType())),
        T.StructField("art_bbox", T.ArrayType(T.DoubleType())),
        T.StructField("crop_bbox", T.ArrayType(T.DoubleType())),
        T.StructField("caption_bbox_normalized", T.ArrayType(T.DoubleType())),
    ]
)
REGION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("bbox_normalized", T.ArrayType(T.DoubleType())),
        T.StructField("fill_color", T.StringType()),
        T.StructField("stroke_color", T.StringType()),
        T.StructField("text_color", T.StringType()),
    ]
)
PLAN = T.StructType(
    [
        T.StructField("page", T.LongType()),
        T.StructField("producer", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField(
            "page_layout",
            T.StructType(
                [
                    T.StructField("mode", T.StringType()),
                    T.StructField("facsimile", T.BooleanType()),
                    T.StructField("regions", T.ArrayType(REGION)),
                ]
            ),
        ),
        T.StructField("figures", T.ArrayType(FIGURE)),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
MANIFEST_FIGURE = T.StructType(
    [
        T.StructField("figure", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("file", T.StringType()),
        *[
            T.StructField(n, T.DoubleType())
            for n in ("width", "height", "raster_width", "raster_height", "display_width_pt", "display_height_pt")
        ],
        T.StructField("clip", T.ArrayType(T.DoubleType())),
    ]
)


def figure_manifest_scan(manifests: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """Rows (keys, page, figure, ...) from a JSON map page_NNNN -> array of figures."""
    parsed = F.from_json(json, T.MapType(T.StringType(), T.ArrayType(MANIFEST_FIGURE)))
    entries = manifests.select(*keys, F.explode(parsed).alias("page_key", "figures"))
    rows = entries.select(*keys, "page_key", F.inline("figures"))
    return rows.withColumn("page", F.regexp_extract("page_key", r"^page_(\d+)$", 1).cast("bigint"))


def read_plans(documents: DataFrame) -> DataFrame:
    """Parse plan documents (book, page, json) and say which ones are unusable."""
    p = F.from_json("json", PLAN, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    text = F.trim("json")
    problem = F.when(~text.startswith("{"), "visual plan is not an object").when(
        F.col("p._corrupt_record").isNotNull() | ~text.endswith("}"), "visual plan validation failed"
    )
    return documents.withColumn("p", p).withColumn("problem", problem)


def plan_scan(documents: DataFrame, source_pages: DataFrame) -> DataFrame:
    """Figure rows of readable plans and issue rows of unreadable or missing ones.

    documents(book, page, json) and source_pages(book, page); page bodies are not needed."""
    joined = source_pages.select(*PAGE).distinct().withColumn("_src", F.lit(True)).join(
        read_plans(documents), PAGE, "full_outer"
    )
    missing = F.col("_src").isNotNull() & F.col("json").isNull()
    issue = F.when(missing, "missing finalized visual plan").otherwise(F.col("problem"))
    ok = F.when(issue.isNull(), F.col("p.figures"))
    none = F.when(issue.isNotNull(), F.array(F.lit(None).cast(FIGURE)))
    rows = joined.select(*PAGE, issue.alias("issue"), F.explode(F.coalesce(none, ok)).alias("f"))
    return rows.select(
        *PAGE,
        F.col("f.id").alias("figure_id"),
        F.col("f.type").alias("type"),
        F.col("f.strategy").alias("strategy"),
        "issue",
    )


def normal_type(kind: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(kind, F.lit("")))), r"[\s_]+", "-")


def _low(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def requires_reconstruction(type_: Column, complexity: Column, label: Column) -> Column:
    t, basic = normal_type(type_), _low(complexity) == "basic"
    named = F.concat_ws(" ", F.coalesce(type_, F.lit("")), F.coalesce(label, F.lit(""))).rlike(BASIC_LABEL)
    protected = t.isin(PIXEL_TYPES) & ~basic & ~named
    wanted = (
        t.isin(RECONSTRUCT_TYPES)
        | t.endswith("-icon")
        | (t.isin("diagram", "structured-diagram") & basic)
        | (t.endswith("-diagram") & basic)
        | named
    )
    return ~protected & wanted


def requires_pixels(type_: Column, complexity: Column, label: Column) -> Column:
    t, basic = normal_type(type_), _low(complexity) == "basic"
    rebuild = requires_reconstruction(type_, complexity, label)
    diagram = (t.isin("diagram", "structured-diagram") | t.endswith("-diagram")) & ~basic & ~rebuild
    return ~(basic & rebuild) & (t.isin(PIXEL_TYPES) | diagram)


def strategy_override(figures: DataFrame) -> DataFrame:
    """Apply the type rules to the planned strategy, keeping the old value and the reason."""
    cols = [F.col(c) for c in ("type", "complexity", "label")]
    pixels, rebuild = requires_pixels(*cols), requires_reconstruction(*cols)
    to_raster = pixels & (F.col("strategy") != RASTER)
    to_vector = ~to_raster & rebuild & (F.col("strategy") != RECONSTRUCT)
    kind = normal_type(F.col("type"))
    staged = figures.withColumn(
        "overridden_from", F.when(to_raster | to_vector, F.col("strategy"))
    ).withColumn(
        "reason",
        F.when(to_raster, F.concat(F.lit("Visual type "), kind, F.lit(" requires source-pixel preservation."))).when(
            to_vector, F.concat(F.lit("Structured visual type "), kind, F.lit(" must be rebuilt with HTML/SVG."))
        ),
    ).withColumn(
        "strategy", F.when(to_raster, RASTER).when(to_vector, RECONSTRUCT).otherwise(F.col("strategy"))
    )
    protected = pixels & (F.col("strategy") == RASTER)
    return staged.withColumn("fidelity_target", F.when(protected, F.lit(FIDELITY_TARGET))).withColumn(
        "preservation_mode", F.when(protected, F.lit("source-pixels"))
    )


def strategy_counts(figures: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("strategy"), F.lit("")), F.lit("unknown"))
    return figures.groupBy(*PAGE, name.alias("strategy")).agg(F.count("*").alias("n"))


def page_references(pages: DataFrame) -> DataFrame:
    """Canonical figure ids a page's HTML refers to: (book, page, canon, via, rebuild).

    via is image or tag; rebuild marks image tags whose own text asks for reconstruction."""
    html = F.col("html")
    tags = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0)),
        lambda t: F.struct(F.regexp_extract_all(t, F.lit(IMAGE_REF), F.lit(0)).alias("refs"), t.rlike(BASIC_LABEL).alias("b")),
    )
    in_tags = F.flatten(F.transform(tags, lambda t: F.transform(t["refs"], lambda r: F.struct(r.alias("r"), t["b"].alias("b")))))
    anywhere = F.transform(
        F.regexp_extract_all(html, F.lit(IMAGE_REF), F.lit(0)), lambda r: F.struct(r.alias("r"), F.lit(False).alias("b"))
    )
    images = F.transform(
        F.concat(anywhere, in_tags),
        lambda x: F.struct(
            F.regexp_extract(x["r"], IMAGE_REF, 1).cast("bigint").alias("at"),
            canonical_id(F.regexp_extract(x["r"], IMAGE_REF, 2)).alias("canon"),
            F.lit("image").alias("via"),
            x["b"].alias("rebuild"),
        ),
    )
    tagged = F.transform(
        F.regexp_extract_all(html, F.lit(VISUAL_ID), F.lit(1)),
        lambda v: F.struct(
            F.lit(None).cast("bigint").alias("at"), canonical_id(v).alias("canon"), F.lit("tag").alias("via"), F.lit(False).alias("rebuild")
        ),
    )
    rows = pages.select(*PAGE, F.inline(F.concat(images, tagged))).filter(F.col("at").isNull() | (F.col("at") == F.col("page")))
    return rows.groupBy(*PAGE, "canon", "via").agg(F.bool_or("rebuild").alias("rebuild"))


def planned_ids(figures: DataFrame) -> DataFrame:
    """One row per (page, canonical id); of figures sharing an id the last one counts.

    figures carries seq, the position in its plan."""
    cols = [F.col(c) for c in ("type", "complexity", "label")]
    return (
        figures.filter("figure_id is not null")
        .withColumn("canon", canonical_id(F.col("figure_id")))
        .groupBy(*PAGE, "canon")
        .agg(F.max_by(F.struct("strategy", requires_reconstruction(*cols).alias("rebuild")), "seq").alias("f"))
        .select(*PAGE, "canon", "f.*")
    )


def planned_kinds(figures: DataFrame) -> DataFrame:
    """As planned_ids, with a null strategy for all but STRATEGIES. What counts of a figure
    is one number, so ids are aggregated by hash and not sorted."""
    strategy = F.when(F.col("strategy") == RASTER, 2).when(F.col("strategy") == RECONSTRUCT, 4).otherwise(0)
    cols = [F.col(c) for c in ("type", "complexity", "label")]
    number = strategy + F.when(requires_reconstruction(*cols), 1).otherwise(0)
    last = figures.filter("figure_id is not null").select(*PAGE, canonical_id(F.col("figure_id")).alias("canon"), number.alias("_n"), "seq")
    last = last.groupBy(*PAGE, "canon").agg(F.max_by("_n", "seq").alias("_n"))
    named = F.when(F.col("_n") >= 4, RECONSTRUCT).when(F.col("_n") >= 2, RASTER)
    return last.select(*PAGE, "canon", named.alias("strategy"), (F.col("_n") % 2 == 1).alias("rebuild"))


def region_gap(layouts: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions of source-anchored plans without an anchor in the page."""
    anchored = layouts.filter(F.col("mode") == "source-anchored").select(*PAGE)
    planned = regions.filter("region_id <> ''").join(anchored, PAGE, "left_semi").select(*PAGE, "region_id")
    ids = F.explode(F.regexp_extract_all("html", F.lit(REGION_ID), F.lit(1)))
    return planned.subtract(pages.select(*PAGE, ids.alias("region_id")))


def layout_marker_gap(layouts: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of source-anchored plans without the layout-mode or facsimile marker."""
    modes = F.transform(F.regexp_extract_all("html", F.lit(LAYOUT_MODE), F.lit(1)), lambda m: F.lower(F.trim(m)))
    marks = pages.select(
        *PAGE, F.array_contains(modes, "source-anchored").alias("_mode"), F.col("html").rlike(FACSIMILE_MARK).alias("_fac")
    )
    anchored = layouts.filter(F.col("mode") == "source-anchored").join(marks, PAGE)
    lacks = F.filter(
        F.array(
            F.when(~F.col("_mode"), F.lit("data-layout-mode")),
            F.when(F.col("facsimile") & ~F.col("_fac"), F.lit("data-page-facsimile")),
        ),
        lambda m: m.isNotNull(),
    )
    return anchored.select(*PAGE, F.explode(lacks).alias("marker"))


def unplanned_ids(plan: DataFrame, refs: DataFrame) -> DataFrame:
    return refs.select(*PAGE, "canon").distinct().subtract(plan.select(*PAGE, "canon"))


def unrendered_ids(plan: DataFrame, refs: DataFrame) -> DataFrame:
    lacks = F.when(F.col("raster") & ~F.col("img"), "image").when(F.col("vector") & ~F.col("tag"), "tag")
    return plan_flags(plan, refs).select(*PAGE, "canon", lacks.alias("lacking")).filter("lacking is not null")


def forbidden_rasters(plan: DataFrame, refs: DataFrame) -> DataFrame:
    images = refs.filter("via = 'image'")
    forbidden = plan.filter("rebuild").select(*PAGE, "canon").union(images.filter("rebuild").select(*PAGE, "canon"))
    return forbidden.intersect(images.select(*PAGE, "canon"))


def plan_flags(plan: DataFrame, refs: DataFrame) -> DataFrame:
    """(page, canon, planned, raster, vector, rebuild, img, tag, says), none null: what the plan
    and the page say of each id, in one aggregation without a join or a sort. A key with a
    null matches nothing."""
    names = ["planned", "raster", "vector", "rebuild", "img", "tag", "says"]
    apart = F.expr(" or ".join(f"{c} is null" for c in (*PAGE, "canon")))

    def side(df: DataFrame, name: str, **flags: Column) -> DataFrame:
        columns = [F.coalesce(flags.get(c, F.lit(False)), F.lit(False)).alias(c) for c in names]
        return df.select(*PAGE, "canon", F.when(apart, F.lit(name)).alias("_side"), *columns)

    strategy, via = F.col("strategy"), F.col("via")
    both = side(plan, "plan", planned=F.lit(True), raster=strategy == RASTER, vector=strategy == RECONSTRUCT, rebuild=F.col("rebuild")).unionByName(
        side(refs, "refs", img=via == "image", tag=via == "tag", says=F.col("rebuild"))
    )
    return both.groupBy(*PAGE, "canon", "_side").agg(*[F.bool_or(c).alias(c) for c in names]).drop("_side")


def plan_reconcile(plan: DataFrame, refs: DataFrame) -> DataFrame:
    """All id checks between plan and page in one pass over the flags of each id."""
    checks = F.array(
        F.when(~F.col("planned"), F.lit("unplanned figure id")),
        F.when(F.col("raster") & ~F.col("img"), F.lit("raster figure without image")),
        F.when(F.col("vector") & ~F.col("tag"), F.lit("vector figure without tag")),
        F.when(F.col("img") & (F.col("rebuild") | F.col("says")), F.lit("reconstruct-only figure has an image")),
    )
    issues = F.filter(checks, lambda c: c.isNotNull())
    return plan_flags(plan, refs).select(*PAGE, "canon", F.explode(issues).alias("issue"))


def display_dimensions(figures: DataFrame) -> DataFrame:
    """Pixel and millimetre size of manifest figures: display size, else clip, else raster size."""
    pos = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c))
    both = pos("display_width_pt").isNotNull() & pos("display_height_pt").isNotNull()
    clip_w = F.when(F.size("clip") == 4, F.get("clip", F.lit(2)) - F.get("clip", F.lit(0)))
    clip_h = F.when(F.size("clip") == 4, F.get("clip", F.lit(3)) - F.get("clip", F.lit(1)))
    clip_ok = F.coalesce((clip_w > 0) & (clip_h > 0), F.lit(False))
    w = F.when(both, F.col("display_width_pt")).when(clip_ok, clip_w)
    h = F.when(both, F.col("display_height_pt")).when(clip_ok, clip_h)
    raster = lambda a, b: F.bround(F.coalesce(pos(a), pos(b), F.lit(1.0)), 0)
    px = lambda pt, a, b: F.when(pt.isNotNull(), F.greatest(F.lit(1.0), F.bround(pt * 96 / 72, 0))).otherwise(raster(a, b))
    return (
        figures.withColumn("width_px", px(w, "width", "raster_width").cast("bigint"))
        .withColumn("height_px", px(h, "height", "raster_height").cast("bigint"))
        .withColumn("width_mm", w * 25.4 / 72)
        .withColumn("file_name", base_name(F.col("file")))
    )


def figure_dimension_join(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """Display size for every image reference of a page, matched by page and file name."""
    src = r"""(?is)<img\b[^>]*\bsrc\s*=\s*["']([^"']*)["']"""
    refs = F.array_distinct(F.regexp_extract_all("html", F.lit(src), F.lit(1)))
    rows = pages.select(*PAGE, F.explode(refs).alias("src")).withColumn(
        "file_name", base_name(F.regexp_extract("src", r"^[^?#]*", 0))
    )
    sized = display_dimensions(figures).filter("file_name <> ''")
    last = sized.groupBy(*PAGE, "file_name").agg(
        F.max_by(F.struct("width_px", "height_px", "width_mm"), F.struct("seq")).alias("s")
    )
    return rows.join(last, [*PAGE, "file_name"]).select(*PAGE, "src", "file_name", "s.*")
