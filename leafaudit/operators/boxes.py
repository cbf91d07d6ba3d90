"""Page geometry: captions, clusters of art, crops, bands and density.

Objects are rows (book, page, obj_id, kind, x0, y0, x1, y1, text, n_items, page_w, page_h)
with kind text, drawing or image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafaudit.functions.geometry import (
    Box,
    crowded_pages,
    distance2,
    intersects,
    near_pairs,
    overlap_score,
    page_box,
    prefixed,
    similar_area,
)
from leafaudit.operators.ordered import ordered_columns, whole_columns
from leafaudit.session import shared_table

PAGE = ["book", "page"]
BOX = ["x0", "y0", "x1", "y1"]

# Caption wording and geometry limits of the page contract.
CAPTION = r"(?i)^(?:(?:Figure|Fig\.|Hình)\s+([A-Za-z\d]+(?:[-.]\d+)?)|(\d{1,3})[.)])(?:\s|[:.]|$)"
TOUCH_GAP = 12.0
#: Distinct boxes beyond which a cell counts as crowded; results don't depend on it.
FEW_BOXES = 8
HIGHLIGHT_HEIGHT = (10.0, 20.0)
CAPTION_IMAGE_GAP = 48.0
DIAGRAM_PREFIXES = ["+ ", "- ", "«", "»", "void ", "class ", "struct ", "enum "]
DIAGRAM_NAMES = ["Ellipse", "Circle", "User", "Base", "Derived", "Modem", "Subject"]
RECONSTRUCT = "reconstruct-html-svg"
RASTER = "extract-raster"


def _order_bucket() -> Column:
    return F.floor(F.col("y0") / 16)


def reading_order(objects: DataFrame) -> DataFrame:
    """Rank of every object on its page by (y0, x0)."""
    return ordered_columns(objects, PAGE, ["y0", "x0", "obj_id"], _order_bucket(), rank="rank")


def captions(objects: DataFrame) -> DataFrame:
    """Caption lines; a bare number counts only with an image close by."""
    text = objects.filter("kind = 'text'")
    named = F.regexp_extract("text", CAPTION, 1)
    number = F.regexp_extract("text", CAPTION, 2)
    found = text.filter(F.col("text").rlike(CAPTION)).withColumn("figure_id", F.when(named != "", named).otherwise(number))
    bare = found.filter(named == "")
    images = objects.filter("kind = 'image'").select(*PAGE, *BOX).distinct()
    close = _near_any(bare.select(*PAGE, "obj_id", *BOX), images, CAPTION_IMAGE_GAP)
    return found.filter(named != "").unionByName(bare.join(close, [*PAGE, "obj_id"], "left_semi"))


def _champions(box: Box) -> list[Column]:
    """Directions in which a group's farthest boxes stand for all of it."""
    return [box.x1, -box.x0, box.y1, -box.y0, box.x1 + box.y1, box.x1 - box.y0, box.y1 - box.x0, -box.x0 - box.y0]


def _representatives(boxes: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Distinct boxes (book, page, group, x0..y1), of crowded groups only the farthest ones;
    and the keys of the crowded groups, None if there are none."""
    keys = [*PAGE, *group]
    crowded = shared_table(boxes.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > FEW_BOXES).drop("n"), "crowded")
    if crowded.isEmpty():
        return boxes, None
    corners = F.struct(*BOX)
    farthest = [F.max_by(corners, F.struct(reach, corners)).alias(f"c{i}") for i, reach in enumerate(_champions(Box.of()))]
    some = boxes.join(crowded, keys, "left_semi").groupBy(*keys).agg(*farthest)
    some = some.select(*keys, F.inline(F.array_distinct(F.array(*[f"c{i}" for i in range(8)]))))
    return boxes.join(crowded, keys, "left_anti").select(*keys, *BOX).unionByName(some), crowded


def _near_any(asked: DataFrame, boxes: DataFrame, gap: float) -> DataFrame:
    """Ids of asked boxes with any of the distinct boxes within the gap. Crowded cells are
    tried by their farthest boxes first; only boxes that these leave open meet all others."""

    def hits(left: DataFrame, right: DataFrame) -> DataFrame:
        pairs = near_pairs(prefixed(left, PAGE, "l_"), prefixed(right.select(*PAGE, *BOX), PAGE, "r_"), PAGE, gap)
        return pairs.filter(distance2(Box.of("l_"), Box.of("r_")) <= gap * gap).select(*PAGE, F.col("l_obj_id").alias("obj_id")).distinct()

    side = gap / 1.5
    cell = [F.floor((F.col(a) + F.col(b)) / 2 / side).alias(n) for n, a, b in (("_cx", "x0", "x1"), ("_cy", "y0", "y1"))]
    boxes = boxes.select(*PAGE, *BOX, *cell)
    few, crowded = _representatives(boxes, ["_cx", "_cy"])
    if crowded is None:
        return hits(asked, boxes)
    first = shared_table(hits(asked, few), "near-first")
    return first.unionByName(hits(asked.join(first, [*PAGE, "obj_id"], "left_anti"), boxes))


def art_items(objects: DataFrame) -> DataFrame:
    """Drawings and images without specks, thin images and near-full-page drawings."""
    box = Box.of()
    speck = F.when(F.col("kind") == "image", (box.width < 3) | (box.height < 3)).otherwise((box.width < 3) & (box.height < 3))
    whole = (box.width > F.col("page_w") * 0.95) & (box.height > F.col("page_h") * 0.95)
    return objects.filter("kind in ('drawing', 'image')").filter(~speck & ~((F.col("kind") == "drawing") & whole))


def _mix(x: Column) -> Column:
    """Give 64-bit ids an unrelated order, one to one: three Feistel rounds over their halves."""
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    left, right = low(F.shiftrightunsigned(x, 32)), low(x)
    for turn in range(3):
        left, right = right, left.bitwiseXOR(low(F.xxhash64(right, F.lit(turn))))
    return F.shiftleft(left, 32).bitwiseOR(right)


def component_labels(edges: DataFrame) -> DataFrame:
    """Contract a graph of (book, page, a, b) edges until none is left.

    Each round every node points to the least id around it, pointers are doubled once,
    and the edges are rewritten to what their ends point at. With mixed ids the edges
    shrink by a factor per round, so late rounds are tiny; every round is
    written to the shared folder. The maps of the rounds are then composed from the
    last (smallest) one back. Returns (book, page, node, label) for nodes with edges."""
    maps: list[DataFrame] = []
    while True:
        both = edges.unionByName(edges.select(*PAGE, F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(*PAGE, "a").agg(F.least(F.min("a"), F.min("b")).alias("p"))
        grand = parent.select(*PAGE, F.col("a").alias("p"), F.col("p").alias("to"))
        step = parent.join(grand, [*PAGE, "p"]).select(*PAGE, "a", "to")
        step = shared_table(step, "component-map")
        maps.append(step)
        far = step.select(*PAGE, F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(step, [*PAGE, "a"]).join(far, [*PAGE, "b"]).filter("to <> tb")
        moved = moved.select(*PAGE, F.least("to", "tb").alias("a"), F.greatest("to", "tb").alias("b")).distinct()
        edges = shared_table(moved, "component-edges")
        if edges.isEmpty():
            break
    whole = maps.pop()
    while maps:
        after = whole.select(*PAGE, F.col("a").alias("to"), F.col("to").alias("end"))
        whole = maps.pop().join(after, [*PAGE, "to"], "left").select(*PAGE, "a", F.coalesce("end", "to").alias("to"))
        if maps:
            whole = shared_table(whole, "component-map")
    return whole.select(*PAGE, F.col("a").alias("node"), F.col("to").alias("label"))


def _touching(left: DataFrame, right: DataFrame, gap: float) -> DataFrame:
    """Pairs (a, b), a < b, of nodes with boxes no farther apart than the gap."""
    pairs = near_pairs(prefixed(left, PAGE, "l_"), prefixed(right, PAGE, "r_"), PAGE, gap)
    near = pairs.filter((F.col("l_node") < F.col("r_node")) & (distance2(Box.of("l_"), Box.of("r_")) <= gap * gap))
    return near.select(*PAGE, F.col("l_node").alias("a"), F.col("r_node").alias("b")).distinct()


def _links_left_over(boxes: DataFrame, labels: DataFrame, crowded: DataFrame, gap: float) -> DataFrame:
    """Links between nodes of different labels of which one is crowded, by all their boxes:
    node pairs whose extents are near, then boxes of either near the other's extent."""
    extent = boxes.groupBy(*PAGE, "node").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    extent = extent.join(labels, [*PAGE, "node"]).join(crowded.withColumn("full", F.lit(True)), [*PAGE, "node"], "left")
    extent = shared_table(extent.withColumn("full", F.coalesce("full", F.lit(False))), "cluster-extents")
    pairs = near_pairs(prefixed(extent.filter("full"), PAGE, "l_"), prefixed(extent, PAGE, "r_"), PAGE, gap)
    near = lambda a, b: distance2(Box.of(a), Box.of(b)) <= gap * gap
    pairs = shared_table(pairs.filter((F.col("l_label") != F.col("r_label")) & near("l_", "r_")), "open-node-pairs")
    own = boxes.select(*PAGE, "node", *[F.col(c).alias(f"o_{c}") for c in BOX])
    first = pairs.select(*PAGE, "l_label", "r_label", F.col("l_node").alias("node"), "r_node", *[F.col(f"r_{c}") for c in BOX])
    first = first.join(own, [*PAGE, "node"]).filter(near("o_", "r_"))
    first = first.select(*PAGE, "l_label", "r_label", F.col("r_node").alias("node"), *[F.col(f"o_{c}").alias(f"l_{c}") for c in BOX])
    found = first.join(own, [*PAGE, "node"]).filter(near("o_", "l_"))
    return found.select(*PAGE, F.least("l_label", "r_label").alias("a"), F.greatest("l_label", "r_label").alias("b")).distinct()


def visual_clusters(objects: DataFrame, *, gap: float = TOUCH_GAP) -> DataFrame:
    """Connected groups of touching drawings and images with union box and counts.

    Items whose centres share a cell of side gap/1.5 are closer than the gap, so
    each cell is contracted to one node first: a crowded page becomes a graph whose
    size follows its area, not its number of rows. A node of many distinct boxes is first
    linked by those that reach farthest in eight directions; that joins nearly all of a
    crowded page. Only where such a node stays apart from another although their extents
    are near are all their boxes compared, so no link is lost."""
    side = gap / 1.5
    box = Box.of()
    cell = F.floor((box.x0 + box.x1) / 2 / side) * (1 << 24) + F.floor((box.y0 + box.y1) / 2 / side)
    items = art_items(objects).select(*PAGE, "obj_id", *BOX, "kind", "n_items", _mix(cell.cast("bigint")).alias("node"))
    boxes = shared_table(items.select(*PAGE, "node", *BOX).distinct(), "cluster-boxes")
    few, crowded = _representatives(boxes, ["node"])
    labels = component_labels(shared_table(_touching(few, few, gap), "component-edges"))
    if crowded is not None:
        every = boxes.select(*PAGE, "node").distinct().join(labels, [*PAGE, "node"], "left")
        labels = shared_table(every.withColumn("label", F.coalesce("label", "node")), "cluster-labels")
        rest = shared_table(_links_left_over(boxes, labels, crowded, gap), "cluster-links")
        if not rest.isEmpty():
            joined = component_labels(rest).select(*PAGE, F.col("node").alias("label"), F.col("label").alias("_joined"))
            labels = labels.join(joined, [*PAGE, "label"], "left").select(*PAGE, "node", F.coalesce("_joined", "label").alias("label"))
    members = items.join(labels, [*PAGE, "node"], "left").withColumn("label", F.coalesce("label", "node"))
    return (
        members.groupBy(*PAGE, "label")
        .agg(
            F.min("obj_id").alias("cluster_id"),
            F.min("x0").alias("x0"),
            F.min("y0").alias("y0"),
            F.max("x1").alias("x1"),
            F.max("y1").alias("y1"),
            F.count_if(F.col("kind") == "drawing").alias("drawing_count"),
            F.sum(F.when(F.col("kind") == "drawing", F.col("n_items")).otherwise(0)).cast("bigint").alias("drawing_items"),
            F.count_if(F.col("kind") == "image").alias("image_count"),
        )
        .drop("label")
    )


def caption_side(art: Box, cap: Box) -> Column:
    v = F.least(art.y1, cap.y1) - F.greatest(art.y0, cap.y0)
    h = F.least(art.x1, cap.x1) - F.greatest(art.x0, cap.x0)
    return (
        F.when((v > 0) & (cap.x0 >= art.x1 - 3), "right")
        .when((v > 0) & (cap.x1 <= art.x0 + 3), "left")
        .when((h > 0) & (cap.y0 >= art.y1 - 3), "below")
        .when((h > 0) & (cap.y1 <= art.y0 + 3), "above")
        .otherwise("overlapping")
    )


def caption_nearest(caps: DataFrame, clusters: DataFrame) -> DataFrame:
    """Nearest cluster of each caption within max(35 % of the page width, 80).

    Captions without one stay, with nulls. Ties go to the lower cluster id. Pairs
    are reduced to one best row per caption before any shuffle."""
    cap, art = Box.of("l_"), Box.of("r_")
    left = prefixed(caps.select(*PAGE, "obj_id", *BOX, "page_w"), PAGE, "l_")
    limit = F.greatest(F.col("l_page_w") * 0.35, F.lit(80.0))
    pairs = near_pairs(left, prefixed(clusters, PAGE, "r_"), PAGE, limit, tiles=(128.0, 1024.0))
    d2 = distance2(art, cap)
    best = (
        pairs.withColumn("d2", d2)
        .filter(F.col("d2") <= limit * limit)
        .groupBy(*PAGE, F.col("l_obj_id").alias("obj_id"))
        .agg(
            F.min_by(
                F.struct(
                    F.col("r_cluster_id").alias("cluster_id"),
                    *art.columns("art_"),
                    *[F.col(f"r_{c}").alias(c) for c in ("drawing_count", "drawing_items", "image_count")],
                    "d2",
                ),
                F.struct("d2", "r_cluster_id"),
            ).alias("best")
        )
    )
    out = caps.select(*PAGE, "obj_id", "figure_id", "text", *BOX, "page_w", "page_h").join(best, [*PAGE, "obj_id"], "left")
    out = out.select(*[c for c in out.columns if c != "best"], "best.*")
    side = F.when(F.col("cluster_id").isNotNull(), caption_side(Box.of("art_"), Box.of()))
    return out.withColumn("caption_side", side)


def text_in_art_count(objects: DataFrame, nearest: DataFrame) -> DataFrame:
    """Text lines (captions excluded) that meet each used art box grown by 4."""
    arts = (
        nearest.filter("cluster_id is not null")
        .select(*PAGE, "cluster_id", *[F.col(f"art_{c}").alias(c) for c in BOX], "page_w", "page_h")
        .distinct()
    )
    grown = Box.of().grow(4.0).clip(page_box())
    arts = arts.select(*PAGE, F.col("cluster_id").alias("l_cluster_id"), *grown.columns("l_"))
    lines = objects.filter("kind = 'text'").filter(~F.col("text").rlike(CAPTION) & (F.trim("text") != ""))
    lines = shared_table(lines.groupBy(*PAGE, *BOX).agg(F.count("*").alias("n")), "text-lines")
    hits = near_pairs(arts, prefixed(lines, PAGE, "r_"), PAGE, 0.0).filter(intersects(Box.of("l_"), Box.of("r_")))
    counts = hits.groupBy(*PAGE, F.col("l_cluster_id").alias("cluster_id")).agg(F.sum("r_n").alias("text_lines"))
    return (
        nearest.filter("cluster_id is not null")
        .select(*PAGE, "obj_id", "cluster_id")
        .join(counts, [*PAGE, "cluster_id"], "left")
        .select(*PAGE, "obj_id", "cluster_id", F.coalesce("text_lines", F.lit(0)).cast("bigint").alias("text_lines"))
    )


def strategy_from_geometry(nearest: DataFrame, counts: DataFrame) -> DataFrame:
    """Reconstruct simple vector art, crop everything else; with the reason."""
    joined = nearest.join(counts.select(*PAGE, "obj_id", "text_lines"), [*PAGE, "obj_id"], "left")
    lines = F.coalesce("text_lines", F.lit(0))
    simple = (
        (F.col("image_count") == 0)
        & F.col("drawing_count").between(1, 80)
        & (F.col("drawing_items") <= 500)
        & (lines <= 40)
    )
    none = F.col("cluster_id").isNull()
    return joined.select(
        *PAGE,
        "obj_id",
        "figure_id",
        F.when(~none & simple, RECONSTRUCT).otherwise(RASTER).alias("strategy"),
        F.when(none, "No reliable vector or embedded-image region was detected near the caption.")
        .when(
            simple,
            F.concat(
                F.lit("Simple vector diagram: "), F.col("drawing_count"), F.lit(" drawing objects, "),
                lines, F.lit(" text lines, no embedded raster image."),
            ),
        )
        .when(F.col("image_count") > 0, "Embedded raster image detected; preserve it with a PDF crop.")
        .otherwise("Vector content is too complex for reliable semantic reconstruction.")
        .alias("reason"),
    )


def protected_region_exclude(spans: DataFrame, crops: DataFrame) -> DataFrame:
    """Text spans not covered by half or more of their area by a protected crop."""
    crops = shared_table(crops.select(*PAGE, *BOX).distinct(), "crops")
    pairs = near_pairs(
        prefixed(spans.select(*PAGE, "obj_id", *BOX), PAGE, "l_"),
        prefixed(crops, PAGE, "r_"),
        PAGE,
        0.0,
    )
    span, crop = Box.of("l_"), Box.of("r_")
    covered = (
        pairs.filter((span.area > 0) & (span.clip(crop).area >= span.area * 0.5))
        .select(*PAGE, F.col("l_obj_id").alias("obj_id"))
        .distinct()
    )
    return spans.join(covered, [*PAGE, "obj_id"], "left_anti")


def box_snap(figures: DataFrame, objects: DataFrame, clusters: DataFrame, *, near: float = 24.0) -> DataFrame:
    """Snap planned boxes to page objects and record the rule that won.

    Raster: union of images that overlap well and have a similar area, else the
    nearest image within 24 if its area is similar. Vector: the pure-drawing cluster
    with the best overlap. Otherwise the planned box stays."""
    cand = Box.of().clip(page_box())
    figs = figures.select(*PAGE, "figure_id", "strategy", *cand.columns())
    a, b = Box.of("l_"), Box.of("r_")

    images = objects.filter("kind = 'image'").groupBy(*PAGE, *BOX).agg(F.min("obj_id").alias("obj_id"))
    left = prefixed(figs, PAGE, "l_")
    pairs = near_pairs(left.filter(F.col("l_strategy") == RASTER), prefixed(images, PAGE, "r_"), PAGE, near)
    good = (overlap_score(a, b) >= 0.2) & similar_area(a, b)
    when = lambda c: F.when(good, c)
    raster = pairs.groupBy(*PAGE, F.col("l_figure_id").alias("figure_id")).agg(
        F.min(when(b.x0)).alias("u_x0"),
        F.min(when(b.y0)).alias("u_y0"),
        F.max(when(b.x1)).alias("u_x1"),
        F.max(when(b.y1)).alias("u_y1"),
        F.min_by(
            F.struct(*b.columns("n_"), distance2(a, b).alias("n_d2"), similar_area(a, b).alias("n_ok")),
            F.struct(distance2(a, b), "r_obj_id"),
        ).alias("n"),
    )
    pure = clusters.filter("drawing_count > 0 and image_count = 0").select(*PAGE, "cluster_id", *BOX)
    over = near_pairs(left.filter(F.col("l_strategy") == RECONSTRUCT), prefixed(pure, PAGE, "r_"), PAGE, 0.0)
    score = overlap_score(a, b)
    vector = (
        over.filter(score >= 0.2)
        .groupBy(*PAGE, F.col("l_figure_id").alias("figure_id"))
        .agg(F.max_by(F.struct(*b.columns("v_")), F.struct(score, -F.col("r_cluster_id"))).alias("v"))
    )
    joined = figs.join(raster, [*PAGE, "figure_id"], "left").join(vector, [*PAGE, "figure_id"], "left")
    near_ok = F.coalesce((F.col("n.n_d2") <= near * near) & F.col("n.n_ok"), F.lit(False))
    union_ok, vector_ok = F.col("u_x0").isNotNull(), F.col("v").isNotNull()
    pick = lambda c: (
        F.when(union_ok, F.col(f"u_{c}")).when(near_ok, F.col(f"n.n_{c}")).when(vector_ok, F.col(f"v.v_{c}")).otherwise(F.col(c))
    )
    return joined.select(
        *PAGE,
        "figure_id",
        *[pick(c).alias(c) for c in BOX],
        F.when(union_ok | near_ok, "embedded-image").when(vector_ok, "pdf-vector").otherwise("agent-region").alias("snapped_to"),
    )


def full_page_cover(objects: DataFrame, plan_figures: DataFrame) -> DataFrame:
    """First pages that are one scan and have no figure planned as reconstructed."""
    share = Box.of().clip(page_box()).area / (F.col("page_w") * F.col("page_h"))
    covers = (
        objects.filter("page = 1 and kind = 'image'")
        .groupBy(*PAGE)
        .agg(F.max(share).alias("share"))
        .filter("share >= 0.9")
    )
    rebuilt = plan_figures.filter(F.col("strategy") == RECONSTRUCT).select(*PAGE)
    return covers.join(rebuilt, PAGE, "left_anti")


def content_bounds_density(objects: DataFrame) -> DataFrame:
    """Union box of text and images, free height share, density label and fit policy."""
    rows = objects.filter("kind = 'image' or (kind = 'text' and trim(text) <> '')")
    agg = rows.groupBy(*PAGE).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.count_if(F.col("kind") == "text").alias("text_blocks"),
        F.count_if(F.col("kind") == "image").alias("images"),
        F.max("page_h").alias("page_h"),
    )
    free = (F.col("page_h") - (F.col("y1") - F.col("y0"))) / F.col("page_h")
    return agg.withColumn("_f", free).select(
        *PAGE, *BOX, "text_blocks", "images",
        F.round("_f", 4).alias("free_ratio"),
        F.when(F.col("_f") >= 0.14, "roomy")
        .when(F.col("_f") >= 0.06, "balanced")
        .when(F.col("_f") >= 0, "tight")
        .otherwise("overfull-source")
        .alias("density"),
        F.when(F.col("_f") >= 0.06, 10.5).otherwise(11.0).alias("min_body_font_pt"),
        (F.col("_f") >= 0.14).alias("allow_global_scale"),
        (F.col("_f") < 0.06).alias("allow_split"),
    )


def chrome_detect(objects: DataFrame) -> DataFrame:
    """Header and footer text of a book from the text lines of its first page."""
    lines = objects.filter("page = 1 and kind = 'text'").withColumn("t", F.trim("text")).filter("t <> ''")
    order = F.struct("y0", "x0", "obj_id")
    domain = F.regexp_extract("t", r"(?i)(www\.\S+|[\w.-]+\.(?:com|org|net|edu)\b)", 1)
    top = (F.col("y0") < 140) & (domain != "")
    bottom = F.col("y0") > F.col("page_h") - 80
    right = bottom & F.col("t").contains("Copyright")
    left = bottom & ~F.col("t").contains("Copyright") & (F.length("t") > 3) & ~F.col("t").rlike(r"^\d+$")
    found = lines.groupBy("book").agg(
        F.min_by(F.when(top, domain), F.when(top, order)).alias("head_left"),
        F.min_by(F.when(left, F.col("t")), F.when(left, order)).alias("foot_left"),
        F.max_by(F.when(right, F.col("t")), F.when(right, order)).alias("foot_right"),
    )
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("head_left", "foot_left", "foot_right")]
    return found.select("book", *blank).filter("head_left <> '' or foot_left <> '' or foot_right <> ''")


def caption_bands(caps: DataFrame, objects: DataFrame) -> DataFrame:
    """Free y-range above and below each caption.

    Above starts after the previous caption (+4) or at 50. Below ends before the next
    caption, the next listing line and the footer. Captions and listing lines of a page
    are ordered in one window, of a crowded page in buckets; both inputs are read more than once."""
    text = objects.filter("kind = 'text'")
    footer = text.filter(F.col("text").contains("Copyright")).groupBy(*PAGE).agg((F.min("y0") - 4).alias("_footer"))
    listings = text.filter(F.col("text").contains("Listing"))
    crowded = crowded_pages(caps, listings, PAGE)
    whole = crowded.isEmpty()

    def in_order(df: DataFrame, order: list[str], bucket: Column, **columns) -> DataFrame:
        if whole:
            return whole_columns(df, PAGE, order, **columns)
        few = whole_columns(df.join(crowded, PAGE, "left_anti"), PAGE, order, **columns)
        return few.unionByName(ordered_columns(df.join(crowded, PAGE, "left_semi"), PAGE, order, bucket, **columns))

    ranked = in_order(
        caps.select(*PAGE, "obj_id", "figure_id", *BOX, "page_w", "page_h"),
        ["y0", "x0", "obj_id"], _order_bucket(), lags={"prev_y1": "y1"}, leads={"next_y0": "y0"},
    )
    # next listing at or below a caption: walk positions from the bottom of the page up
    none = F.lit(None).cast("double")
    marks = listings.groupBy(*PAGE, "y0").agg(F.lit(0).alias("_q")).select(
        *PAGE, (-F.col("y0")).alias("_up"), "_q", F.lit(0).cast("bigint").alias("obj_id"), F.col("y0").alias("_listing")
    )
    asks = caps.select(*PAGE, (-(F.col("y1") - 2)).alias("_up"), F.lit(1).alias("_q"), "obj_id", none.alias("_listing"))
    below = in_order(marks.unionByName(asks), ["_up", "_q", "obj_id"], F.floor(F.col("_up") / 16), lasts={"listing_y": "_listing"})
    below = below.filter("_q = 1").select(*PAGE, "obj_id", "listing_y")
    out = ranked.join(below, [*PAGE, "obj_id"]).join(footer, PAGE, "left")
    foot = F.coalesce("_footer", F.col("page_h") - 48)
    nxt = F.coalesce("next_y0", foot) - 4
    return out.select(
        *PAGE, "obj_id", "figure_id", *BOX, "page_w", "page_h",
        F.coalesce(F.col("prev_y1") + 4, F.lit(50.0)).alias("above_y0"),
        (F.col("y0") - 2).alias("above_y1"),
        (F.col("y1") + 2).alias("below_y0"),
        F.least(nxt, F.coalesce(F.col("listing_y") - 4, nxt), foot).alias("below_y1"),
    )


def band_objects(objects: DataFrame) -> DataFrame:
    """Art and diagram-like text. Where objects say which drawings are filled
    but not stroked (fill_only), those as high as a line of text are highlights and no art."""
    box = Box.of()
    whole = (box.width > F.col("page_w") * 0.9) & (box.height > F.col("page_h") * 0.9)
    marked = F.coalesce(F.col("fill_only"), F.lit(False)) if "fill_only" in objects.columns else F.lit(False)
    highlight = marked & box.height.between(*HIGHLIGHT_HEIGHT)
    drawing = (F.col("kind") == "drawing") & ~whole & ~highlight & ~((box.width < 8) & (box.height < 8))
    t = F.trim("text")
    starts = F.lit(False)
    for p in DIAGRAM_PREFIXES:
        starts = starts | t.startswith(p)
    diagram = (
        (F.col("kind") == "text") & (t != "") & (F.length(t) <= 80)
        & (starts | t.isin(DIAGRAM_NAMES) | t.contains(" : "))
    )
    keep = drawing | (F.col("kind") == "image") | diagram
    return objects.filter(keep).select(*PAGE, *BOX, "page_h")


def band_union(bands: DataFrame, objects: DataFrame, *, buckets: int = 32) -> DataFrame:
    """Union box of art inside the band above and below each caption.

    Pages with few bands and rows of art are joined whole. A crowded page's height is cut
    into buckets. Union boxes may count art twice, so a band takes one row of extremes for
    each bucket it spans whole, and looks at single rows only in the buckets of its two
    ends. Bands depend only on y, so art of one (y0, y1) collapses there to one x-range. A
    band turned upside down takes art that covers it. Both inputs are read more than once."""
    step = F.greatest(F.col("page_h") / buckets, F.lit(1.0))
    at = lambda y: F.least(F.greatest(F.floor(y / step), F.lit(-1)), F.lit(buckets))
    sides = bands.select(
        *PAGE, "obj_id", "page_h",
        F.inline(
            F.array(
                F.struct(F.lit("above").alias("band"), F.col("above_y0").alias("b0"), F.col("above_y1").alias("b1")),
                F.struct(F.lit("below").alias("band"), F.col("below_y0").alias("b0"), F.col("below_y1").alias("b1")),
            )
        ),
    )
    art = band_objects(objects)
    reach = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    meet = (F.col("y1") >= F.col("b0")) & (F.col("y0") <= F.col("b1"))
    # partitions by page serve the join and the groups, so the pairs are not shuffled
    whole = lambda some: some.join(art.drop("page_h"), PAGE).filter(meet).groupBy(*PAGE, "obj_id", "band").agg(*reach)
    crowded = crowded_pages(sides, art, PAGE)
    if crowded.isEmpty():
        return whole(sides.drop("page_h"))
    few = whole(sides.join(crowded, PAGE, "left_anti").drop("page_h"))
    sides = sides.join(crowded, PAGE, "left_semi")
    sides = sides.select(*PAGE, "obj_id", "band", "b0", "b1", at(F.col("b0")).alias("_low"), at(F.col("b1")).alias("_high"))
    rows = art.join(crowded, PAGE, "left_semi").groupBy(*PAGE, "y0", "y1").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("page_h").alias("page_h"))
    rows = rows.withColumn("_at", F.explode(F.sequence(at(F.col("y0")), at(F.col("y1"))))).drop("page_h")
    between = F.when(F.col("_high") - F.col("_low") > 1, F.sequence(F.col("_low") + 1, F.col("_high") - 1))
    inner = sides.withColumn("_at", F.explode(between)).join(rows.groupBy(*PAGE, "_at").agg(*reach), [*PAGE, "_at"])
    ends = sides.withColumn("_at", F.explode(F.array_distinct(F.array("_low", F.greatest("_low", "_high"))))).join(rows, [*PAGE, "_at"])
    ends = ends.filter(meet)
    found = [df.groupBy(*PAGE, "obj_id", "band").agg(*reach) for df in (inner, ends)]
    return few.unionByName(found[0].unionByName(found[1]).groupBy(*PAGE, "obj_id", "band").agg(*reach))


def caption_crop_window(bands: DataFrame, unions: DataFrame) -> DataFrame:
    """Vertical crop range per caption from the art band with the smaller gap."""
    # one row per caption with both sides, so that the unions are computed once
    both = unions.groupBy(*PAGE, "obj_id").agg(
        *[F.max(F.when(F.col("band") == name, F.col(y))).alias(f"{name}_a{i}") for name in ("above", "below") for i, y in enumerate(("y0", "y1"))]
    )
    j = bands.join(both, [*PAGE, "obj_id"], "left")
    c0, c1 = F.col("y0"), F.col("y1")

    def gap(name: str) -> Column:
        a0, a1 = F.col(f"{name}_a0"), F.col(f"{name}_a1")
        value = F.when(a1 <= c0, c0 - a1).when(a0 >= c1, a0 - c1).otherwise(0.0)
        return F.when(a0.isNotNull(), value)

    up, down = gap("above"), gap("below")
    side_of = (
        F.when(up.isNotNull() & (down.isNull() | (up <= down)), "above").when(down.isNotNull(), "below").otherwise("none")
    )
    low = (
        F.when(side_of == "above", F.greatest(F.lit(50.0), F.col("above_a0") - 8))
        .when(side_of == "below", F.greatest(c0 - 6, F.col("below_a0") - 8))
        .otherwise(F.greatest(F.lit(50.0), c0 - 120))
    )
    high = (
        F.when(side_of == "above", F.least(c1 + 10, F.col("above_a1") + 10))
        .when(side_of == "below", F.least(F.col("below_y1"), F.col("below_a1") + 12))
        .otherwise(F.least(F.col("below_y1"), c1 + 80))
    )
    out = j.select(
        *PAGE, "obj_id", "figure_id", side_of.alias("side"),
        F.least(low, c0 - 4).alias("crop_y0"), F.greatest(high, c1 + 4).alias("crop_y1"),
    )
    return out.filter(F.col("crop_y1") - F.col("crop_y0") >= 24)


def ordinal_pairing(expected: DataFrame, objects: DataFrame, caps: DataFrame) -> DataFrame:
    """Pair i-th expected figure with i-th image where a page has no captions and equal counts.

    expected(book, page, seq, figure_id)."""
    images = objects.filter("kind = 'image'")
    n_exp = expected.groupBy(*PAGE).agg(F.count("*").alias("n"))
    n_img = images.groupBy(*PAGE).agg(F.count("*").alias("n"))
    fit = n_exp.join(n_img, [*PAGE, "n"]).select(*PAGE).join(caps.select(*PAGE).distinct(), PAGE, "left_anti")
    wanted = ordered_columns(
        expected.join(fit, PAGE, "left_semi"), PAGE, ["seq"], F.floor(F.col("seq") / 4096), rank="rn"
    )
    shown = ordered_columns(
        images.join(fit, PAGE, "left_semi"), PAGE, ["y0", "x0", "obj_id"], _order_bucket(), rank="rn"
    )
    crop = Box.of().grow(7.0).clip(page_box())
    return wanted.join(shown, [*PAGE, "rn"]).select(*PAGE, "rn", "figure_id", "obj_id", *crop.columns())


def expected_figure_fill(caps: DataFrame, expected: DataFrame, crops: DataFrame, canonical) -> DataFrame:
    """Captions a page references, plus planned raster crops for referenced ids without one, in reading order.

    crops(book, page, figure_id, x0..y1); canonical maps an id column to its comparable form."""
    key = canonical(F.col("figure_id")).alias("canon")
    wanted = expected.select(*PAGE, key).distinct()
    known = caps.select(*PAGE, key, "figure_id", F.lit("caption").alias("origin"), *BOX).join(
        wanted, [*PAGE, "canon"], "left_semi"
    )
    rest = wanted.join(known.select(*PAGE, "canon").distinct(), [*PAGE, "canon"], "left_anti")
    planned = crops.select(*PAGE, key, "figure_id", F.lit("plan").alias("origin"), *BOX).filter("x1 > x0 and y1 > y0")
    planned = planned.groupBy(*PAGE, "canon").agg(
        F.max_by(F.struct("figure_id", "origin", *BOX), F.struct("figure_id", *BOX)).alias("p")
    )
    filled = planned.join(rest, [*PAGE, "canon"], "left_semi").select(*PAGE, "canon", "p.*")
    rows = known.unionByName(filled)
    return ordered_columns(rows, PAGE, ["y0", "x0", "canon", "figure_id", "x1", "y1"], _order_bucket(), rank="rank")
