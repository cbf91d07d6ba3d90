"""Geometry against brute force on random pages, one of them crowded."""

import random

from conftest import rows
from pyspark.sql import functions as F

from leafaudit.functions import geometry
from leafaudit.functions.text import canonical_id
from leafaudit.operators import boxes, figures
from leafaudit.plans import box_jobs, derived
from leafaudit.plans.registry import Inputs

SCHEMA = (
    "book string, page long, obj_id long, kind string, x0 double, y0 double, x1 double, y1 double, text string, "
    "n_items long, page_w double, page_h double"
)


def scene(seed, crowd=150, sparse=25, pages=4):
    rng = random.Random(seed)
    out, i = [], 0
    for page in range(1, pages + 1):
        for _ in range(crowd if page == 1 else sparse):
            i += 1
            kind = rng.choice(["image", "drawing", "text"])
            x, y = round(rng.uniform(0, 580), 1), round(rng.uniform(0, 760), 1)
            w, h = round(rng.uniform(1, 45), 1), round(rng.uniform(1, 30), 1)
            text = rng.choice(["Figure 3.1 cap", "4. step", "plain", "class X", "Listing 2", "Hình 7: a", "Figures"]) if kind == "text" else ""
            out.append(("b", page, i, kind, x, y, x + w, y + h, text, rng.randint(1, 9), 600.0, 800.0))
            if rng.random() < 0.2:
                i += 1
                out.append(("b", page, i, kind, x, y, x + w, y + h, text, 1, 600.0, 800.0))
    return out


def d2(a, b):
    dx = max(a[4] - b[6], b[4] - a[6], 0.0)
    dy = max(a[5] - b[7], b[5] - a[7], 0.0)
    return dx * dx + dy * dy


def brute_clusters(data):
    narrow = {"image": any, "drawing": all}
    art = [o for o in data if o[3] != "text" and not narrow[o[3]]([o[6] - o[4] < 3, o[7] - o[5] < 3])]
    parent = {o[2]: o[2] for o in art}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(art):
        for b in art[i + 1 :]:
            if a[1] == b[1] and d2(a, b) <= 144:
                parent[find(a[2])] = find(b[2])
    found = {}
    for o in art:
        found.setdefault(find(o[2]), []).append(o)
    return sorted(
        (
            g[0][1], min(o[2] for o in g), min(o[4] for o in g), min(o[5] for o in g), max(o[6] for o in g), max(o[7] for o in g),
            sum(o[3] == "drawing" for o in g), sum(o[9] for o in g if o[3] == "drawing"), sum(o[3] == "image" for o in g),
        )
        for g in found.values()
    )


CLUSTER = ["page", "cluster_id", "x0", "y0", "x1", "y1", "drawing_count", "drawing_items", "image_count"]


def test_clusters_equal_brute_force(spark):
    for seed, crowd in ((1, 150), (2, 40)):
        data = scene(seed, crowd=crowd)
        got = rows(boxes.visual_clusters(spark.createDataFrame(data, SCHEMA)), *CLUSTER)
        assert got == brute_clusters(data)


def test_long_chain_is_one_cluster(spark):
    data = [("b", 1, i, "image", 20.0 * i, 5.0, 20.0 * i + 8, 15.0, "", 1, 9e9, 9e9) for i in range(1, 120)]
    got = rows(boxes.visual_clusters(spark.createDataFrame(data, SCHEMA)), "cluster_id", "image_count")
    assert got == [(1, 119)]


def test_captions_and_nearest_equal_brute_force(spark):
    data = scene(3)
    df = spark.createDataFrame(data, SCHEMA)
    caps = [o for o in data if o[8].startswith(("Figure ", "Hình "))]
    caps += [
        o for o in data if o[8] == "4. step" and any(i[1] == o[1] and i[3] == "image" and d2(o, i) <= 48 * 48 for i in data)
    ]
    cap_df = boxes.captions(df)
    assert rows(cap_df, "obj_id") == sorted((o[2],) for o in caps)
    clusters = brute_clusters(data)
    want = []
    for c in caps:
        near = []
        for k in clusters:
            box = (0, 0, 0, 0, k[2], k[3], k[4], k[5])
            if k[0] == c[1] and d2(box, c) <= 210.0**2:
                near.append((d2(box, c), k[1]))
        want.append((c[2], min(near)[1] if near else None))
    got = boxes.caption_nearest(cap_df, boxes.visual_clusters(df))
    assert rows(got, "obj_id", "cluster_id") == sorted(want)


def test_side_caption_of_a_simple_drawing(spark):
    mk = lambda i, kind, x0, y0, x1, y1, text="": ("b", 32, i, kind, x0, y0, x1, y1, text, 1, 600.0, 500.0)
    data = [
        mk(1, "drawing", 90.0, 70.0, 380.0, 300.0), mk(2, "drawing", 120.0, 110.0, 220.0, 180.0),
        mk(3, "drawing", 270.0, 110.0, 350.0, 180.0), mk(4, "text", 127.0, 138.0, 180.0, 150.0, "Inventory"),
        mk(5, "text", 405.0, 160.0, 560.0, 172.0, "Figure 1.1  Components are managed"),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    near = boxes.caption_nearest(boxes.captions(df), boxes.visual_clusters(df))
    r = boxes.strategy_from_geometry(near, boxes.text_in_art_count(df, near)).first()
    assert near.first().caption_side == "right" and r.figure_id == "1.1"
    assert r.strategy == "reconstruct-html-svg" and "3 drawing objects, 1 text lines" in r.reason


def test_band_union_and_window_equal_brute_force(spark):
    data = scene(4, crowd=60)
    df = spark.createDataFrame(data, SCHEMA)
    cap_df = boxes.captions(df)
    bands = boxes.caption_bands(cap_df, df)
    got = {(r.obj_id, r.band): (r.x0, r.y0, r.x1, r.y1) for r in boxes.band_union(bands, df).collect()}
    keep = [
        o for o in data
        if o[3] == "image" or (o[3] == "text" and o[8] == "class X") or (o[3] == "drawing" and not (o[6] - o[4] < 8 and o[7] - o[5] < 8))
    ]
    want = {}
    by_page = {}
    for r in cap_df.select("page", "obj_id", "x0", "y0", "y1").collect():
        by_page.setdefault(r.page, []).append((r.y0, r.x0, r.obj_id, r.y1))
    for page, caps in by_page.items():
        caps.sort()
        listings = [o[5] for o in data if o[1] == page and "Listing" in o[8]]
        for i, (y0, _, oid, y1) in enumerate(caps):
            nxt = caps[i + 1][0] if i + 1 < len(caps) else 752.0
            lst = min((y for y in listings if y >= y1 - 2), default=None)
            below1 = min(nxt - 4, lst - 4 if lst is not None else nxt - 4, 752.0)
            above0 = caps[i - 1][3] + 4 if i else 50.0
            for band, b0, b1 in (("above", above0, y0 - 2), ("below", y1 + 2, below1)):
                hit = [o for o in keep if o[1] == page and not (o[7] < b0 or o[5] > b1)]
                if hit:
                    want[(oid, band)] = (min(o[4] for o in hit), min(o[5] for o in hit), max(o[6] for o in hit), max(o[7] for o in hit))
    assert got == want
    windows = boxes.caption_crop_window(bands, boxes.band_union(bands, df))
    assert windows.filter("crop_y1 - crop_y0 < 24").count() == 0


def test_protected_regions(spark):
    span = ("b", 1, 1, "text", 10.0, 10.0, 30.0, 20.0, "a", 0, 600.0, 800.0)
    other = ("b", 1, 2, "text", 10.0, 40.0, 30.0, 50.0, "b", 0, 600.0, 800.0)
    crops = spark.createDataFrame([("b", 1, 20.0, 0.0, 99.0, 30.0), ("b", 1, 21.0, 0.0, 99.0, 60.0)], "book string, page long, x0 double, y0 double, x1 double, y1 double")
    got = boxes.protected_region_exclude(spark.createDataFrame([span, other], SCHEMA), crops)
    assert rows(got, "obj_id") == [(2,)]


def test_plan_must_be_covered_by_the_page(spark):
    plan = spark.createDataFrame(
        [("b", 10, "1", "photo", "", "Plate", "extract-raster", 1), ("b", 10, "1.1", "photo", "", "Plate", "reconstruct-html-svg", 2)],
        "book string, page long, figure_id string, type string, complexity string, label string, strategy string, seq long",
    )
    ids = figures.planned_ids(plan)
    pages = lambda html: spark.createDataFrame([("b", 10, html)], "book string, page long, html string")
    image = '<img src="../assets/images/page_0010_fig_1.png"><img src="page_0011_fig_9.png">'
    refs = figures.page_references(pages(image))
    assert rows(figures.plan_reconcile(ids, refs), "canon", "issue") == [("11", "vector figure without tag")]
    assert rows(figures.unrendered_ids(ids, refs), "canon", "lacking") == [("11", "tag")]
    full = figures.page_references(pages(image + '<figure data-visual-id="1.1"></figure>'))
    assert figures.plan_reconcile(ids, full).count() == 0
    icon = figures.page_references(pages('<img alt="exercise marker" src="page_0010_fig_1.png"><figure data-visual-id="1-1">'))
    assert rows(figures.forbidden_rasters(ids, icon), "canon") == [("1",)]


def test_strategy_rules(spark):
    cases = [
        ("family_tree", "Family Tree", "basic", "extract-raster", "reconstruct-html-svg", None),
        ("diagram", "Relationship exercise", "basic", "extract-raster", "reconstruct-html-svg", None),
        ("relationship-diagram", "x", "basic", "extract-raster", "reconstruct-html-svg", None),
        ("illustration", "Family tree diagram", "basic", "extract-raster", "reconstruct-html-svg", None),
        ("technical-drawing", "Dimensioned", None, "extract-raster", "extract-raster", 0.99),
        ("dense-technical-diagram", "Dimensioned", None, "extract-raster", "extract-raster", 0.99),
        ("diagram", "Detailed", "complex", "reconstruct-html-svg", "extract-raster", 0.99),
        ("photo", "x", None, "reconstruct-html-svg", "reconstruct-html-svg", None),
    ]
    df = spark.createDataFrame(
        [(i, *c[:4]) for i, c in enumerate(cases)], "i int, type string, label string, complexity string, strategy string"
    )
    got = figures.strategy_override(df).orderBy("i").collect()
    assert [(r.strategy, r.fidelity_target) for r in got] == [(c[4], c[5]) for c in cases]
    assert [r.overridden_from is not None for r in got] == [c[3] != c[4] for c in cases]


def test_display_size_comes_from_the_crop(spark):
    schema = "file string, width double, height double, raster_width double, raster_height double, display_width_pt double, display_height_pt double, clip array<double>"
    data = [
        ("images/a.png", 686.0, 1040.0, None, None, 246.56, 374.0, None),
        ("images/b.png", 686.0, 1040.0, None, None, None, None, [183.08, 186.68, 429.64, 560.68]),
        ("images/c.png", None, None, 12.5, 0.0, None, 5.0, [1.0, 2.0]),
        ("images/d.png", 1.0, 1.0, None, None, 0.1, 0.1, None),
    ]
    got = [
        (r.width_px, r.height_px, None if r.width_mm is None else round(r.width_mm, 3), r.file_name)
        for r in figures.display_dimensions(spark.createDataFrame(data, schema)).collect()
    ]
    assert got == [(329, 499, 86.981, "a.png"), (329, 499, 86.981, "b.png"), (12, 1, None, "c.png"), (1, 1, 0.035, "d.png")]


def test_expected_figures_are_filled_from_the_plan(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    caps = spark.createDataFrame([("b", 1, "1.1", 5.0, 50.0, 9.0, 60.0), ("b", 1, "2", 5.0, 5.0, 9.0, 9.0)], f"book string, page long, figure_id string, {box}")
    expected = spark.createDataFrame([("b", 1, "1-1"), ("b", 1, "7"), ("b", 1, "8")], "book string, page long, figure_id string")
    crops = spark.createDataFrame([("b", 1, "7", 1.0, 1.0, 2.0, 2.0), ("b", 1, "8", 1.0, 1.0, 1.0, 2.0)], f"book string, page long, figure_id string, {box}")
    got = boxes.expected_figure_fill(caps, expected, crops, canonical_id)
    assert rows(got, "rank", "canon", "origin") == [(1, "7", "plan"), (2, "11", "caption")]


def test_plan_documents_that_cannot_be_used_are_issues(spark):
    docs = spark.createDataFrame(
        [("b", 1, '{"page": 1, "figures": [{"id": "1", "strategy": "extract-raster"}]}'), ("b", 2, "[1]"), ("b", 3, '{"figures": [')],
        "book string, page long, json string",
    )
    source = spark.createDataFrame([("b", p) for p in (1, 2, 3, 4)], "book string, page long")
    got = rows(figures.plan_scan(docs, source), "page", "figure_id", "issue")
    assert got == [
        (1, "1", None), (2, None, "visual plan is not an object"), (3, None, "visual plan validation failed"),
        (4, None, "missing finalized visual plan"),
    ]


def test_absurd_coordinates_stay_cheap_and_exact(spark):
    far = [("b", 1, i, "image", 1e9 + 20.0 * i, -1e9, 1e9 + 20.0 * i + 10, -1e9 + 5, "", 1, 9e12, 9e12) for i in range(1, 6)]
    wide = [("b", 1, 9, "image", -1e8, 0.0, 1e8, 4.0, "", 1, 9e12, 9e12), ("b", 1, 10, "image", 5.0, 10.0, 9.0, 20.0, "", 1, 9e12, 9e12)]
    got = rows(boxes.visual_clusters(spark.createDataFrame(far + wide, SCHEMA)), "cluster_id", "image_count")
    assert got == [(1, 5), (9, 2)]


def crowded(seed, n, side=128.0):
    """n distinct boxes whose corners lie in one square, with a few large ones among them."""
    rng = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        x, y = rng.uniform(0, side), rng.uniform(0, side)
        w, h = (rng.uniform(100, 400), 5.0) if i % 1000 == 0 else (rng.uniform(3, 6), rng.uniform(3, 6))
        out.append(("b", 1, i, rng.choice(["image", "drawing"]), x, y, x + w, y + h, "", 1, 600.0, 800.0))
    return out


def test_grid_levels_find_every_near_pair(spark):
    from leafaudit.functions.geometry import near_pairs, prefixed

    rng = random.Random(9)
    scale = [0.01, 1.0, 30.0, 200.0, 5000.0, 1e7]
    mk = lambda i: (i % 2, i, rng.uniform(-300, 900) * (1e6 if i % 40 == 0 else 1), rng.uniform(-300, 900), rng.choice(scale), rng.choice(scale[:4]))
    data = [(p, i, x, y, x + w, y + h) for p, i, x, y, w, h in map(mk, range(300))]
    df = spark.createDataFrame(data, "page long, id long, x0 double, y0 double, x1 double, y1 double")
    for gap in (0.0, 12.0, 250.0):
        pairs = near_pairs(prefixed(df, ["page"], "l_"), prefixed(df, ["page"], "r_"), ["page"], gap)
        want = sorted((a[1], b[1]) for a in data for b in data if a[0] == b[0] and max(a[2] - gap, b[2]) <= min(a[4] + gap, b[4]) and max(a[3] - gap, b[3]) <= min(a[5] + gap, b[5]))
        assert rows(pairs, "l_id", "r_id") == want


def test_crowded_tile_runs_and_is_exact(spark):
    data = crowded(5, 3000)
    assert rows(boxes.visual_clusters(spark.createDataFrame(data, SCHEMA)), *CLUSTER) == brute_clusters(data)
    many = crowded(6, 100_000)
    got = boxes.visual_clusters(spark.createDataFrame(many, SCHEMA)).agg(F.sum(F.col("drawing_count") + F.col("image_count"))).first()[0]
    assert got == len(many)


def test_nodes_whose_farthest_boxes_miss_are_still_linked(spark):
    """Two cells touch only by boxes that are farthest in no direction."""
    mk = lambda i, x0, y0, x1, y1: ("b", 1, i, "image", float(x0), float(y0), float(x1), float(y1), "", 1, 9e9, 9e9)
    ring = [(-100, -3, 104, 7), (-3, -100, 7, 104), (-70, -70, 74, 74)]
    data = [mk(i + 1, *b) for i, b in enumerate(ring)] + [mk(9, 2, 120, 6, 124), mk(10, 200, 200, 210, 210), mk(11, 221, 205, 226, 212)]
    for seed in range(4):
        rng = random.Random(seed)
        some = [mk(20 + i, x, y, x + rng.uniform(3, 60), y + rng.uniform(3, 60)) for i, (x, y) in enumerate((rng.uniform(0, 400), rng.uniform(0, 400)) for _ in range(60))]
        assert rows(boxes.visual_clusters(spark.createDataFrame(data + some, SCHEMA)), *CLUSTER) == brute_clusters(data + some)


def test_highlights_are_no_art(spark):
    cap = ("b", 1, 1, "text", 10.0, 400.0, 90.0, 410.0, "Figure 1 x", 0, 600.0, 800.0, None)
    marks = [("b", 1, 2, "drawing", 10.0, 300.0, 90.0, 315.0, "", 1, 600.0, 800.0, True), ("b", 1, 3, "drawing", 20.0, 200.0, 80.0, 215.0, "", 1, 600.0, 800.0, False), ("b", 1, 4, "drawing", 30.0, 100.0, 80.0, 130.0, "", 1, 600.0, 800.0, True)]
    df = spark.createDataFrame([cap, *marks], SCHEMA + ", fill_only boolean")
    bands = boxes.caption_bands(boxes.captions(df), df)
    assert rows(boxes.band_union(bands, df), "band", "x0", "y0", "x1", "y1") == [("above", 20.0, 100.0, 80.0, 215.0)]


def test_the_band_job_takes_every_drawing(spark):
    inp = Inputs(spark, "/root/testdata/sf0.001")
    objs, found = box_jobs.bands(inp)
    cols = [*boxes.PAGE, "obj_id", "band", *boxes.BOX]
    every = boxes.band_union(found, inp.derive(derived.page_objects))
    assert rows(box_jobs.band_union(inp), *cols) == rows(every, *cols)
    painted = boxes.band_union(found, inp.derive(box_jobs._painted_objects))
    assert rows(painted, *cols) != rows(every, *cols)


def test_pages_with_few_boxes_meet_without_tiles(spark, monkeypatch):
    some = spark.createDataFrame(scene(5, crowd=150, sparse=25), SCHEMA)
    left, right = (geometry.prefixed(some.select("book", "page", "obj_id", *boxes.BOX), boxes.PAGE, p) for p in ("l_", "r_"))
    pairs = lambda: geometry.near_pairs(left, right, boxes.PAGE, 9.0)
    whole = pairs()
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    want = rows(whole, *boxes.PAGE, "l_obj_id", "r_obj_id")
    for few in (0, 60):
        monkeypatch.setattr(geometry, "FEW_ON_PAGE", few)
        assert "Generate" in pairs()._jdf.queryExecution().executedPlan().toString()
        assert rows(pairs(), *boxes.PAGE, "l_obj_id", "r_obj_id") == want


def test_plan_checks_take_no_join_and_no_sort(spark):
    plan = spark.createDataFrame(
        [("b", 1, f, "photo", "", "Plate", s, i) for i, (f, s) in enumerate([("1", "guess"), ("1.", "extract-raster"), ("2", "reconstruct-html-svg"), ("2.", "guess"), ("3", None)])]
        + [(None, 1, "4", "photo", "", "Plate", "extract-raster", 9)],
        "book string, page long, figure_id string, type string, complexity string, label string, strategy string, seq long",
    )
    refs = spark.createDataFrame([("b", 1, "9", "tag", False), (None, 1, "4", "image", False)], "book string, page long, canon string, via string, rebuild boolean")
    ids = figures.planned_kinds(plan)
    checked = figures.plan_reconcile(ids, refs)
    shape = checked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in shape and "SortAggregate" not in shape
    assert rows(checked, "canon", "issue") == rows(figures.plan_reconcile(figures.planned_ids(plan), refs), "canon", "issue")
    assert rows(checked, "canon", "issue") == [("1", "raster figure without image"), ("4", "raster figure without image"), ("4", "unplanned figure id"), ("9", "unplanned figure id")]
    assert rows(figures.unrendered_ids(ids, refs), "canon", "lacking") == [("1", "image"), ("4", "image")]


def test_kept_objects_serve_later_views(spark):
    inp = Inputs(spark, "/root/testdata/sf0.001")
    before = rows(inp.derive(derived.plan_figures), "obj_id", "figure_id")
    inp.keep_objects()
    later = inp.derive(derived.plan_figures)
    assert rows(later, "obj_id", "figure_id") == before
    assert all("lineitem" not in f for f in later.inputFiles())


def test_first_issues_are_those_of_all_messages(spark):
    from leafaudit.operators import layout
    from leafaudit.plans import figure_jobs

    every = figure_jobs.measured(Inputs(spark, "/root/testdata/sf0.001")).limit(2000)
    blank = every.limit(60).select(*[F.lit(None).cast(t).alias(c) if c in ("width", "o_left", "sheet_count", "clip_x") else F.col(c) for c, t in every.dtypes])
    mixed = every.unionByName(blank).unionByName(every.limit(9))
    m = spark.createDataFrame(mixed.collect(), mixed.schema)
    keys = ["book", "page", "sheet"]
    assert m.filter(layout.has_issue()).count() == layout.layout_metric_issues(m.withColumn("n", F.monotonically_increasing_id()), [*keys, "n"]).select("n").distinct().count()
    want = layout.issue_cap(layout.layout_metric_issues(m, keys).withColumn("seq", F.struct("sheet", "seq")), keys[:2])
    assert rows(layout.first_issues(m, keys[:2], "sheet"), *keys, "rk") == rows(want, *keys, "rk") != []


def test_bands_are_equal_on_sparse_and_crowded_pages(spark, monkeypatch):
    df = spark.createDataFrame(scene(4, crowd=60), SCHEMA)
    found = []
    for few in (256, 40, 0):  # no page, one page, every page is crowded
        monkeypatch.setattr(geometry, "FEW_ON_PAGE", few)
        bands = boxes.caption_bands(boxes.captions(df), df)
        unions = boxes.band_union(bands, df)
        found.append([rows(out) for out in (bands, unions, boxes.caption_crop_window(bands, unions))])
    assert found[0] == found[1] == found[2] and all(found[0])


def test_sparse_pages_are_not_bucketed_and_unions_read_once(spark, tmp_path):
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    df = spark.createDataFrame(scene(4, crowd=60), SCHEMA)
    bands = boxes.caption_bands(boxes.captions(df), df)
    assert "_bucket" not in plan(bands)
    bands.write.parquet(f"{tmp_path}/bands")
    bands = spark.read.parquet(f"{tmp_path}/bands")
    unions = boxes.band_union(bands, df)
    assert "sequence(" not in plan(unions)
    unions.write.parquet(f"{tmp_path}/unions")
    assert plan(boxes.caption_crop_window(bands, spark.read.parquet(f"{tmp_path}/unions"))).count("Relation ") == 2
