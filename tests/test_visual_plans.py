"""Plan documents: every rule of the contract, protected regions and finalised boxes."""

import json

from conftest import rows

from leafaudit.operators import boxes, figures, visual_plans

DOCS = "book string, page long, json string, page_w double, page_h double"
OBJECTS = "book string, page long, obj_id long, kind string, x0 double, y0 double, x1 double, y1 double, text string, n_items long, page_w double, page_h double"


def documents(spark, plans):
    texts = [(p, t if isinstance(t, str) or t is None else json.dumps(t)) for p, t in plans]
    return spark.createDataFrame([("b", p, t, 600.0, 800.0) for p, t in texts], DOCS)


def figure(**given):
    return {"id": "1", "type": "photo", "strategy": "extract-raster", "bbox_normalized": [0.1, 0.1, 0.5, 0.5]} | given


def layout(**given):
    return {"mode": "source-anchored", "regions": [{"id": "r", "bbox_normalized": [0, 0, 1, 0.5], "fill_color": "#fff"}]} | given


def test_every_rule_of_the_contract(spark):
    sheet = figure(type="Composite engineering_sheet", bbox_normalized=[0, 0, 1, 1], strategy="reconstruct-html-svg")
    cases = [
        ({"figures": [figure()]}, []),
        ({"figures": []}, []),
        ("[1]", [("plan object", "")]),
        ('{"figures": [', [("plan object", "")]),
        (None, [("plan object", "")]),
        ({"page": 99, "figures": []}, [("page number", "99")]),
        ({"page": None, "figures": []}, [("page number", "")]),
        ({"figures": {}}, [("figures array", "")]),
        ({}, [("figures array", "")]),
        ({"figures": [], "page_layout": None}, []),
        ({"figures": [], "page_layout": "flow"}, [("layout object", "")]),
        ({"figures": [], "page_layout": {}}, [("layout mode", "")]),
        ({"figures": [], "page_layout": {"mode": " flow "}}, []),
        ({"figures": [], "page_layout": layout()}, []),
        ({"figures": [], "page_layout": layout(regions=[])}, [("regions required", "")]),
        ({"figures": [], "page_layout": layout(regions={"id": 1})}, [("regions required", "")]),
        ({"figures": [], "page_layout": layout(regions=["r", {"id": " ", "bbox_normalized": [0, 0, 1, 1], "text_color": "x"}])}, [("region object", ""), ("unique region id", "")]),
        ({"figures": [], "page_layout": layout(regions=[{"id": "a", "bbox_normalized": [0, 0, 1, 2], "fill_color": " "}])}, [("region bbox", "a"), ("region colour", "a")]),
        ({"figures": [], "page_layout": layout(mode="flow", regions=["r"])}, []),
        ({"figures": [7, None]}, [("figure object", ""), ("figure object", "")]),
        ({"figures": [figure(), figure(id=" 1 "), figure(id=None), figure(id=2)]}, [("unique figure id", ""), ("unique figure id", "1")]),
        ({"figures": [figure(strategy="guess")]}, [("figure strategy", "1")]),
        ({"figures": [figure(bbox_normalized=[0, 0, "0.5", 0.5])]}, []),
        ({"figures": [figure(bbox_normalized=[0, 0, 2, 2])]}, [("figure bbox", "1")]),
        ({"figures": [figure(bbox_normalized=[0, 0, 2, 2], art_bbox=[5, 5, 90, 90])]}, []),
        ({"figures": [figure(bbox_normalized=None, art_bbox=[5, 5, 90])]}, [("figure bbox", "1")]),
        ({"figures": [figure(caption_bbox_normalized=None)]}, []),
        ({"figures": [figure(caption_bbox_normalized=[0, 0, 0, 0])]}, [("caption bbox", "1")]),
        ({"figures": [figure(caption_bbox_normalized="none")]}, [("caption bbox", "1")]),
        ({"figures": [sheet], "page_layout": {"mode": "flow", "facsimile": True}}, []),
        ({"figures": [figure()], "page_layout": {"mode": "flow", "facsimile": True}}, [("facsimile sheet", "")]),
        ({"figures": [figure()], "page_layout": {"mode": "flow", "facsimile": "true"}}, []),
    ]
    plans = [(i, {"page": i, **p} if isinstance(p, dict) else p) for i, (p, _) in enumerate(cases)]
    found = {}
    for page, rule, subject in rows(visual_plans.plan_contract_violations(documents(spark, plans)), "page", "rule", "subject"):
        found.setdefault(page, []).append((rule, subject))
    assert found == {i: sorted(want) for i, (_, want) in enumerate(cases) if want}


def test_a_sheet_counts_by_the_strategy_the_type_rules_leave(spark):
    sheet = figure(type="composite-engineering-sheet", bbox_normalized=[0, 0, 1, 1])
    tree, rebuild = {"label": "Family tree of kings"}, {"strategy": "reconstruct-html-svg"}
    given = [sheet, sheet | rebuild, sheet | tree, sheet | tree | rebuild, sheet | {"complexity": "basic"}, sheet | rebuild | {"complexity": "basic"}, sheet | tree | {"complexity": "basic"}]
    plans = [(i, {"page": i, "figures": [f], "page_layout": {"mode": "flow", "facsimile": True}}) for i, f in enumerate(given)]
    broken = {r.page for r in visual_plans.plan_contract_violations(documents(spark, plans)).collect()}
    rows_ = spark.createDataFrame([(i, f["type"], f.get("complexity", ""), f.get("label", ""), f["strategy"]) for i, f in enumerate(given)], "page long, type string, complexity string, label string, strategy string")
    assert broken == {r.page for r in figures.strategy_override(rows_).filter("strategy <> 'extract-raster'").collect()} == {2, 6}


def test_protected_regions_come_from_crop_art_or_normalised_box(spark):
    given = [
        figure(crop_bbox=[10, 10, 50, 50], art_bbox=[0, 0, 5, 5]), figure(crop_bbox=[], art_bbox=[20, 20, 60, 900]), figure(crop_bbox=[9, 9, 1, 1], art_bbox=[0, 0, 5, 5]),
        figure(bbox_normalized=[0, 0, 2, 2]), figure(strategy="reconstruct-html-svg"), figure(crop_bbox=[700, 10, 750, 50]),
    ]
    docs = documents(spark, [(1, {"page": 1, "figures": given}), (2, "[1]")])
    assert rows(visual_plans.protected_crops(docs)) == [("b", 1, 10.0, 10.0, 50.0, 50.0), ("b", 1, 20.0, 20.0, 60.0, 800.0), ("b", 1, 60.0, 80.0, 300.0, 400.0)]


def test_pages_without_words_need_a_raster_or_facsimile(spark):
    text = lambda page, words, x=500.0: ("b", page, page, "text", x, 500.0, x + 20, 510.0, words, 0, 600.0, 800.0)
    spans = spark.createDataFrame([text(1, "word"), text(2, "..."), text(3, "..."), text(4, "inside", 100.0)], OBJECTS)
    plan = figure(bbox_normalized=[0, 0, 0.5, 1])
    docs = documents(spark, [(3, {"figures": [plan]}), (4, {"figures": [plan]}), (5, {"page_layout": {"facsimile": True}}), (6, {"figures": [figure(strategy="reconstruct-html-svg")]})])
    pages = spark.createDataFrame([("b", p) for p in range(1, 8)], "book string, page long")
    assert rows(visual_plans.sourceless_pages(pages, spans, docs), "page") == [(2,), (6,), (7,)]


def test_finalised_boxes_snap_to_the_page(spark):
    obj = lambda page, i, kind, *box: ("b", page, i, kind, *map(float, box), "", 1, 600.0, 800.0)
    objects = spark.createDataFrame(
        [obj(1, 1, "image", 0, 0, 600, 780), obj(2, 1, "image", 0, 0, 600, 790), obj(3, 1, "image", 62, 82, 298, 402), obj(3, 2, "drawing", 310, 500, 420, 600), obj(3, 3, "image", 555, 85, 590, 120)], OBJECTS
    )
    rebuild = {"strategy": "reconstruct-html-svg", "type": "flowchart"}
    docs = documents(spark, [
        (1, {"page": 1, "figures": [figure()]}),
        (2, {"page": 2, "figures": [figure(caption_bbox_normalized=[0, 0.5, 1, 0.6])]}),
        (3, {"page": 3, "figures": [figure(), figure(id="2", bbox_normalized=[0.5, 0.6, 0.7, 0.75], **rebuild), figure(id="3", bbox_normalized=[7, 7, 8, 8], art_bbox=[560, 60, 700, 80]), figure(id="4", type="map", strategy="reconstruct-html-svg", bbox_normalized=[0, 0.9, 0.1, 1])]}),
        (4, {"page": 4, "figures": [figure(), figure()]}),
    ])
    got = visual_plans.finalise_plans(docs, objects, boxes.visual_clusters(objects))
    assert rows(got, "page", "figure_id", "strategy", "snapped_to", "art_x0", "art_y0", "art_x1", "art_y1") == [
        (1, "1", "extract-raster", "full-page-embedded-image", 0.0, 0.0, 600.0, 800.0),
        (2, "1", "extract-raster", "agent-region", 60.0, 80.0, 300.0, 400.0),
        (3, "1", "extract-raster", "embedded-image", 62.0, 82.0, 298.0, 402.0),
        (3, "2", "reconstruct-html-svg", "pdf-vector", 310.0, 500.0, 420.0, 600.0),
        (3, "3", "extract-raster", "embedded-image", 555.0, 85.0, 590.0, 120.0),
        (3, "4", "extract-raster", "agent-region", 0.0, 720.0, 60.0, 800.0),
    ]
    assert rows(got.filter("page = 2"), "caption_y0", "caption_y1", "crop_x0", "crop_y1") == [(400.0, 480.0, 53.0, 407.0)]
    assert rows(got.filter("figure_id = '4'"), "overridden_from", "crop_x0", "crop_y1", "caption_x0") == [("reconstruct-html-svg", 0.0, 800.0, None)]
