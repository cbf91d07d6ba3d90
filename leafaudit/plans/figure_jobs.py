"""Jobs on plans, manifests and page references."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafaudit.operators import figures, layout, visual_plans
from leafaudit.plans import derived as dv
from leafaudit.plans.registry import Inputs, job

CANON = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


def manifest_rows(d) -> str:
    """Figure manifest entries: images of every page with the sizes that are known."""
    return f"""
    SELECT book, page, obj_id, concat('page_', {d.pad4('page')}) AS page_key, concat('images/p_', {d.ntext('obj_id')}, '.png') AS file,
           CASE WHEN obj_id % 3 = 0 THEN x1 - x0 END AS dw, CASE WHEN obj_id % 3 = 0 THEN y1 - y0 END AS dh,
           CASE WHEN obj_id % 3 = 1 THEN x0 END AS c0, y0 AS c1, x1 AS c2, y1 AS c3, CAST(pk % 900 AS DOUBLE) AS rw, CAST(pk % 700 AS DOUBLE) AS rh
    FROM ({dv.page_objects(d)}) o WHERE kind = 'image'"""


def manifest_docs(d) -> str:
    """Manifest JSON: a map with one page per document."""
    num = lambda c: f"coalesce({d.ntext(c)}, 'null')"
    entry = f"""concat('{{"figure": "', {d.ntext('obj_id')}, '", "file": "', file, '", "display_width_pt": ', {num('dw')}, ', "display_height_pt": ', {num('dh')},
      ', "width": ', {num('rw')}, ', "height": ', {num('rh')}, CASE WHEN c0 IS NULL THEN '' ELSE concat(', "clip": [', {num('c0')}, ', ', {num('c1')}, ', ', {num('c2')}, ', ', {num('c3')}, ']') END, '}}')"""
    return f"""
    SELECT book, concat('{{"', page_key, '": [', {d.string_agg(entry, ', ', 'obj_id')}, ']}}') AS json
    FROM ({manifest_rows(d)}) m GROUP BY book, page_key"""


@job(
    "figure_manifest_scan",
    lambda d: f"""SELECT book, page, CAST(obj_id AS VARCHAR) AS figure, file, dw AS display_width_pt, rw AS width,
                  CASE WHEN c0 IS NULL THEN '' ELSE c0 || ',' || c3 END AS clip FROM ({manifest_rows(d)}) m""",
)
def figure_manifest_scan(inp: Inputs):
    rows = figures.figure_manifest_scan(inp.derive(manifest_docs), ["book"])
    clip = F.when(F.size("clip") == 4, F.concat(F.get("clip", F.lit(0)).cast("string"), F.lit(","), F.get("clip", F.lit(3)).cast("string")))
    return rows.select("book", "page", "figure", "file", "display_width_pt", "width", F.coalesce(clip, F.lit("")).alias("clip"))


def image_pages(d) -> str:
    """Pages that show their manifest figures."""
    img = f"""concat('<img class="f" src="../assets/images/p_', {d.ntext('obj_id')}, '.png?v=', {d.ntext('obj_id % 3')}, '">')"""
    return f"SELECT book, page, {d.string_agg(img, '', 'obj_id')} AS html FROM ({dv.page_objects(d)}) o WHERE kind <> 'text' GROUP BY book, page"


@job(
    "figure_dimension_join",
    lambda d: f"""
    SELECT book, page, '../assets/images/p_' || obj_id || '.png?v=' || (obj_id % 3) AS src, 'p_' || obj_id || '.png' AS file_name,
           CAST(CASE WHEN w IS NOT NULL THEN greatest(1, round_even(w * 96 / 72, 0)) ELSE round_even(CASE WHEN rw > 0 THEN rw ELSE 1 END, 0) END AS BIGINT) AS width_px,
           CAST(CASE WHEN w IS NOT NULL THEN greatest(1, round_even(h * 96 / 72, 0)) ELSE round_even(CASE WHEN rh > 0 THEN rh ELSE 1 END, 0) END AS BIGINT) AS height_px,
           w * 25.4 / 72 AS width_mm
    FROM (SELECT *, CASE WHEN dw IS NOT NULL THEN dw WHEN c0 IS NOT NULL THEN c2 - c0 END AS w,
                 CASE WHEN dw IS NOT NULL THEN dh WHEN c0 IS NOT NULL THEN c3 - c1 END AS h FROM ({manifest_rows(d)}) m) q""",
)
def figure_dimension_join(inp: Inputs):
    rows = figures.figure_manifest_scan(inp.derive(manifest_docs), ["book"]).withColumn("seq", F.col("figure").cast("bigint"))
    return figures.figure_dimension_join(inp.derive(image_pages), rows)


def _source_pages(d) -> str:
    return f"SELECT DISTINCT book, page FROM ({dv.page_objects(d)}) o"


@job(
    "plan_scan",
    lambda d: f"""
    SELECT book, page, figure_id, type, strategy, NULL AS issue FROM ({dv.plan_figures(d)}) f
    WHERE figure_id <> '' AND page % 31 <> 3 AND page % 37 <> 5
    UNION ALL
    SELECT s.book, s.page, NULL, NULL, NULL, CASE WHEN p.json IS NULL THEN 'missing finalized visual plan'
      WHEN s.page % 31 = 3 THEN 'visual plan validation failed' ELSE 'visual plan is not an object' END
    FROM ({_source_pages(d)}) s LEFT JOIN ({dv.plan_docs(d)}) p ON p.book = s.book AND p.page = s.page
    WHERE p.json IS NULL OR s.page % 31 = 3 OR s.page % 37 = 5""",
)
def plan_scan(inp: Inputs):
    return figures.plan_scan(inp.derive(dv.plan_docs), inp.derive(_source_pages))


def inside_sql(c: str) -> str:
    unit = " AND ".join(f"{c}{i} BETWEEN 0 AND 1" for i in range(4))
    return f"coalesce({unit} AND {c}2 > {c}0 AND {c}3 > {c}1, false)"


def _bad_figure_box() -> str:
    return f"NOT ({inside_sql('n')} OR coalesce(a2 > a0 AND a3 > a1, false))"


def violations_sql(d) -> str:
    readable = "page % 31 <> 3 AND page % 37 <> 5"
    box = "nx0 BETWEEN 0 AND 1 AND ny0 BETWEEN 0 AND 1 AND nx1 BETWEEN 0 AND 1 AND ny1 BETWEEN 0 AND 1 AND nx1 > nx0 AND ny1 > ny0"
    return f"""
    WITH f AS MATERIALIZED (SELECT * FROM ({kinds_sql(d, dv.doc_figures(d))}) f),
    pages AS MATERIALIZED (SELECT DISTINCT book, page FROM f),
    l AS MATERIALIZED (SELECT l.* FROM ({dv.doc_layouts(d)}) l JOIN pages p ON p.book = l.book AND p.page = l.page WHERE l.{readable.replace(' AND ', ' AND l.')}),
    g AS MATERIALIZED (SELECT * FROM ({dv.plan_regions(d)}) g),
    a AS (SELECT * FROM l WHERE layout = 'object' AND mode = 'source-anchored'),
    o AS (SELECT g.* FROM g JOIN a ON a.book = g.book AND a.page = g.page),
    r AS (SELECT * FROM f WHERE {readable} AND page % 43 <> 9)
    SELECT book, page, 'plan object' AS rule, '' AS subject FROM pages WHERE NOT ({readable})
    UNION ALL SELECT book, page, 'page number', '-5' FROM l WHERE page % 41 = 7
    UNION ALL SELECT book, page, 'figures array', '' FROM l WHERE page % 43 = 9
    UNION ALL SELECT book, page, 'layout object', '' FROM l WHERE layout = 'bad'
    UNION ALL SELECT book, page, 'layout mode', mode FROM l WHERE layout = 'object' AND mode NOT IN ('source-anchored', 'flow')
    UNION ALL SELECT book, page, 'regions required', '' FROM a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.book = a.book AND g.page = a.page)
    UNION ALL SELECT DISTINCT book, page, 'region object', '' FROM o WHERE page % 53 = 12
    UNION ALL SELECT book, page, 'unique region id', region_id FROM o GROUP BY book, page, region_id HAVING count(*) > 1 OR region_id = ''
    UNION ALL SELECT book, page, 'region bbox', region_id FROM o WHERE NOT ({box})
    UNION ALL SELECT book, page, 'region colour', region_id FROM o WHERE fill_color = ''
    UNION ALL SELECT DISTINCT book, page, 'figure object', '' FROM r WHERE page % 47 = 11
    UNION ALL SELECT book, page, 'unique figure id', figure_id FROM r GROUP BY book, page, figure_id HAVING count(*) > 1 OR figure_id = ''
    UNION ALL SELECT book, page, 'figure strategy', figure_id FROM r WHERE strategy = 'guess'
    UNION ALL SELECT book, page, 'figure bbox', figure_id FROM r WHERE {_bad_figure_box()}
    UNION ALL SELECT book, page, 'caption bbox', figure_id FROM r WHERE k0 IS NOT NULL AND NOT {inside_sql('k')}
    UNION ALL SELECT l.book, l.page, 'facsimile sheet', '' FROM l WHERE layout = 'object' AND facsimile AND page % 43 <> 9
      AND (SELECT count(*) FROM r WHERE r.book = l.book AND r.page = l.page AND t = 'composite-engineering-sheet' AND new_strategy = 'extract-raster'
           AND n0 = 0 AND n1 = 0 AND n2 = 1 AND n3 = 1) <> 1"""


@job("plan_contract_violations", violations_sql)
def plan_contract_violations(inp: Inputs):
    return visual_plans.plan_contract_violations(inp.derive(dv.plan_documents))


def kinds_sql(d, view: str) -> str:
    """Figures with the two type rules spelled out for the check."""
    return f"""
    SELECT *, CASE WHEN pixels AND strategy <> 'extract-raster' THEN 'extract-raster' WHEN rebuild THEN 'reconstruct-html-svg' ELSE strategy END AS new_strategy FROM (
    SELECT *, (NOT protected AND wanted) AS rebuild,
           (NOT (basic AND NOT protected AND wanted)) AND (t IN ('map', 'artwork', 'technical-drawing', 'composite-engineering-sheet')
             OR ((t = 'diagram' OR t LIKE '%-diagram') AND NOT basic AND NOT (NOT protected AND wanted))) AS pixels
    FROM (SELECT *, t IN ('map', 'artwork', 'technical-drawing', 'composite-engineering-sheet') AND NOT basic AND NOT named AS protected,
                 t IN ('icon', 'flow-chart') OR t LIKE '%-icon' OR (t = 'diagram' AND basic) OR (t LIKE '%-diagram' AND basic) OR named AS wanted
          FROM (SELECT *, obj_id AS seq, replace(replace(lower(type), ' ', '-'), '_', '-') AS t, complexity = 'basic' AS basic,
                       label LIKE 'Family tree%' OR type IN ('icon', 'Flow chart', 'company-icon') AS named
                FROM ({view}) f) a) b) c"""


@job(
    "strategy_override",
    lambda d: f"""
    SELECT book, page, obj_id, new_strategy AS strategy, CASE WHEN new_strategy <> strategy THEN strategy END AS overridden_from,
           CASE WHEN new_strategy = strategy THEN NULL WHEN new_strategy = 'extract-raster' THEN 'Visual type ' || t || ' requires source-pixel preservation.'
                ELSE 'Structured visual type ' || t || ' must be rebuilt with HTML/SVG.' END AS reason,
           CASE WHEN pixels AND new_strategy = 'extract-raster' THEN CAST(0.99 AS DOUBLE) END AS fidelity_target
    FROM ({kinds_sql(d, dv.plan_figures(d))}) q""",
)
def strategy_override(inp: Inputs):
    out = figures.strategy_override(inp.derive(dv.plan_figures))
    return out.select("book", "page", "obj_id", "strategy", "overridden_from", "reason", "fidelity_target")


@job(
    "strategy_counts",
    lambda d: f"""SELECT book, page, CASE WHEN strategy = 'guess' THEN 'unknown' ELSE strategy END AS strategy, count(*) AS n
                  FROM ({dv.plan_figures(d)}) f GROUP BY ALL""",
)
def strategy_counts(inp: Inputs):
    figs = inp.derive(dv.plan_figures)
    return figures.strategy_counts(figs.withColumn("strategy", F.nullif("strategy", F.lit("guess"))))


def _plan_ids(d) -> str:
    return f"""
    SELECT book, page, canon, arg_max(strategy, seq) AS strategy, arg_max(rebuild, seq) AS rebuild
    FROM (SELECT *, {CANON.format('figure_id')} AS canon FROM ({kinds_sql(d, dv.plan_figures(d))}) k) q GROUP BY book, page, canon"""


def _refs(d) -> str:
    return f"""
    SELECT book, page, {CANON.format('figure_id')} AS canon, CASE WHEN as_image THEN 'image' ELSE 'tag' END AS via,
           bool_or(as_image AND says_icon) AS rebuild FROM ({dv.figure_refs(d)}) r GROUP BY ALL"""


def plan(inp: Inputs):
    inp.keep_objects()
    return figures.planned_kinds(inp.derive(dv.plan_figures).withColumn("seq", F.col("obj_id")))


def refs(inp: Inputs):
    return figures.page_references(inp.derive(dv.figure_pages))


UNPLANNED = """SELECT DISTINCT r.book, r.page, r.canon FROM r WHERE NOT EXISTS (
  SELECT 1 FROM p WHERE p.book = r.book AND p.page = r.page AND p.canon = r.canon)"""
UNRENDERED = """SELECT p.book, p.page, p.canon, CASE WHEN p.strategy = 'extract-raster' THEN 'image' ELSE 'tag' END AS lacking
  FROM p WHERE p.strategy <> 'guess' AND NOT EXISTS (SELECT 1 FROM r WHERE r.book = p.book AND r.page = p.page AND r.canon = p.canon
    AND r.via = CASE WHEN p.strategy = 'extract-raster' THEN 'image' ELSE 'tag' END)"""
FORBIDDEN = """SELECT DISTINCT r.book, r.page, r.canon FROM r LEFT JOIN p ON p.book = r.book AND p.page = r.page AND p.canon = r.canon
  WHERE r.via = 'image' AND (r.rebuild OR coalesce(p.rebuild, false))"""


def _with(d) -> str:
    return f"WITH p AS MATERIALIZED ({_plan_ids(d)}), r AS MATERIALIZED ({_refs(d)})"


@job("unplanned_ids", lambda d: f"{_with(d)} {UNPLANNED}")
def unplanned_ids(inp: Inputs):
    return figures.unplanned_ids(plan(inp), refs(inp))


@job("unrendered_ids", lambda d: f"{_with(d)} {UNRENDERED}")
def unrendered_ids(inp: Inputs):
    return figures.unrendered_ids(plan(inp), refs(inp))


@job("forbidden_rasters", lambda d: f"{_with(d)} {FORBIDDEN}")
def forbidden_rasters(inp: Inputs):
    return figures.forbidden_rasters(plan(inp), refs(inp))


@job(
    "plan_reconcile",
    lambda d: f"""{_with(d)} SELECT book, page, canon, 'unplanned figure id' AS issue FROM ({UNPLANNED}) a
    UNION ALL SELECT book, page, canon, CASE lacking WHEN 'image' THEN 'raster figure without image' ELSE 'vector figure without tag' END FROM ({UNRENDERED}) b
    UNION ALL SELECT book, page, canon, 'reconstruct-only figure has an image' FROM ({FORBIDDEN}) c""",
)
def plan_reconcile(inp: Inputs):
    return figures.plan_reconcile(plan(inp), refs(inp))


def anchors(d) -> str:
    """Region anchors present in the pages: the longer region ids are not there."""
    return f"SELECT book, page, region_id FROM ({dv.plan_regions(d)}) r WHERE length(region_id) <> 6"


def region_pages(d) -> str:
    div = """concat('<div data-source-region="', region_id, '"></div>')"""
    return f"SELECT book, page, {d.string_agg(div, '', div)} AS html FROM ({anchors(d)}) a GROUP BY book, page"


@job(
    "region_gap",
    lambda d: f"""
    SELECT g.book, g.page, g.region_id FROM ({dv.plan_regions(d)}) g JOIN ({dv.plan_layout(d)}) l
      ON l.book = g.book AND l.page = g.page AND l.mode = 'source-anchored'
    EXCEPT SELECT book, page, region_id FROM ({anchors(d)}) a""",
)
def region_gap(inp: Inputs):
    return figures.region_gap(inp.derive(dv.plan_layout), inp.derive(dv.plan_regions), inp.derive(region_pages))


def marker_pages(d) -> str:
    """Pages with layout markers; some miss one of them."""
    return f"""
    SELECT book, page, concat('<main', CASE WHEN page % 5 <> 0 THEN ' data-layout-mode="Source-Anchored"' ELSE '' END,
             CASE WHEN page % 3 = 0 THEN ' data-page-facsimile="true"' ELSE '' END, '>') AS html
    FROM ({dv.plan_layout(d)}) l"""


@job(
    "layout_marker_gap",
    lambda d: f"""
    SELECT book, page, 'data-layout-mode' AS marker FROM ({dv.plan_layout(d)}) l WHERE mode = 'source-anchored' AND page % 5 = 0
    UNION ALL SELECT book, page, 'data-page-facsimile' FROM ({dv.plan_layout(d)}) l WHERE mode = 'source-anchored' AND facsimile AND page % 3 <> 0""",
)
def layout_marker_gap(inp: Inputs):
    return figures.layout_marker_gap(inp.derive(dv.plan_layout), inp.derive(marker_pages))


def _layout_sql(d) -> str:
    w, h6, h7 = layout.WIDTH, *layout.HEIGHTS
    fmt = lambda c: f"printf('%.1f', {c})"
    return f"""
    WITH m AS (SELECT *, greatest(o_left, o_right) AS s, greatest(o_top, o_bottom) AS v, sheet_count = 1 AS one,
                 round(greatest(0.5, least(1.0, {w!r}::DOUBLE / ({w!r}::DOUBLE + greatest(greatest(o_left, o_right), 0)))), 4) AS suggested_scale
               FROM ({dv.layout_metrics(d)}) m),
    x AS (
      SELECT *, 1 AS k, 'rendered page must contain exactly one A4 sheet (found ' || sheet_count || ')' AS message FROM m WHERE NOT one
      UNION ALL SELECT *, 2, 'rendered page width is ' || {fmt('width')} || 'px; expected 210mm ({w:.1f}px)' FROM m WHERE one AND abs(width - {w!r}::DOUBLE) > 2
      UNION ALL SELECT *, 3, 'rendered page height is ' || {fmt('height')} || 'px; expected 296–297mm A4 height' FROM m
        WHERE one AND NOT tall_ok AND least(abs(height - {h6!r}::DOUBLE), abs(height - {h7!r}::DOUBLE)) > 2
      UNION ALL SELECT *, 4, 'horizontal overflow by ' || {fmt('s')} || 'px near page content' FROM m WHERE one AND s > 4.5
      UNION ALL SELECT *, 5, 'vertical overflow by ' || {fmt('v')} || 'px near page content' FROM m WHERE one AND NOT tall_ok AND v > 4.5
      UNION ALL SELECT *, 6, 'clipped text/content overflow in ' || clip_sel || ': ' ||
        concat_ws(' and ', CASE WHEN clip_x > 4.5 THEN {fmt('clip_x')} || 'px horizontally' END, CASE WHEN NOT tall_ok AND clip_y > 4.5 THEN {fmt('clip_y')} || 'px vertically' END)
        FROM m WHERE one AND clip_sel IS NOT NULL AND (clip_x > 4.5 OR (NOT tall_ok AND clip_y > 4.5)))
    SELECT book, page, sheet, suggested_scale, row_number() OVER (PARTITION BY sheet ORDER BY k) - 1 AS seq, message FROM x"""


def measured(inp: Inputs):
    m = inp.derive(dv.layout_metrics)
    clip = F.struct(F.col("clip_sel").alias("selector"), F.col("clip_x").alias("x"), F.col("clip_y").alias("y"))
    m = m.withColumn("clipped", F.when(F.col("clip_sel").isNotNull(), F.array(clip))).withColumn("allow_vertical", F.col("tall_ok"))
    for edge in ("left", "right", "top", "bottom"):
        m = m.withColumn(f"at_{edge}", F.lit(""))
    return m


@job("layout_metric_issues", _layout_sql)
def layout_metric_issues(inp: Inputs):
    return layout.layout_metric_issues(measured(inp), ["book", "page", "sheet"])


@job(
    "issue_cap",
    lambda d: f"""SELECT book, page, sheet, message, rk FROM (
      SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY sheet, seq) AS rk FROM ({_layout_sql(d)}) i) q WHERE rk <= 6""",
)
def issue_cap(inp: Inputs):
    return layout.first_issues(measured(inp), ["book", "page"], "sheet").select("book", "page", "sheet", "message", F.col("rk").cast("bigint").alias("rk"))
