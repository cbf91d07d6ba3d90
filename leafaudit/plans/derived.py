"""Inputs derived from the given tables, as SQL text rendered for Spark or DuckDB.

Every view keeps the whole table it reads, so the work of each job grows with it."""

from __future__ import annotations

HOST = r"^https?://([^/]+)/"
LANG_NUM = r"^https?://[^/]+/([a-z]+)/([0-9]+)"


# ---------------------------------------------------------------- pages


def corpus(d) -> str:
    """pages as (book = host, lang and num from the path, page = unique id)."""
    return f"""
    SELECT page_id AS page, {d.extract('url', HOST)} AS book, {d.extract('url', LANG_NUM)} AS lang,
           CAST({d.extract('url', LANG_NUM, 2)} AS BIGINT) AS num, url, html
    FROM {d.table('pages')}"""


def page_files(d) -> str:
    """pages with a file path; URLs that end in a slash get a name that does not parse."""
    return f"""
    SELECT page, html,
           CASE WHEN url LIKE '%/' THEN concat('/library/', book, '/output/', lang, '/cover.html')
                ELSE concat('/library/', book, '/output/', lang, '/page_', {d.pad4('num')}, '.html') END AS path
    FROM ({corpus(d)}) c"""


def rendered(d) -> str:
    """Rendered copies: URLs with a tracking tag are still pending, the rest is altered by id."""
    no_ad = d.replace_all("html", '<div class="ad">[^<]*</div>', "")
    return f"""
    SELECT book, lang, page,
           CASE page % 5
             WHEN 0 THEN {no_ad}
             WHEN 1 THEN replace(html, 'class="ad"', 'class="ad2"')
             WHEN 2 THEN replace(html, '</h1>', ' addendum</h1>')
             ELSE html END AS html
    FROM ({corpus(d)}) c WHERE url NOT LIKE '%utm_source%'"""


def published(d) -> str:
    """Published pages with every kind of contract fault spread over the ids."""
    shell = """replace(replace(html, '<article>', '<main class="book-page book-page--sheet"><article>'), '</article>', '</article></main>')"""
    return f"""
    SELECT book, lang, page, num,
      CASE page % 9
        WHEN 0 THEN html
        WHEN 1 THEN replace({shell}, ' book-page--sheet', '')
        WHEN 2 THEN replace({shell}, '<article>', '<article hidden>')
        WHEN 3 THEN replace({shell}, '</h1>', '</h1><!-- pdf-render -->')
        WHEN 4 THEN replace({shell}, '<footer>', '<footer class="page-copyright">')
        WHEN 5 THEN replace({shell}, '<h1>', '<h3 class="section-title">Notes.</h3> <p class="lead">body</p><h1>')
        WHEN 6 THEN replace({shell}, '<h1>', '<figure class="diagram"> <pre class="code-block">x = 1</pre></figure><h1>')
        WHEN 7 THEN replace({shell}, '<h1>', '<header class="running-head">by House Press</header><figure class="listing"><pre class="code-block">y</pre> <figcaption>L</figcaption></figure><h1>')
        ELSE CASE WHEN page % 2 = 0 THEN replace({shell}, '<article>', '<article class="flex hidden md:block" title="a hidden gem">')
                  ELSE '<main class="book-page book-page--sheet"><article><p>&#160;&emsp;</p><p title="words">&#xA0;&mdash;</p></article></main>' END
        END AS html
    FROM ({corpus(d)}) c"""


def delivered(d) -> str:
    """Published pages as they arrive: some never do, are empty, lose their title or gain a rule."""
    return f"""
    SELECT book, lang, page, CASE WHEN page % 19 = 4 THEN '' WHEN page % 23 = 6 THEN {d.replace_all("html", "<h1>[^<]*</h1>", "<h1>x</h1>")}
             WHEN page % 11 = 7 THEN replace(html, '</h1>', '</h1><hr>') ELSE html END AS html
    FROM ({published(d)}) p WHERE num % 7 <> 3"""


def page_plans(d) -> str:
    """A plan document per page; some are no object or name another page."""
    return f"""
    SELECT book, lang, page, CASE WHEN page % 16 = 5 THEN '[1]' WHEN page % 16 = 11 THEN '{{"page": -1, "figures": []}}'
             ELSE concat('{{"page": ', {d.ntext('page')}, ', "figures": []}}') END AS json
    FROM ({corpus(d)}) c"""


def delivered_assets(d) -> str:
    """Asset references of the delivered pages; every third page has some."""
    return f"SELECT book, lang, page, base_dir, CASE WHEN page % 3 = 0 THEN html ELSE '' END AS html FROM ({asset_pages(d)}) a"


def layout_findings(d) -> str:
    return f"SELECT book, lang, page, 'layout' AS kind FROM ({corpus(d)}) c WHERE page % 37 = 9"


def paginated(d) -> str:
    """pages whose articles hold, by id, lists, a running head, paragraphs left open (as given),
    lists in lists, a quotation of nested sections, or sections with notes."""
    closed = d.replace_all("html", "</?(b|br)>|</p>", "")
    wrap = lambda before, after: d.replace_all(closed, "<p>([^<]*)", f"{before}$1{after}")
    sections = wrap("<section><div><p>", "</p></div></section>")
    return f"""
    SELECT book, page, CASE page % 6 WHEN 0 THEN {wrap("<ul><li>", "</li></ul>")}
             WHEN 1 THEN replace({wrap("<p>", "</p>")}, '</h1>', '</h1><header class="running-head"><p>House Press</p></header>')
             WHEN 2 THEN html
             WHEN 3 THEN {wrap("<ol><li>x<ul><li>", "</li></ul></ol>")}
             WHEN 4 THEN replace(replace({sections}, '</h1>', '</h1><blockquote>'), '</article>', '</blockquote></article>')
             ELSE {wrap("<section><p>", "</p><p>a note</p></section>")} END AS html
    FROM ({corpus(d)}) c"""


def book_chrome(d) -> str:
    """Header and footer text per book."""
    return f"""
    SELECT book, concat('www.', book) AS head_left,
           CASE WHEN count(*) % 2 = 1 THEN 'House Press' ELSE '' END AS foot_left, 'Copyright 2024' AS foot_right
    FROM ({corpus(d)}) c GROUP BY book"""


def visible_text(d, expr: str = "html") -> str:
    """Check-side visible text: one pattern per hidden element."""
    out = d.replace_all(expr, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "head", "noscript", "template", "title"):
        out = d.replace_all(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = d.replace_all(out, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        out = f"replace({out}, '{name}', '{char}')"
    return d.replace_all(out, "&amp;?", "&")


def token_list(d, expr: str) -> str:
    return d.extract_all(f"replace(lower({expr}), 'ß', 'ss')", r"[\p{L}\p{N}]+")


def keep_token(d, t: str = "token") -> str:
    return (
        f"NOT (length({t}) = 1 AND NOT {d.matches(t, '^[0-9]$')} AND {t} NOT IN ('a', 'i')) "
        f"AND NOT (length({t}) <= 2 AND NOT {d.matches(t, '[a-z0-9]')})"
    )


def tokens(d, view: str) -> str:
    return f"""
    SELECT book, page, token FROM (
      SELECT book, page, {d.unnest(token_list(d, visible_text(d)))} AS token FROM ({view}) v) t
    WHERE {keep_token(d)}"""


# ---------------------------------------------------------------- assets


def _linked(d, css_page: str, image: str, script: str, srcset: str) -> str:
    """The page's navigation links turned into asset references of one kind per id."""
    pat = '<a href="/([^"]*)">'
    return f"""CASE page % 4
             WHEN 0 THEN {d.replace_all('html', pat, css_page)}
             WHEN 1 THEN {d.replace_all('html', pat, image)}
             WHEN 2 THEN {d.replace_all('html', pat, script)}
             ELSE {d.replace_all('html', pat, srcset)} END"""


def asset_pages(d) -> str:
    html = _linked(
        d,
        '<link rel="stylesheet" href="../assets/$1.css?v=2">',
        '<img src="../assets/images/$1.png"><img src="https://cdn.example.com/$1.png"><a>',
        '<script src="../assets/$1.js#x"></script><a>',
        '<img srcset="../assets/images/$1.png 1x, ../assets/images/hi%20res/$1.png 2x"><a>',
    )
    return f"""
    SELECT book, lang, page, concat('/library/', book, '/output/', lang) AS base_dir,
           concat('/library/', book, '/output') AS out_dir, {html} AS html
    FROM ({corpus(d)}) c"""


def asset_names(d) -> str:
    names = d.extract_all("html", '<a href="/([^"]*)">', 1)
    return f"SELECT book, lang, page, {d.unnest(names)} AS name FROM ({corpus(d)}) c"


def inventory(d) -> str:
    """Files on disk: names with an e exist, some are empty."""
    kinds = " UNION ALL ".join(
        f"SELECT concat('/library/', book, '/output/assets/', {path}) AS path, name FROM n"
        for path in (
            "name, '.css'", "'images/', name, '.png'", "name, '.js'", "'images/hi res/', name, '.png'"
        )
    )
    return f"""
    WITH n AS (SELECT DISTINCT book, name FROM ({asset_names(d)}) a WHERE name LIKE '%e%')
    SELECT path, CAST((length(name) * 10) % 50 AS BIGINT) AS size FROM ({kinds}) k"""


def rewrite_pages(d) -> str:
    html = _linked(
        d,
        '<a href="assets/$1.css" data-x="assets/no">',
        '<img src="assets/images/$1.png"><a href="../assets/$1">',
        '<div style="background:url(assets/$1.png)"></div><a href="https://x.example/assets/$1">',
        '<img srcset="assets/$1.png 1x, assets/hi/$1.png 2x,assets/max/$1.png 3x"><a>',
    )
    return f"SELECT book, lang, page, {html} AS html FROM ({corpus(d)}) c"


# ---------------------------------------------------------------- pipeline events

VALUE = "CAST(floor(value) AS BIGINT)"


def process_events(d) -> str:
    """events as status writes: book = user, page = props.k + 1, seq = event id."""
    k = f"CAST({d.json_text('props', 'k')} AS BIGINT)"
    return f"""
    SELECT concat('book', user_id) AS book, {k} + 1 AS page, event_id AS seq, ts, {VALUE} AS v, event_type,
           CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running'
                           WHEN 'purchase' THEN 'done' ELSE 'failed' END AS state,
           CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'starting' WHEN 'click' THEN 'render_page'
                           WHEN 'purchase' THEN 'done' ELSE 'failed' END AS step,
           concat('step ', {d.ntext(f'{VALUE} % 4')}) AS message,
           CASE WHEN event_type <> 'error' THEN NULL WHEN {VALUE} % 3 = 0 THEN 'RESOURCE_EXHAUSTED: resets in 2h'
                WHEN {VALUE} % 3 = 1 THEN 'OAuth session ended, not logged in' ELSE 'Render timeout' END AS error,
           CASE WHEN event_type = 'purchase' THEN concat('✓ write: part', {d.ntext(f'{VALUE} % 7')})
                WHEN event_type = 'view' THEN '▶ read' ELSE concat('text ', {d.ntext(VALUE)}) END AS chunk
    FROM {d.table('events')}"""


def raw_status(d) -> str:
    """Status payloads of which some have an unknown state, no step or a foreign page."""
    return f"""
    SELECT book, page, seq, error, CASE WHEN v % 7 = 3 THEN 'paused' ELSE state END AS state,
           CASE WHEN v % 11 = 4 THEN '' ELSE step END AS step,
           CASE WHEN v % 13 = 5 THEN page + 1 ELSE page END AS payload_page
    FROM ({process_events(d)}) e"""


def process_books(d) -> str:
    return f"SELECT book, max(page) AS page_count FROM ({process_events(d)}) e GROUP BY book"


def live_log(d) -> str:
    """events as live-log chunks of a few busy pages, with repeats and long fragments."""
    k = f"CAST({d.json_text('props', 'k')} AS BIGINT)"
    return f"""
    SELECT concat('book', user_id % 8) AS book, {k} % 4 AS page, event_id AS seq, ts,
           CASE event_type WHEN 'purchase' THEN concat('✓ write: part', {d.ntext(f'{VALUE} % 3')})
                WHEN 'signup' THEN '[note] queued' WHEN 'view' THEN '▶ read'
                WHEN 'error' THEN repeat('long fragment ', 12)
                ELSE concat('text ', {d.ntext(f'{VALUE} % 5')}) END AS chunk
    FROM {d.table('events')}"""


def failure_lines(d) -> str:
    """Checker output: page failures, extractor failures and lines that are neither."""
    return f"""
    SELECT book, page AS at_page, seq, CASE event_type
      WHEN 'error' THEN concat('FAIL ', CASE WHEN v % 2 = 0 THEN 'en' ELSE 'vi' END, '/page_', {d.pad4('page')}, '.html: ',
        CASE v % 6 WHEN 0 THEN 'horizontal overflow by 9.0px near p' WHEN 1 THEN 'Missing image: a.png'
          WHEN 2 THEN 'HTML article has no meaningful visible content (blank page shell)' WHEN 3 THEN 'Missing CSS: b.css'
          WHEN 4 THEN 'Empty image file: c.png' ELSE 'HTML missing semantic article' END)
      WHEN 'click' THEN concat('FAIL extractor did not create referenced figure: page ', {d.ntext('page')}, ': images/f.png')
      WHEN 'view' THEN concat('FAIL page ', {d.ntext('page')}, ' unreadable')
      ELSE 'OK checked' END AS line
    FROM ({process_events(d)}) e"""


def usage(d) -> str:
    return f"""
    SELECT book AS account, event_type AS grp, CASE WHEN v % 2 = 0 THEN 'Daily Limit' ELSE 'Weekly Limit' END AS limit_name,
           ts, seq, v % 101 AS percent
    FROM ({process_events(d)}) e"""


# ---------------------------------------------------------------- library


def manifest_docs(d) -> str:
    """One manifest per (source, lang); some are missing and some are cut off."""
    n = d.ntext("n")
    return f"""
    SELECT folder, n, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 5 = 0 THEN '{{"slug": "cut'
      WHEN n % 3 = 0 THEN concat('{{"title": "Volume ', folder, '", "page_count": ', {n}, '}}')
      ELSE concat('{{"slug": "', folder, '", "title": "Volume ', folder, '", "page_count": ', {n},
        ', "source_lang": "', lang, '", "languages": [{{"code": "', lang, '", "role": "primary"}}, {{"code": "vi", "role": "translation"}}]}}')
      END AS json
    FROM (SELECT concat(source, '-', lang) AS folder, lang, count(*) AS n FROM {d.table('documents')} GROUP BY source, lang) g"""


def page_specs(d) -> str:
    n, half = d.ntext("n"), d.ntext("CAST(floor(n / 2) AS BIGINT)")
    return f"""SELECT folder AS book, n AS page_count, concat('1-', {half}, ', ', {n}, ',x,', {n}, '–', {d.ntext('n + 5')}) AS spec
               FROM ({manifest_docs(d)}) m"""


def doc_pages(d) -> str:
    return f"SELECT concat(source, '-', lang) AS book, doc_id % 40 + 1 AS page, doc_id FROM {d.table('documents')}"


def host_books(d) -> str:
    """Books per host with the primary language, expected pages and catalogue state."""
    return f"""
    SELECT book, CASE WHEN count(*) % 2 = 0 THEN concat('The ', book) ELSE '' END AS title, 'en' AS source_lang,
           CASE count(*) % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'active' END AS library_state,
           sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS page_count, count(*) AS n
    FROM ({corpus(d)}) c GROUP BY book"""


def detect_docs(d) -> str:
    return f"""SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN lang WHEN doc_id % 4 = 1 THEN 'fr-FR' WHEN doc_id % 8 = 2 THEN 'vie' ELSE 'und' END AS declared
               FROM {d.table('documents')}"""


def authors(d) -> str:
    return f"""
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('Author ', lang) ELSE '' END AS manifest_author,
           CASE doc_id % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN ' Ana Lee ' END AS document_author,
           CASE WHEN doc_id % 2 = 0 THEN concat('tale-by-', source, '-press') ELSE source END AS slug, source
    FROM {d.table('documents')}"""


# ---------------------------------------------------------------- page objects and plans


def page_objects(d) -> str:
    """lineitem as page objects, one each, eight orders to a page. Rows that share their
    (order, line) are told apart by their rank among its rows."""
    return d.objects or f"""
    SELECT concat('vol', {d.ntext('CAST(floor(ok / 4000) AS BIGINT)')}) AS book, CAST(floor(ok / 8) AS BIGINT) % 500 AS page, obj_id, kind,
           CASE WHEN cover THEN CAST(0 AS DOUBLE) ELSE x0 END AS x0, CASE WHEN cover THEN CAST(0 AS DOUBLE) ELSE y0 END AS y0,
           CASE WHEN cover THEN CAST(612 AS DOUBLE) ELSE x0 + 10 + q * 2 END AS x1,
           CASE WHEN cover THEN CAST(792 AS DOUBLE) ELSE y0 + 10 + (pk * 13) % 60 END AS y1,
           CASE WHEN kind <> 'text' THEN '' WHEN obj_id % 7 = 0 THEN concat('Figure ', {d.ntext('obj_id % 50')}, '. Plate')
                WHEN obj_id % 7 = 1 THEN concat({d.ntext('obj_id % 20')}, '. Step') WHEN obj_id % 7 = 2 THEN 'class Node'
                WHEN obj_id % 7 = 3 THEN 'visit www.press.example now' WHEN obj_id % 21 = 4 THEN 'Listing 3-1'
                WHEN obj_id % 21 = 11 THEN 'Copyright 2024 House' ELSE 'plain words of prose' END AS text,
           n_items, CAST(612 AS DOUBLE) AS page_w, CAST(792 AS DOUBLE) AS page_h, pk
    FROM (SELECT l_orderkey AS ok, l_orderkey * 10 + l_linenumber + (nth - 1) * 1000000000000037 AS obj_id, pk, q,
                 CASE rf WHEN 'A' THEN 'image' WHEN 'R' THEN 'drawing' ELSE 'text' END AS kind,
                 CAST((pk * 37) % 500 AS DOUBLE) AS x0, CAST((sk * 53 + l_orderkey * 7) % 700 AS DOUBLE) AS y0,
                 pk % 40 + 1 AS n_items,
                 rf = 'A' AND CAST(floor(l_orderkey / 8) AS BIGINT) % 500 = 1 AND l_linenumber = 1 AND nth = 1 AS cover
          FROM (SELECT l_orderkey, l_linenumber, l_partkey AS pk, l_suppkey AS sk, l_quantity AS q, l_returnflag AS rf,
                       row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_returnflag) AS nth
                FROM {d.table('lineitem')}) u) o"""


def plan_figures(d) -> str:
    """Planned figures: every non-text object, with id spellings, types, faults and boxes."""
    return f"""
    SELECT book, page, obj_id,
           CASE WHEN obj_id % 97 = 0 THEN 'dup' WHEN obj_id % 89 = 0 THEN ''
                WHEN obj_id % 3 = 0 THEN concat('F', {d.ntext('obj_id')}, '.1')
                WHEN obj_id % 3 = 1 THEN concat('f', {d.ntext('obj_id')}, '-1') ELSE concat('f', {d.ntext('obj_id')}, '_1') END AS figure_id,
           CASE obj_id % 9 WHEN 0 THEN 'map' WHEN 1 THEN 'icon' WHEN 2 THEN 'Flow chart' WHEN 3 THEN 'diagram' WHEN 4 THEN 'wiring-diagram'
                WHEN 5 THEN 'artwork' WHEN 6 THEN 'photo' WHEN 7 THEN 'Technical_Drawing' ELSE 'company-icon' END AS type,
           CASE WHEN obj_id % 11 = 0 THEN 'Family tree of kings' ELSE 'Plate' END AS label,
           CASE WHEN pk % 3 = 0 THEN 'basic' ELSE '' END AS complexity,
           CASE WHEN obj_id % 83 = 0 THEN 'guess' WHEN pk % 2 = 0 THEN 'extract-raster' ELSE 'reconstruct-html-svg' END AS strategy,
           CASE WHEN obj_id % 79 = 0 THEN x1 / 612 ELSE x0 / 612 END AS nx0, y0 / 792 AS ny0, x1 / 612 AS nx1, y1 / 792 AS ny1,
           x0 + obj_id % 5 - 2 AS x0, y0 + obj_id % 7 - 3 AS y0, x1 + obj_id % 3 AS x1, y1 + obj_id % 4 - 1 AS y1, page_w, page_h
    FROM ({page_objects(d)}) o WHERE kind <> 'text'"""


def figure_refs(d) -> str:
    """What the page HTML refers to: most planned figures plus some that nobody planned."""
    return f"""
    SELECT book, page, figure_id, obj_id % 2 = 0 AS as_image, obj_id % 13 = 0 AS says_icon
    FROM ({plan_figures(d)}) f WHERE figure_id <> '' AND label = 'Plate'
    UNION ALL
    SELECT book, page, concat('x', {d.ntext('obj_id')}) AS figure_id, obj_id % 2 = 0 AS as_image, false AS says_icon
    FROM ({page_objects(d)}) o WHERE text = 'class Node'"""


def figure_pages(d) -> str:
    """Page HTML holding those references."""
    img = f"""concat('<img alt="', CASE WHEN says_icon THEN 'Exercise marker' ELSE 'plate' END,
              '" src="../assets/images/page_', {d.pad4('page')}, '_fig_', figure_id, '.png">')"""
    tag = """concat('<figure data-visual-id="', figure_id, '"></figure>')"""
    item = f"CASE WHEN as_image THEN {img} ELSE {tag} END"
    return f"SELECT book, page, {d.string_agg(item, '', item)} AS html FROM ({figure_refs(d)}) r GROUP BY book, page"


def plan_docs(d) -> str:
    """Plan JSON per page: figures and layout; some are cut off, some are not objects."""
    fig = f"""concat('{{"id": "', figure_id, '", "type": "', type, '", "label": "', label, '", "complexity": "', complexity,
              '", "strategy": "', strategy, '"}}')"""
    return f"""
    SELECT book, page, CASE WHEN page % 31 = 3 THEN '{{"figures": [' WHEN page % 37 = 5 THEN '[1, 2]'
           ELSE concat('{{"page": ', {d.ntext('page')}, ', "figures": [', figs, ']}}') END AS json
    FROM (SELECT book, page, {d.string_agg(fig, ', ', 'obj_id')} AS figs FROM ({plan_figures(d)}) f WHERE figure_id <> '' GROUP BY book, page) g"""


def plan_layout(d) -> str:
    """Page layouts: mode and facsimile flag per page."""
    return f"""
    SELECT book, page, CASE WHEN page % 23 = 2 THEN 'grid' WHEN page % 2 = 0 THEN 'source-anchored' ELSE 'flow' END AS mode,
           page % 29 = 1 AS facsimile
    FROM ({page_objects(d)}) o GROUP BY book, page"""


def plan_regions(d) -> str:
    """Layout regions: the longer text lines of a page, with faults."""
    return f"""
    SELECT book, page, CASE WHEN obj_id % 41 = 0 THEN 'main' ELSE concat('r', {d.ntext('obj_id')}) END AS region_id,
           x0 / 612 AS nx0, CASE WHEN obj_id % 43 = 0 THEN y1 / 792 ELSE y0 / 792 END AS ny0, x1 / 612 AS nx1, y1 / 792 AS ny1,
           CASE WHEN obj_id % 47 = 0 THEN '' ELSE '#fff' END AS fill_color, '' AS stroke_color, '' AS text_color
    FROM ({page_objects(d)}) o WHERE text LIKE 'plain%'"""


def doc_figures(d) -> str:
    """Figures as plan documents state them: a normalised box, an art box, or both of which
    the first is out of range; some crops and captions, good and bad; one full sheet a page
    on some facsimile pages; some first pages without a figure to rebuild."""
    own = lambda i, sheet, value: (
        f"CASE WHEN sheet THEN CAST({sheet} AS DOUBLE) WHEN obj_id % 6 = 0 THEN NULL WHEN obj_id % 12 = 3 THEN {value} + 2 ELSE {value} END AS n{i}"
    )
    box = ["x0", "y0", "x1", "y1"]
    art = [f"CASE WHEN NOT sheet AND (obj_id % 6 = 0 OR obj_id % 12 = 3) THEN {c} END AS a{i}" for i, c in enumerate(box)]
    crop = [f"CASE obj_id % 10 WHEN 1 THEN {c} + 1 WHEN 3 THEN {o} END AS c{i}" for i, (c, o) in enumerate(zip(box, ["x1", "y0", "x0", "y1"], strict=True))]
    cap = [f"CASE WHEN obj_id % 101 = 0 THEN {bad} WHEN obj_id % 4 = 1 THEN {good} END AS k{i}" for i, (bad, good) in enumerate([("0.5", "x0 / 1000"), ("0.5", "0.5"), ("0.5", "x1 / 1000 + 0.25"), ("0.6", "0.75")])]
    return f"""
    SELECT book, page, obj_id, figure_id, complexity, page_w, page_h, obj_id % 10 = 2 AS no_crop,
           CASE WHEN scan THEN 'Plate' ELSE label END AS label, CASE WHEN scan THEN 'extract-raster' ELSE strategy END AS strategy,
           CASE WHEN sheet THEN 'composite-engineering-sheet' WHEN scan THEN 'photo' ELSE type END AS type,
           {own(0, 0, 'nx0')}, {own(1, 0, 'ny0')}, {own(2, 1, 'nx1')}, {own(3, 1, 'ny1')}, {', '.join(art)}, {', '.join(crop)}, {', '.join(cap)}
    FROM (SELECT *, page = 1 AND (book LIKE '%1' OR book LIKE '%3') AS scan, page % 58 = 1 AND obj_id = min(obj_id) OVER (PARTITION BY book, page) AS sheet FROM ({plan_figures(d)}) f) f"""


def doc_layouts(d) -> str:
    """Layouts as plan documents state them, with faults of their kind."""
    return f"""
    SELECT book, page, CASE WHEN page % 13 = 6 THEN 'none' WHEN page % 19 = 4 THEN 'bad' ELSE 'object' END AS layout,
           CASE WHEN page % 17 = 5 THEN '' ELSE mode END AS mode, facsimile
    FROM ({plan_layout(d)}) l"""


def plan_documents(d) -> str:
    """Whole plan JSON per page, with faults: cut off, not an object, another page's number,
    figures that are no array, figures and regions that are no objects."""
    box = lambda key, c: f"""CASE WHEN {c}0 IS NULL THEN '' ELSE concat(', "{key}": [', {", ', ', ".join(d.ntext(f'{c}{i}') for i in range(4))}, ']') END"""
    fig = f"""concat('{{"id": "', figure_id, '", "type": "', type, '", "label": "', label, '", "complexity": "', complexity, '", "strategy": "', strategy, '"',
              {box('bbox_normalized', 'n')}, {box('art_bbox', 'a')}, {box('caption_bbox_normalized', 'k')},
              CASE WHEN no_crop THEN ', "crop_bbox": []' ELSE {box('crop_bbox', 'c')} END, '}}')"""
    region = f"""concat('{{"id": "', region_id, '", "bbox_normalized": [', {", ', ', ".join(d.ntext(c) for c in ('nx0', 'ny0', 'nx1', 'ny1'))},
                '], "fill_color": "', fill_color, '", "text_color": null}}')"""
    return f"""
    SELECT f.book, f.page, CAST(612 AS DOUBLE) AS page_w, CAST(792 AS DOUBLE) AS page_h,
           CASE WHEN f.page % 31 = 3 THEN '{{"figures": [' WHEN f.page % 37 = 5 THEN '[1, 2]' ELSE
           concat('{{"page": ', CASE WHEN f.page % 41 = 7 THEN '-5' ELSE {d.ntext('f.page')} END, ', "figures": ', CASE WHEN f.page % 43 = 9 THEN '{{}}' ELSE concat('[', figs, CASE WHEN f.page % 47 = 11 THEN ', 7]' ELSE ']' END) END,
             ', "page_layout": ', CASE layout WHEN 'none' THEN 'null' WHEN 'bad' THEN '"flow"' ELSE
             concat('{{"mode": "', mode, '", "facsimile": ', CASE WHEN facsimile THEN 'true' ELSE 'false' END,
                    CASE WHEN regs IS NULL THEN '' ELSE concat(', "regions": [', regs, CASE WHEN f.page % 53 = 12 THEN ', "x"]' ELSE ']' END) END, '}}') END, '}}') END AS json
    FROM (SELECT book, page, {d.string_agg(fig, ', ', 'obj_id')} AS figs FROM ({doc_figures(d)}) x GROUP BY book, page) f
    JOIN ({doc_layouts(d)}) l ON l.book = f.book AND l.page = f.page
    LEFT JOIN (SELECT book, page, {d.string_agg(region, ', ', 'nx0, ny0, nx1, ny1, region_id')} AS regs FROM ({plan_regions(d)}) x GROUP BY book, page) g
      ON g.book = f.book AND g.page = f.page"""


def layout_metrics(d) -> str:
    """Measured geometry per page object row standing for one rendered page."""
    return f"""
    SELECT book, page, obj_id AS sheet, CASE WHEN obj_id % 53 = 0 THEN 0 WHEN obj_id % 59 = 0 THEN 2 ELSE 1 END AS sheet_count,
           790 + CAST(pk % 8 AS DOUBLE) AS width, 1116 + CAST(obj_id % 10 AS DOUBLE) AS height,
           x0 / 100 AS o_left, y0 / 100 AS o_right, x1 / 90 AS o_top, y1 / 110 AS o_bottom, pk % 6 = 0 AS tall_ok,
           CASE WHEN obj_id % 5 = 0 THEN 'p.note' END AS clip_sel, x1 / 50 AS clip_x, y1 / 60 AS clip_y
    FROM ({page_objects(d)}) o"""


# ---------------------------------------------------------------- lexicon and text runs


def prose(d) -> str:
    return f"SELECT doc_id, source AS book, text FROM {d.table('documents')}"


def word_rows(d) -> str:
    words = d.extract_all("lower(text)", "[a-z]+")
    return f"SELECT DISTINCT doc_id, book, word FROM (SELECT doc_id, book, {d.unnest(words)} AS word FROM ({prose(d)}) e) w"


def latest_words(d) -> str:
    """Words of all documents, per book; of rows that give the same line, the last one (Spark only)."""
    return f"""
    SELECT max(doc_id) AS doc_id, book, word
    FROM (SELECT doc_id, book, explode(array_distinct(split(lower(text), '[^a-z]++'))) AS word FROM ({prose(d)}) e) w
    WHERE word <> '' GROUP BY book, word, doc_id % 2"""


def lexicon_lines(d, rows: str = "") -> str:
    """Lexicon lines from the words of all documents: reversed word as pronunciation, later lines win."""
    return f"""
    SELECT doc_id AS seq, CASE WHEN length(word) % 5 = 4 THEN concat(word, chr(9), 'x', chr(9), 'y')
      ELSE concat(' ', upper(word), chr(9), '/', reverse(word), CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'o' END, '/, /alt/') END AS line
    FROM ({rows or word_rows(d)}) w WHERE word NOT LIKE '%on'"""


def overrides(d, rows: str = "") -> str:
    return f"SELECT DISTINCT book, word, concat('own', word) AS ipa FROM ({rows or word_rows(d)}) w WHERE word LIKE '%ing'"


def assembly_pages(d) -> str:
    """Valid pages in the full shell; some languages of a host hold a page with the forbidden marker."""
    return f"""
    SELECT book, lang, page, replace(replace(html, '<article>', CASE WHEN url LIKE '%?page=%'
             THEN '<main class="book-page book-page--sheet"><!-- pdf-render --><article>' ELSE '<main class="book-page book-page--sheet"><article>' END),
           '</article>', '<img src="../assets/a.png"></article></main>') AS html
    FROM ({corpus(d)}) c"""
