import unicodedata
from html.parser import HTMLParser

from conftest import rows
from pyspark.sql import functions as F

from leafaudit.functions import paths as px
from leafaudit.functions import text as tx
from leafaudit.operators import corpus, fidelity


def pages(spark, *htmls):
    return spark.createDataFrame([("b", i, h) for i, h in enumerate(htmls, 1)], "book string, page long, html string")


KEYS = ["book", "page"]


def test_missing_tokens_of_a_page(spark):
    source = pages(spark, "<p>Alpha Beta 2026 beta</p>")
    rendered = pages(spark, "<main><p>Alpha only</p></main>")
    loss = fidelity.token_loss(source, rendered, KEYS)
    assert rows(loss, "token", "missing") == [("2026", 1), ("beta", 2)]
    top = fidelity.top_missing_tokens(loss, KEYS).first()
    assert (top.total_missing, top.missing_text) == (3, "beta×2, 2026")


class Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in tx.HIDDEN_TEXT_TAGS

    def handle_endtag(self, tag):
        self.depth -= tag in tx.HIDDEN_TEXT_TAGS and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def brute_tokens(html):
    parser = Visible()
    parser.feed(html)
    parser.close()
    return sorted(t for t in tx.exact_tokens(" ".join(parser.parts), entities=False) if tx.keep_token(t))


def test_tokens_equal_a_full_parser_for_any_script(spark):
    htmls = [
        "<head><title>x y</title></head><body>Straße ﬁne co­op non‑stop ½ Été é</body>",
        "<p>&eacute;t&eacute; &amp;lt; &#233; a&nbsp;b I &copy; İstanbul ẞ ①</p><script>var t='</p>zzz'</script>",
        "<p title='a > b'>Việt 中文 مرحبا x_y ² A7</p><!-- hid <b>den</b> --><style>p{}</style>after",
        "<body><template>no</template><noscript>no</noscript>yes<br>yes &hellip; &lt;b&gt;</body>",
    ]
    got = corpus.visible_tokens(pages(spark, *htmls), KEYS)
    flat = {}
    for page, token, n in got.select("page", "token", "n").collect():
        flat.setdefault(page, []).extend([token] * n)
    for i, h in enumerate(htmls, 1):
        assert sorted(flat[i]) == brute_tokens(h), h


def test_plain_path_is_only_used_where_it_is_exact():
    import re

    odd = re.compile(tx.needs_exact_pattern())
    for code in range(0x80, 0x2100):
        char = chr(code)
        if not odd.search(char) and char not in "ß ­":
            assert unicodedata.normalize("NFKC", char).casefold() == char.lower()


def test_bilingual_structure_allows_text_and_rejects_layout(spark):
    body = '<main class="sheet"><img src="../assets/a.png"><svg><path fill="{}" d="M0"></path></svg><p title="{}">{}</p></main>'
    source = pages(spark, body.format("#123456", "x", "Hello"), body.format("#123456", "x", "Hello"), "<p>a</p><b>")
    translated = pages(spark, body.format("#123456", "y", "Xin chao"), body.format("#abcdef", "x", "Xin"), "<p>a</p>")
    got = fidelity.structure_divergence(source, translated, KEYS)
    assert rows(got, "page", "first_diff", "source_len", "translated_len") == [(2, 3, 9, 9), (3, 2, 3, 2)]


def sheet(inner, opening="<article>"):
    return f'<main class="book-page">{opening}{inner}</article></main>'


# What an article may hold, by whether a reader sees anything of it.
SEEN = [
    "plain", "<em>7</em>", "&eacute;", "&#65;", "&#x3b1;", "&frac12;", "&unheardof;", "&nbspx", "<hr>", "<canvas></canvas>",
    '<img srcset="a.png 2x">', '<i style="background:URL(k.png)"></i>', '<video poster="k.jpg"></video>', '<b data-visual-id="v1"></b>',
    '<p class="flex hidden md:block">kept</p>', '<p title="a hidden gem">kept</p>', "<p title=' style=\"display:none\" '>kept</p>",
    "<section hidden><b>lost</section>kept", '<p style="opacity:0.5">kept</p>', '<p data-hidden="1">kept</p>',
]
UNSEEN = [
    "", " \n ", "<!-- note -->", "<p></p>", "&nbsp;&amp;", "&#160;&emsp;&mdash;", "&#xA0;", "&#8212;&hellip;", "&nbsp&nbsp",
    "<style>p{}</style>", "<template>held</template>", "<p hidden>lost</p>", '<p hidden="">lost</p>', "<P HIDDEN>lost</P>",
    '<div aria-hidden="TRUE">lost</div>', '<p style="color:red; visibility: hidden">lost</p>', '<p style="opacity: 0">lost</p>',
    '<ul class="a page-nav"><li>lost</ul>', '<input type="hidden">', '<img alt="no source">',
]


def test_content_gate_sees_what_a_reader_sees(spark):
    cases = [(sheet(h), True) for h in SEEN] + [(sheet(h), False) for h in UNSEEN]
    cases += [
        (sheet("", '<article data-blank-page="yes">'), True),
        (sheet("", '<article title="data-blank-page=yes">'), False),
        (sheet("words <!-- pdf-render -->"), False),
        ("<article>words</article>", False),
        ('<main class="book-page">words</main>', False),
    ]
    got = dict(corpus.content_gate(pages(spark, *[c for c, _ in cases]), KEYS).select("page", "valid").collect())
    assert [c for i, (c, ok) in enumerate(cases, 1) if got[i] != ok] == []


def test_paths(spark):
    cases = [
        ("../assets/a%20b.png?x=1#y", "/l/b/output/assets/a b.png"),
        ("./x/../y.png", "/l/b/output/en/y.png"),
        ("/abs/p.png", "/abs/p.png"),
        ("100%.png", "/l/b/output/en/100%.png"),
        ("a+b.png", "/l/b/output/en/a+b.png"),
        ("../../../../../z", "/z"),
    ]
    df = spark.createDataFrame(cases, "ref string, want string")
    got = df.select(px.resolve(F.lit("/l/b/output/en"), px.clean_url(F.col("ref"))).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got


def test_slug_title_and_keys(spark):
    r = spark.range(1).select(
        tx.slugify(F.lit("  Hello, World! ")).alias("a"), tx.slugify(F.lit("***")).alias("b"),
        tx.title_from_slug(F.lit("animal-farm")).alias("c"), tx.page_key(F.lit(7)).alias("d"), tx.canonical_id(F.lit("1.1-A_b")).alias("e"),
    ).first()
    assert tuple(r) == ("hello-world", "book", "Animal Farm", "page_0007", "11ab")
