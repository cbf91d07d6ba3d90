import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafaudit.llm import bpe, exact, html, packing, quality, search, secrets

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " ", "a" * 5000, "It's we'll DON'T 12345 ½ x\n\n y  z <|endoftext|> end", "À ΣΑΣ é\U0001f600 日本語 !!! ===", "tail \n", "the cat sat on the mat"] * 2


def frame(spark):
    return spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string").repartition(2)


def test_encoding_and_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    word, byte = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    tok, tok2 = Tokenizer.from_file(word), Tokenizer.from_file(byte)
    got = {r.doc_id or 0: r for r in bpe.encode_documents(frame(spark), word).collect()}
    counts = {r.doc_id or 0: r for r in bpe.token_counts(frame(spark), byte).collect()}
    digests = {r.doc_id or 0: r for r in bpe.encoding_digests(frame(spark), word).collect()}
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert (got[i].ids, got[i].decoded) == (ids, decoded)
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert counts[i].n_tokens == len(tok2.encode(t or "", add_special_tokens=False).ids)


def test_merging_looks_up_only_changed_pairs(monkeypatch):
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
    words = ["".join(chr(97 + (i * j + j * j) % 26) for j in range(5 + i % 12)) for i in range(2000)] + ["ababab", "aaaaa"]
    looked, search_of = [], np.searchsorted
    monkeypatch.setattr(bpe.np, "searchsorted", lambda keys, key: looked.append(len(key)) or search_of(keys, key))
    ids = vocabulary.merge(words)
    symbols = sum(map(len, words))
    assert sum(looked) <= symbols + 2 * (symbols - sum(map(len, ids)))


def test_ids_of_parts_match_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, vocabulary = Tokenizer.from_file(path), bpe.Vocabulary.read(path)
    for text in [t or "" for t in TEXTS] + ["a\x1cb c", "e\u0301 \u0301x ΑΣ Σ", "don't,'re !!x 12a"]:
        keys = vocabulary.keys_of(text)
        table = vocabulary.encode_ids(set(keys))
        assert np.frombuffer(b"".join([table[k] for k in keys]), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_is_a_cut_of_all_ids(spark):
    word = public_tokenizers.path("word_bpe_49k.json")
    docs = frame(spark)
    ids = {r.doc_id: [*r.ids, 1] for r in bpe.encode_documents(docs, word).collect()}
    pieces = packing.pack(docs, word, capacity=64).collect()
    for d, all_ids in ids.items():
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0, *[p.length for p in own]])[:-1])
        assert sum(p.length for p in own) == len(all_ids)
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(all_ids[p.start : p.start + p.length], "<u4").tobytes())
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1]) and sum(n for _, n in parts) <= 64


def test_exact_duplicates(spark):
    rows = [(1, "a"), (5, "a"), (5, "a"), (None, "a"), (2, None), (3, ""), (9, "b"), (None, "c"), (None, "c")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 5, 4, False), (5, 5, 4, True), (5, 5, 4, False), (None, 5, 4, False), (2, 3, 2, False), (3, 3, 2, True), (9, 9, 1, True), (None, None, 2, True), (None, None, 2, False)], key=str)
    assert exact.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4
    assert exact.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(120)] + [(7, [1.0] * 5), (None, [2.0] * 5), (200, None), (201, [1.0, None]), (202, [float("nan")]), (203, []), (204, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", search.integer_components().alias("components"))
    got = search.top_k(df, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), k=6, block_rows=17, query_rows=2).collect()
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q is not None and q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for i, w in good if i != q)[:6]
            want += [(q, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(best)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_secrets(spark):
    key = "k9" * 12
    text = f"password = hunter22 AKIA{'Q' * 16} é token:abc api_key='{'0f' * 14}' {key}"
    rows = [(1, text, "a"), (2, text.replace(key, "w8" * 12), "a"), (3, "w8" * 12, "b"), (4, None, None), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.secret_digests(secrets.scan_secrets(docs, most_owners=1)).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (2, 1, 1)
    assert "opaque" in got[1].spans and "opaque" not in got[2].spans and got[3].spans == "" and got[4].n_hex == 0
    kind, start, stop = got[1].spans.split(",")[-1].split(":")
    assert text[int(start) : int(stop)] == key and kind == "opaque"
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(docs).collect()}
    assert "hunter22" not in masked[1] and "AKIA" not in masked[1] and key not in masked[1] and masked[4] is None
    many = "x token=abcdef12 " * 700
    spans = secrets.secret_digests(secrets.scan_secrets(spark.createDataFrame([(1, many, "a")], "doc_id long, text string, source string"))).first().spans
    assert spans == ",".join(f"assign:{m.start()}:{m.end()}" for m in re.finditer("token=abcdef12", many))


RULES = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)]


def brute_secrets(rows, most_owners=2, most_repositories=8):
    found, seen = [], {}
    for doc_id, text, source in rows:
        text = text or ""
        base = [(m.start(), n, m.end(), m.group(g)) for n, (_, p, least, g) in enumerate(RULES) for m in re.finditer(p, text) if len(m.group(g)) >= least]
        more = [(m.start(), 3, m.end(), m.group()) for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}", text) if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())]
        more = [s for s in more if not any(b[0] < s[2] and s[0] < b[2] for b in base)]
        found.append((doc_id, base, more))
        for s in base + more:
            seen.setdefault(s[3], {}).setdefault(text, set()).add(source)
    live = {v: len(t) <= most_repositories and len({min(o, key=lambda x: (x is None, x or "")) for o in t.values()}) <= most_owners for v, t in seen.items()}
    kinds = ["assign", "access", "hex", "opaque"]
    return sorted((d, ",".join(f"{kinds[n]}:{a}:{z}" for a, n, z, _ in sorted(base + [m for m in more if live[m[3]]]))) for d, base, more in found)


def test_secrets_match_brute_force_with_ownership(spark):
    rng = np.random.default_rng(8)
    late = "L" * 200 + "1" + "x" * 30  # its first digit comes after 200 letters
    values = ["".join(rng.choice(list("abcXYZ019_-"), 24)) + "a1" for _ in range(12)] + [late, "9" * 300 + "Z", "letters" * 6, "12345678901234567890123"]
    rows = [(i, " ".join(rng.choice([*values, "word", "é", "token = abc123xyz", "AKIA" + "Q" * 18, "0f" * 13], 4)), f"s{int(rng.integers(4))}") for i in range(60)]
    rows += [(100, f"one {late}y copy", "a"), (101, f"one {late}y copy", "b"), (102, None, None), (103, "", "a")]
    rows += [(200 + i, f"hot source {i} example0123456789abcdefgh", "a") for i in range(50)]  # an example all over one source
    rows += [(300, "copied live0credential99887766XY", "a"), (301, "copied live0credential99887766XY", "b"), (302, "copied live0credential99887766XY", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted((r.doc_id, r.spans) for r in secrets.secret_digests(secrets.scan_secrets(docs)).collect())
    assert got == brute_secrets(rows)
    by = dict(got)
    assert "opaque" in by[100] and "opaque" in by[301] and by[210] == ""
    assert secrets.scan_secrets(docs.drop("source").limit(0)).count() == 0


def test_quality_learns_and_bears_odd_rows(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(60)]
    good = [(i, " ".join(rng.choice(words, 40))) for i in range(300)]
    bad = [(1000 + i, " ".join([w.upper() + "!!" for w in rng.choice(words, 40)])) for i in range(100)]
    docs = spark.createDataFrame([*good, *bad, (None, None), (5000, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:200]] + [(i, 0) for i, _ in bad[:70]] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert all(got[i].predicted == 1 for i, _ in good[200:]) and all(got[i].predicted == 0 for i, _ in bad[70:])
    assert 0 <= got[None].score <= 1
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_html():
    page = (
        "<body><header class=site><a href=x>Home</a></header><nav><ul><li>Menu</ul></nav><div id=main><div class=post><h2>Title</h2><p>One, two, three, four <a href=y>link</a> "
        "five &amp; six.<p>Second,   quite\nlong, with many words and commas, indeed.</div><div class=comments><p>I like, this, comment, very, much, indeed, yes, I, do</div></div>"
        "<aside>side</aside><div class='cookie-notice'><p>We use cookies, many, many</div><footer>foot</footer><script>var t='</p>'</script>"
    )
    assert html.main_text(page) == "Title\n\nOne, two, three, four link five & six.\n\nSecond, quite long, with many words and commas, indeed."
    assert html.main_text("") == html.main_text("<p></p>") == ""


def test_context_vectors_do_not_depend_on_the_layout(spark):
    rnd = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rnd.integers(0, 300, 12)) for _ in range(200)] + ["once only", "", "rare w1"] + ["rare"] * 3
    sums, counts = {}, {}
    for words in map(str.split, texts):
        for i, w in enumerate(words):
            near = [words[j] for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)) if j != i]
            counts[w] = counts.get(w, 0) + 1
            sums[w] = sums.get(w, 0) + quality.index_vectors(near, quality.WIDTH, 1).sum(axis=0)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for parts in (1, 60):
        got = quality.context_sums(docs.repartition(parts), least=4)
        assert got.keys() == {w for w, n in counts.items() if n >= 4} and "rare" in got
        assert all(np.allclose(v, 2 * sums[w] / (np.linalg.norm(sums[w]) or 1), atol=1e-5) for w, v in got.items())


def test_every_frequent_word_gets_a_context_vector(spark, monkeypatch):
    words = [f"w{i}" for i in range(21_000)] * 4
    docs = spark.createDataFrame([(i, " ".join(words[i::300])) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    found, sums = [], quality.context_sums
    monkeypatch.setattr(quality, "context_sums", lambda *a, **b: found.append(sums(*a, **b)) or found[-1])
    assert quality.score_quality(docs, labels).count() == 300
    assert len(found[0]) == 21_000


def test_few_labels_of_both_kinds_train(spark):
    good, bad = "the cat sat on the mat with the other cats", "%% $$ 19 ## 7 @@ !! 5 && 22"
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(30)], "doc_id long, text string")
    for n in (2, 6, 19):
        labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")
        got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
        assert all(got[i] > 0.6 if i % 2 else got[i] < 0.4 for i in range(30))


PROSE = "".join(f"<p>Part {i}, with commas, and words enough to read like the prose of an article.</p>" for i in range(4))
TEXT = "\n\n".join(f"Part {i}, with commas, and words enough to read like the prose of an article." for i in range(4))


@pytest.mark.parametrize("name", ["layout has-sidebar", "post tag-python", "share-page", "main no-sidebar", "header-layout", "post comments-open", "page-ads"])
def test_html_wrappers_called_noise_are_kept(name):
    menu = '<div class="menu"><a href="/a">One</a> <a href="/b">Two</a></div><div class="ad">Buy this, now.</div>'
    for tag in ("div", "section", "x-page"):
        assert html.main_text(f'<body>{menu}<{tag} class="{name}">{PROSE}</{tag}></body>') == TEXT
        assert html.main_text(f'<body>{menu}<main><{tag} id="{name}">{PROSE}</{tag}></main></body>') == TEXT


def test_html_parts_of_an_article():
    remarks = "".join(f'<article class="comment"><p>Remark {i}, by a reader, longer than you think it would be, and more.</p></article>' for i in range(40))
    for extra in (f'<div id="comments">{remarks}</div>', '<div class="ad">Buy, now.</div>', '<section class="related-posts"><ul><li><a href="/x">Other story</a></li></ul></section>'):
        assert html.main_text(f"<article>{PROSE}{extra}</article>") == TEXT
    kept = html.main_text(f'<article>{PROSE}<section id="related-work"><p>Prior work, in prose.</p></section><ul><li><a href="/r">Reference one</a></li></ul></article>')
    assert kept == TEXT + "\n\nPrior work, in prose.\n\nReference one"
    cards = "".join(f'<a href="/{i}"><div><p>Card {i}, with commas, and words enough to read like the prose of an article.</p></div></a>' for i in range(9))
    assert html.main_text(f"<body><div>{cards}</div><div>{PROSE}</div></body>") == TEXT


@pytest.mark.parametrize("bad", ["<p " * 20000, "<!--" * 20000, '<a href="' * 20000, "</" * 20000, "<![CDATA[" * 20000, "<div>" * 4000 + "x", "<div>x" * 4000, "<a><div>" * 2000 + "x", "&" * 60000])
def test_html_malformed_pages_take_no_long(bad):
    began = time.time()
    html.main_text(f"<article>{PROSE}</article>" + bad)
    assert time.time() - began < 5


def test_html_rows(spark):
    page = f"<article>{PROSE}</article>"
    rows = [(1, "u", page, "own"), (1, "u", page, "own"), (2, None, None, None), (3, "v", "", ""), (None, "w", "<!-- never ends " + page, "x"), (4, "z", "<article><p>" + "long, " * 50000 + "</p></article>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = html.extract_main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r.page_id or 0, r.n_chars) for r in got.collect()))
    assert found == [(0, 0), (1, len(TEXT)), (1, len(TEXT)), (2, 0), (3, 0), (4, 6 * 50000 - 1)]
    assert html.extract_main_text(pages.limit(0)).count() == 0
