import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from leafaudit.operators import lexicon
from leafaudit.operators.ordered import join_unique
from leafaudit.plans import derived, lexicon_jobs, registry


def brute(text):
    """Items as words with attached punctuation, built left to right."""
    text = re.sub(r"\s+", " ", text).replace("’", "'").replace("‘", "'").replace("`", "'")
    toks = re.findall(lexicon.RUN_TOKEN, text)
    items, i = [], 0
    is_word = lambda t: t[0].isalpha() or t[0] == "'"
    while i < len(toks):
        t = toks[i]
        if t == " ":
            items.append(" ")
            i += 1
        elif is_word(t):
            pre = items.pop()[1] if items and isinstance(items[-1], tuple) else ""
            post, i = "", i + 1
            while i < len(toks) and toks[i] != " " and not is_word(toks[i]):
                post, i = post + toks[i], i + 1
            items.append([t, pre, post])
        else:
            items.append(("punct", t))
            i += 1
    at = [n for n, x in enumerate(items) if isinstance(x, list)]
    out = []
    for k, n in enumerate(at):
        word, pre, post = items[n]
        pause = None
        if k + 1 < len(at):
            nxt = items[at[k + 1]]
            between = items[n + 1 : at[k + 1]]
            pause = bool(between) and (bool(post or nxt[1]) or any(isinstance(x, tuple) for x in between))
        out.append((k, word, pre, post, pause))
    return out


TEXTS = [
    "Hello, (world) it’s a-b  c . d .e f. “Yes” – no", "...start", "end--", "", "1 2 3", "a (b) (c", "x, y; z",
    "one\n two\tthree !! four", "'quoted' don't `tick`", "a .b. c",
]


def test_punctuation_and_pauses(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = rows(lexicon.words_with_punctuation(df, ["id"]), "id", "k", "word", "pre", "post", "pause")
    want = [(i, *w) for i, t in enumerate(TEXTS) for w in brute(t)]
    assert got == sorted(want, key=lambda r: tuple((v is None, v) for v in r))


def test_random_runs_are_cut_like_the_brute_force(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice("abZ'’`  \t\n\u00a0\u2003.,(!1–") for _ in range(draw.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = rows(lexicon.words_with_punctuation(df, ["id"]), "id", "k", "word", "pre", "post", "pause")
    want = [(i, *w) for i, t in enumerate(texts) for w in brute(t)]
    assert got == sorted(want, key=lambda r: tuple((v is None, v) for v in r)) != []
    table = spark.createDataFrame([(None, w, i) for w, i in (("a", "æ"), ("b", "bi"), ("z", "ɑ"))], "book string, word string, ipa string")
    got = rows(lexicon.liaison_link(lexicon.annotated_runs(df, lexicon.pronunciations(table), ["id"]), ["id"]))
    plain, vowel = {"a": "æ", "b": "bɪ", "z": "ɑ"}, {"a", "z"}
    said = []
    for i, t in enumerate(texts):
        found = brute(t)
        for (k, w, pre, post, pause), nxt in zip(found, [*found[1:], (0, "")], strict=False):
            ipa = plain.get(w.lower())
            tie = "‿" if ipa and pause is False and nxt[1].lower() in vowel else ""
            said.append((i, k, pre + (ipa + tie if ipa else " ") + post))
    assert got == sorted(said)


def test_lexicon_scan_and_override(spark):
    lines = spark.createDataFrame(
        [(1, "Apple\t/ˈæpəl/, /x/"), (2, "bad line"), (3, "a\tb\tc"), (4, "apple\t/new/"), (5, " the \t/ðə/")], "seq long, line string"
    )
    base = lexicon.lexicon_scan(lines)
    assert rows(base) == [("apple", "new"), ("the", "ðə")]
    own = spark.createDataFrame([("b", " Apple ", " own ")], "book string, word string, ipa string")
    words = spark.createDataFrame([("b", "Apple"), ("c", "APPLE"), ("b", "zzz")], "book string, word string")
    got = lexicon.lexicon_lookup(words, lexicon.effective_lexicon(base, own), book="book")
    assert rows(got, "book", "word", "ipa") == [("b", "Apple", "own"), ("b", "zzz", None), ("c", "APPLE", "new")]


def test_rewrites(spark):
    cases = {
        "ɹɪpɔɹtəd": "rɪpɔrtɪd", "wɑntəd‿": "wɑntɪd‿", "bæsəz": "bæsɪz", "fæstəst": "fæstɪst", "rilaɪ": "rɪlaɪ",
        "ˈriəl": "ˈriːəl", "əgˈzækt": "ɪgˈzækt", "fæməli": "fæmɪli", "ɪtɝ": "ɪtɜːr", "bəˈsɪdəti": "bɪˈsɪdɪti", "ˈsu": "ˈsuː",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "k string, v string")
    got = {r.k: r.s for r in df.select("k", lexicon.standard_ipa(F.col("k")).alias("s")).collect()}
    assert got == cases


def test_vowel_start_and_liaison(spark):
    df = spark.createDataFrame([("ˈæpəl", True), ("ˌˈ", False), ("kæt", False), ("ː1ə", True), ("", False)], "i string, v boolean")
    assert all(r.g == r.v for r in df.select(lexicon.starts_with_vowel(F.col("i")).alias("g"), "v").collect())
    runs = spark.createDataFrame([(1, "An egg, is q."), (2, ""), (2, "egg Egg (an"), (1, "An egg, is q.")], "id long, text string")
    table = spark.createDataFrame([(None, "an", "ən"), (None, "egg", "ɛg"), (None, "is", "ɪz")], "book string, word string, ipa string")
    spoken = lexicon.annotated_runs(runs, lexicon.pronunciations(table), ["id"])
    one = [(1, 0, "ən‿"), (1, 1, "eg,"), (1, 2, "ɪz"), (1, 3, " .")]
    assert rows(lexicon.liaison_link(spoken, ["id"]), "id", "k", "ipa_text") == sorted(one * 2 + [(2, 0, "eg‿"), (2, 1, "eg"), (2, 2, "(ən")])
    assert rows(lexicon.coverage(spoken, ["id"])) == [(1, 8, 6), (2, 3, 3)]


def test_coverage_from_counts_of_words(spark):
    texts = [*TEXTS, None, "an An’s \u212aegg İs egg\u00a0egg\u2029is", "egg" + " egg" * 50]
    runs = spark.createDataFrame([(f"b{i % 2}", i // 2, t) for i, t in enumerate(texts)], "book string, id long, text string")
    words = [(None, w, w) for w in ("an", "egg", "is", "the", "a")] + [("b1", "an's", "x"), ("b0", "egg", None)]
    table = spark.createDataFrame(words, "book string, word string, ipa string")
    want = lexicon.coverage(lexicon.annotated_runs(runs, table, ["book", "id"], book="book"), ["book", "id"])
    assert rows(lexicon.word_coverage(runs, table, ["book", "id"], book="book")) == rows(want) != []


def test_blocks_of_runs_look_a_word_up_once(spark, monkeypatch):
    looked_up, asked = lexicon.lexicon_lookup, []
    monkeypatch.setattr(lexicon, "lexicon_lookup", lambda words, *a, **b: asked.append(words.count()) or looked_up(words, *a, **b))
    names = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    runs = spark.createDataFrame([(i % 2, i, " ".join(names)) for i in range(80)], "book int, id long, text string")
    table = spark.createDataFrame([(None, w, w) for w in names[::2]], "book int, word string, ipa string")
    spoken = lexicon.annotated_runs(runs, table, ["book", "id"], book="book")
    # one block a book at this size, not one look-up a run (16,000)
    assert asked == [400]
    assert rows(lexicon.coverage(spoken, ["book"])) == [(0, 8000, 4000), (1, 8000, 4000)]


@pytest.mark.parametrize("size", [1, 700, 1 << 20])
def test_entries_do_not_depend_on_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(lexicon, "BLOCK", size)
    monkeypatch.setattr(lexicon, "LEAST_BLOCK", size)
    texts = [*TEXTS, None, "’", "An’s \u212aegg İs egg\u00a0EGG\u2029is", "egg " * 50, "an\u200aegg", "é an’egg"]
    books = ["big"] * 6 + ["b1", "b2", "b3", None]
    placed = [(books[i % len(books)], i // 9, t) for i, t in enumerate(texts * 5)]
    runs = spark.createDataFrame(placed, "book string, id long, text string")
    known = {(None, w): w for w in ("an", "egg", "is", "the", "a", "'", "b1")}
    known |= {("big", "egg"): "big", ("b2", "an's"): "two", ("b1", "is"): "one", ("b3", "egg"): None}
    table = spark.createDataFrame([(*k, v) for k, v in known.items()], "book string, word string, ipa string")
    cut = lambda t: re.findall("[a-zA-Z']+", re.sub("[’‘`]", "'", t or ""))
    entry = lambda book, w: known[book, w] if (book, w) in known else known.get((None, w))
    want = [(b, i, tuple(cut(t)), tuple(entry(b, w.lower()) for w in cut(t))) for b, i, t in placed if cut(t)]
    got = lexicon.annotated_runs(runs, table, ["book", "id"], book="book")
    got = got.select("book", "id", F.transform("parts", lexicon._word), F.transform("entries", lambda e: e["ipa"])).collect()
    assert sorted(((b, i, tuple(p), tuple(e)) for b, i, p, e in got), key=str) == sorted(want, key=str) != []
    # without books
    got = lexicon.annotated_runs(runs, table, ["id"])
    assert got.select(F.sum(F.size("parts"))).first()[0] == got.select(F.sum(F.size("entries"))).first()[0] == sum(len(cut(t)) for t in texts) * 5


def test_words_of_a_block_come_out_when_they_are_many(spark):
    runs = spark.createDataFrame([(1, "b", "An an egg"), (1, "b", "egg is"), (2, None, "an")], "_block long, book string, _text string")
    kinds = "_block long, book string, word string"
    for most in (1, 3, 100):
        got = runs.coalesce(1).mapInArrow(lexicon.words_of_blocks("book", most), kinds).distinct()
        assert rows(got) == [(1, "b", "an"), (1, "b", "egg"), (1, "b", "is"), (2, None, "an")]


def test_words_are_cut_once_for_the_lexicon(spark, tmp_path):
    documents = [(1, "Sing on\u212aing", "s"), (3, "sing b", "s"), (2, "sing", "t"), (4, None, "t")]
    spark.createDataFrame(documents, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    inp = registry.Inputs(spark, str(tmp_path))
    d = inp.dialect
    for view in (derived.lexicon_lines, derived.overrides):
        assert set(spark.sql(view(d, derived.latest_words(d))).collect()) <= set(spark.sql(view(d)).collect())
    want = lexicon.effective_lexicon(lexicon.lexicon_scan(spark.sql(derived.lexicon_lines(d))), spark.sql(derived.overrides(d)))
    assert rows(lexicon_jobs.table(inp)) == rows(want)


def test_lookup_of_a_hot_word(spark):
    words = spark.range(300).select(F.when(F.col("id") % 3 > 0, "the").otherwise(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("word"))
    table = spark.createDataFrame([("the", 1), ("w3", 2)], "word string, n int")
    got = join_unique(words, table, "word", floor=50)
    assert got.groupBy("n").count().orderBy("n").collect() == [(None, 99), (1, 200), (2, 1)]
