"""Pronunciation lexicon, word runs, punctuation and liaison."""

from __future__ import annotations

import re
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafaudit.operators.ordered import join_unique
from leafaudit.session import shared_table

# Vowel letters, symbol simplification and ordered rewrites of the
# pronunciation alphabet.
VOWELS = "ɑæʌɔɛɪiuɜəɝaeoʊɒy"
SIMPLER = [("ɹ", "r"), ("ɫ", "l"), ("ɚ", "ər"), ("ɝ", "ɜːr"), ("ɡ", "g"), ("ɛ", "e")]
REWRITES = [
    (r"əkli", "ɪkli"),
    (r"əli", "ɪli"),
    (r"(?U)([td])əd\b", "$1ɪd"),
    (r"([td])əd‿", "$1ɪd‿"),
    (r"(?U)([szʃʒ]|tʃ|dʒ)əz\b", "$1ɪz"),
    (r"([szʃʒ]|tʃ|dʒ)əz‿", "$1ɪz‿"),
    (r"(?U)əst\b", "ɪst"),
    (r"əst‿", "ɪst‿"),
    (r"(?U)əti\b", "ɪti"),
    (r"əti‿", "ɪti‿"),
    (r"(?U)(?<![ˈˌ])\b(d|r|b)[iə]", "$1ɪ"),
    (r"(?U)\bəgˈz", "ɪgˈz"),
    (r"ɜːrˈ", "əˈr"),
    (r"([ˈˌ][b-df-hj-np-tv-zʃʒθðŋrltwdg]*)([iuɑɔ])(?![ː])", "$1$2ː"),
]
LIAISON = "‿"
RUN_TOKEN = r"[a-zA-Z']+|\s+|[^a-zA-Z'\s]+"
#: Patterns on runs flattened to single blanks, which hold no other white space.
PUNCTUATION = "[^a-zA-Z' ]"
#: Blanks, and punctuation that no word follows.
GAP = rf" *+(?:{PUNCTUATION}++(?![a-zA-Z']) *+)*+"
#: Classes are united and groups optional as that is quicker than the plain form.
WORD_WITH_PARTS = rf"((?:{PUNCTUATION}++)?+)([a-z[A-Z']]++)((?:{PUNCTUATION}++)?+)({GAP})"
#: Bytes of text whose runs share one copy of their lexicon entries; results don't depend
#: on it. Small inputs are cut into SPREAD blocks, but not below LEAST_BLOCK.
BLOCK, LEAST_BLOCK, SPREAD = 1 << 23, 1 << 16, 64
#: Unicode white space but the blank; runs of white space that are not one blank.
ODD_SPACE = r"\t-\r\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
LONG_SPACE = rf" [ {ODD_SPACE}]++|[{ODD_SPACE}][ {ODD_SPACE}]*+"


def lexicon_scan(lines: DataFrame) -> DataFrame:
    """Base lexicon from tab-separated lines (seq, line): two fields, first pronunciation,
    slashes removed, last duplicate wins. Equal lines are one before they are parsed."""
    fields = F.split(F.btrim("line", F.lit(" \t\r\n")), "\t")
    rows = lines.groupBy("line").agg(F.max("seq").alias("seq")).withColumn("_f", fields).filter(F.size("_f") == 2)
    word = F.lower(F.trim(F.get("_f", F.lit(0))))
    first = F.btrim(F.trim(F.get(F.split(F.trim(F.get("_f", F.lit(1))), ","), F.lit(0))), F.lit("/"))
    return rows.groupBy(word.alias("word")).agg(F.max_by(first, "seq").alias("ipa"))


def effective_lexicon(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Base rows (book null) and per-book overrides (book, word, ipa) in one table."""
    own = overrides.select("book", F.lower(F.trim("word")).alias("word"), F.trim("ipa").alias("ipa"))
    return base.select(F.lit(None).cast("string").alias("book"), "word", "ipa").unionByName(own)


def _straight(text: Column) -> Column:
    for sign in "’‘`":
        text = F.replace(text, F.lit(sign), F.lit("'"))
    return text


def run_parts(runs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, parts): for each word of a run, in one string with tabs between them, the
    punctuation taken before it, the word, the punctuation taken after it, and the gap up
    to the next word's share.

    Punctuation right after a word belongs to that word; otherwise one token right before a
    word belongs to it; anything else lies in a gap. Runs are flattened to single blanks
    first, so that line feed and tab can separate what one pattern finds."""
    flat = _straight(F.regexp_replace(F.col(text), LONG_SPACE, " "))
    worded = F.regexp_replace(flat, f"^{GAP}", "")
    marked = F.regexp_replace(worded, WORD_WITH_PARTS, "$1\t$2\t$3\t$4\n")
    # no filter here: it would be pushed below and find the words a second time
    return runs.select(*keys, F.filter(F.split(marked, "\n", -1), lambda line: line != "").alias("parts"))


def _pre(part: Column) -> Column:
    return F.substring_index(part, "\t", 1)


def _word(part: Column) -> Column:
    return F.substring_index(F.substring_index(part, "\t", 2), "\t", -1)


def _post(part: Column) -> Column:
    return F.substring_index(F.substring_index(part, "\t", -2), "\t", 1)


def _gap(part: Column) -> Column:
    return F.substring_index(part, "\t", -1)


def _pause(part: Column, nxt: Column) -> Column:
    """Whether a pause follows a word, null after the last."""
    sign = (_post(part) != "") | ~nxt.startswith("\t") | (F.trim(_gap(part)) != "")
    return F.when(nxt.isNotNull(), ~part.endswith("\t") & sign)


def words_with_punctuation(runs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per word with its attached punctuation and whether a pause follows it, all
    decided inside the row."""

    def shape(part: Column, k: Column) -> Column:
        pause = _pause(part, F.get("parts", k + 1))
        return F.struct(k.cast("bigint").alias("k"), _word(part).alias("word"), _pre(part).alias("pre"), _post(part).alias("post"), pause.alias("pause"))

    return run_parts(runs, keys, text).select(*keys, F.inline(F.transform("parts", shape)))


def pronunciations(lexicon: DataFrame) -> DataFrame:
    """Add the spoken form, the form tied to a following vowel, and whether it starts with one.

    The rewrites run once per lexicon entry instead of once per word of the corpus."""
    tied = standard_ipa(F.concat("ipa", F.lit(LIAISON)))
    return lexicon.select(
        "book", "word", "ipa",
        standard_ipa(F.col("ipa")).alias("spoken"), tied.alias("tied"), starts_with_vowel(F.col("ipa")).alias("vowel"),
    )


def lexicon_lookup(words: DataFrame, lexicon: DataFrame, *, book: str | None = None) -> DataFrame:
    """Add the lexicon columns (ipa, ...): the book's override, else the base entry, else null.

    Frequent words don't meet in one task (join_unique)."""
    values = [c for c in lexicon.columns if c not in ("book", "word")]
    entry = F.struct(*values)
    base = lexicon.filter("book is null").select(F.col("word").alias("_key"), entry.alias("_e"))
    keyed = asked = words.withColumn("_key", F.lower("word"))
    if book:
        # first, as few words have entries of their own that go on to the next shuffle
        own = lexicon.filter("book is not null").select(F.col("book").alias("_b"), F.col("word").alias("_w"), entry.alias("_own"))
        asked = keyed.join(own.hint("shuffle_hash"), (F.col("_key") == F.col("_w")) & (F.col(book) == F.col("_b")), "left")
    out = join_unique(asked, base.hint("shuffle_hash"), "_key", counted=keyed)
    if book:
        out = out.withColumn("_e", F.coalesce("_own", "_e"))
    return out.select(*words.columns, "_e.*")


def run_blocks(runs: DataFrame, keys: list[str], *, book: str | None = None, text: str = "text") -> DataFrame:
    """(keys, text, _block) of the runs that hold words, as a table: runs dealt to blocks of about BLOCK bytes.

    A book of more than a block's size gets blocks of its own, by the place of its runs in
    the input; smaller books share blocks. The driver sees the large books alone."""
    worded = runs.select(*keys, F.col(text).alias("_text")).filter(F.col(text).rlike("[a-zA-Z'’‘`]"))
    owner = F.col(book) if book else F.lit(None).cast("string")
    sizes = shared_table(worded.groupBy(owner.alias("_owner")).agg(F.sum(F.octet_length("_text")).alias("_size")), "run-sizes")
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    size = min(BLOCK, max(LEAST_BLOCK, total // SPREAD))
    large = sizes.filter(F.col("_size") > size).collect()
    common = (total - sum(r["_size"] for r in large)) // size + 1
    own, at = [], common
    for r in large:
        own.append((r["_owner"], at, -(-r["_size"] // size)))
        at += own[-1][2]
    blocks = T.StructType([sizes.schema["_owner"], T.StructField("_first", T.LongType()), T.StructField("_share", T.LongType())])
    table = F.broadcast(runs.sparkSession.createDataFrame(own, blocks))
    placed = worded.withColumn("_at", F.xxhash64(F.monotonically_increasing_id())).join(table, owner.eqNullSafe(F.col("_owner")), "left")
    block = F.coalesce(F.col("_first") + F.pmod("_at", "_share"), F.pmod(F.xxhash64(owner), F.lit(common)))
    return shared_table(placed.select(*keys, "_text", block.alias("_block")), "runs")


def _word_finder():
    """Function of a text in bytes (only ASCII counts): its lowercase words, the same as in
    run_parts. A nested one, as those go to workers whole, without an import there."""
    found = re.compile(rb"[a-z']+").findall
    signs = [sign.encode() for sign in "’‘`"]

    def words(text: bytes) -> list[bytes]:
        text = text.lower()
        for sign in signs:
            text = text.replace(sign, b"'")
        return found(text)

    return words


def words_of_blocks(book: str | None, most: int = 1 << 19):
    """Function of Arrow batches of run_blocks(): distinct words per block (and book), as far
    as they meet among the last `most` ones."""
    words_of = _word_finder()

    def table(held: dict, kinds: pa.Schema) -> pa.RecordBatch:
        words = pa.array([w for found in held.values() for w in found], pa.binary()).cast(pa.string())
        columns = [pa.array([at[i] for at, found in held.items() for _ in found], kind.type) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, words], names=[*kinds.names, "word"])

    def run(batches):
        held, n = {}, 0
        for batch in batches:
            owners = batch[book].to_pylist() if book else repeat(None)
            kinds = pa.schema([batch.schema.field(c) for c in ["_block", *([book] if book else [])]])
            for block, owner, text in zip(batch["_block"].to_pylist(), owners, batch["_text"].cast(pa.binary()), strict=False):
                found = held.setdefault((block, owner), set())
                n -= len(found)
                found.update(words_of(text.as_py()))
                n += len(found)
                if n >= most:
                    yield table(held, kinds)
                    held, n = {}, 0
        if held:
            yield table(held, kinds)

    return run


def entries_of_words(keys: list[str], values: list[str], book: str | None):
    """Function of the runs of a block and the entries found for its words: the runs with the
    entry of each word, null for unknown ones."""
    words_of = _word_finder()

    def run(runs: pa.Table, found: pa.Table) -> pa.Table:
        places: dict = {}
        owners = found[book].to_pylist() if book else repeat(None)
        for i, (owner, word) in enumerate(zip(owners, found["word"].cast(pa.binary()).to_pylist(), strict=False)):
            places.setdefault(owner, {})[word] = i
        picked, ends = [], [0]
        owners = runs[book].to_pylist() if book else repeat(None)
        for owner, text in zip(owners, runs["_text"].cast(pa.binary()), strict=False):
            picked += map(places.get(owner, {}).get, words_of(text.as_py()))
            ends.append(len(picked))
        entries = pa.StructArray.from_arrays([found[v].combine_chunks() for v in values], names=values)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries.take(pa.array(picked, pa.int32())))
        return runs.select([*keys, "_text"]).append_column("entries", lists)

    return run


def annotated_runs(runs: DataFrame, lexicon: DataFrame, keys: list[str], *, book: str | None = None, text: str = "text") -> DataFrame:
    """(keys, parts, entries): the words of each run and, at the same places, their lexicon
    entries (null for unknown words).

    Each distinct word of a block of runs is looked up once, and its entry is sent to the
    block once; what is shuffled by run is its text alone."""
    values = [c for c in lexicon.columns if c not in ("book", "word")]
    of = [book] if book else []
    staged = run_blocks(runs, keys, book=book, text=text)
    place = [staged.schema[c] for c in ["_block", *of]]
    words = staged.select("_block", *of, "_text").mapInArrow(words_of_blocks(book), T.StructType([*place, T.StructField("word", T.StringType())]))
    found = lexicon_lookup(shared_table(words.distinct(), "run-words"), lexicon, book=book).dropna("all", subset=values)
    fields = [staged.schema[c] for c in [*keys, "_text"]]
    entry = T.StructType([found.schema[c] for c in values])
    placed = staged.groupBy("_block").cogroup(found.groupBy("_block"))
    rows = placed.applyInArrow(entries_of_words(keys, values, book), T.StructType([*fields, T.StructField("entries", T.ArrayType(entry))]))
    return run_parts(rows, [*keys, "entries"], "_text").select(*keys, "parts", "entries")


def word_counts(runs: DataFrame, keys: list[str], words: str = "_words") -> DataFrame:
    """(keys, word, n): each distinct word of an array of words and how often it is there."""
    ordered = runs.select(*keys, F.sort_array(words).alias("_o"))
    opens = lambda i: (i == 0) | (F.get("_o", i) != F.get("_o", i - 1))
    # no filter here: it would be pushed below and sort the words a second time
    starts = ordered.select(*keys, "_o", F.when(F.size("_o") > 0, F.filter(F.sequence(F.lit(0), F.size("_o") - 1), opens)).alias("_s"))
    upto = lambda j: F.coalesce(F.get("_s", j + 1), F.size("_o"))
    return starts.select(*keys, F.inline(F.transform("_s", lambda s, j: F.struct(F.get("_o", s).alias("word"), (upto(j) - s).alias("n")))))


def word_coverage(runs: DataFrame, lexicon: DataFrame, keys: list[str], *, book: str | None = None, text: str = "text") -> DataFrame:
    """What coverage() gives for annotated runs, from the counts of each run's words alone."""
    split = F.array_remove(F.split(_straight(F.col(text)), "[^a-zA-Z']++"), "")
    words = word_counts(runs.select(*keys, split.alias("_words")), keys).withColumnRenamed("n", "_n")
    found = lexicon_lookup(shared_table(words, "run-words"), lexicon.select("book", "word", "ipa"), book=book)
    known = F.coalesce(F.sum(F.when(F.col("ipa").isNotNull(), F.col("_n"))), F.lit(0))
    return found.groupBy(*keys).agg(F.sum("_n").cast("bigint").alias("words"), known.cast("bigint").alias("known"))


def coverage(looked_up: DataFrame, keys: list[str]) -> DataFrame:
    """Words and known words of annotated runs, summed by key."""
    known = F.size(F.filter("entries", lambda e: e["ipa"].isNotNull()))
    return looked_up.groupBy(*keys).agg(F.sum(F.size("parts")).cast("bigint").alias("words"), F.sum(known).cast("bigint").alias("known"))


def starts_with_vowel(ipa: Column) -> Column:
    core = F.regexp_replace(ipa, r"[ˈˌː\d]|[^\p{L}\p{N}_]", "")
    return F.substring(core, 1, 1).isin(list(VOWELS))


def standard_ipa(ipa: Column) -> Column:
    for old, new in SIMPLER:
        ipa = F.replace(ipa, F.lit(old), F.lit(new))
    for pattern, new in REWRITES:
        ipa = F.regexp_replace(ipa, pattern, new)
    return ipa


def liaison_link(annotated: DataFrame, keys: list[str]) -> DataFrame:
    """Spoken words (keys, k, ipa_text) of runs annotated with the columns of pronunciations().

    A word is tied to the next one if that starts with a vowel and no pause lies between;
    both are in the same row."""

    both = F.arrays_zip("parts", "entries", F.slice("parts", 2, 1 << 30).alias("next"), F.slice("entries", 2, 1 << 30).alias("after"))
    # exploded before the rest is computed, as functions of array items are not compiled
    words = annotated.select(*keys, F.posexplode(both).alias("k", "_w"))
    part, entry = F.col("_w.parts"), F.col("_w.entries")
    tie = F.coalesce(F.col("_w.after.vowel"), F.lit(False)) & ~F.coalesce(_pause(part, F.col("_w.next")), F.lit(True))
    spoken = F.coalesce(F.when(tie, entry["tied"]).otherwise(entry["spoken"]), F.lit(" "))
    return words.select(*keys, F.col("k").cast("bigint").alias("k"), F.concat(_pre(part), spoken, _post(part)).alias("ipa_text"))
