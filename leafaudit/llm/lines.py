"""Line deduplication over a suffix array of line ids, in DataFrame functions only.

The non-blank lines of all documents, ordered by document and line, are one sequence of
line ids. Prefix doubling ranks its suffixes: at depth 2^k the rank of a position is the
place of the first position whose next 2^k lines are the same; ranks at depth 2^(k+1)
come from pairs of ranks at depth 2^k. Positions of equal rank form an interval of the
suffix array whose longest common prefix is at least that deep, and positions alone in
their interval drop out. Doubling ends when no interval of two positions is left.

A position that is not the first of its interval begins a later copy of that many lines.
A maximal repeated run of n lines is the union of its first and its last 2^k lines, for the
largest 2^k within n, and both are such copies; so the lines that copies of all depths
cover, joined where they touch, are all later copies of maximal repeated runs.

With a floor (min_words above 1) depth beyond what a run of min_words words needs can't
change which lines go, so doubling ends there (a non-blank line has a word at least).
A run of lines of min_words words that also begins at an earlier place is a later copy.
Every such run is the union of its least runs (those that reach min_words first from a
start, or last before an end), and a run of m lines is named by two ranks at the largest
depth within m, at its start and at its end. So one grouping per kind of least run finds
all lines of all maximal repeated runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafaudit.llm.common import document_key, fresh, same_key, stored, text_or_empty

BLANK = r"^[ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]+$"
GAP = r"[ \t\r\x0b\x0c]+"


def line_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Non-blank lines of distinct documents as (pos, doc, line, ord, words, a, b): pos rises
    by document id (null first), text hash and line; a and b are two hashes of the line."""
    trimmed = F.transform(F.split(text_or_empty(text), "\n", -1), lambda x: F.regexp_replace(x, BLANK, ""))
    facts = F.transform(trimmed, lambda x, i: F.struct(i.alias("line"), F.when(x == "", 0).otherwise(F.size(F.split(x, GAP, -1))).alias("words"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))
    full = F.filter(facts, lambda x: x["words"] > 0)
    picked = docs.select(*document_key(doc_id, text), full.alias("lines")).filter(F.size("lines") > 0)
    once = picked.groupBy("doc_id", "text_hash").agg(F.any_value("lines").alias("lines"))
    sorted_docs = once.repartitionByRange(F.col("doc_id").asc_nulls_first(), "text_hash").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_hash")
    numbered = sorted_docs.withColumn("doc", F.monotonically_increasing_id())
    rows = numbered.select("doc_id", "text_hash", "doc", F.posexplode("lines").alias("ord", "x")).withColumn("pos", F.monotonically_increasing_id())
    return rows.select("pos", "doc", "doc_id", "text_hash", "x.line", "ord", "x.words", "x.a", "x.b")


def ranked(rows: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """Rows that share their keys with another row, with the least pos of those as rank.

    A common line may hold much of the rows: the ranks of keys with more than a thousandth of
    them (at most a thousand keys) are broadcast, and their rows are dealt out by pos."""
    groups = stored(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("pos").alias("rank")).filter("n > 1"), "line-groups")
    large = F.col("n") > max(1000, (groups.agg(F.sum("n")).first()[0] or 0) // 1000)
    known = F.broadcast(groups.filter(large).select(*keys, F.col("rank").alias("known")))
    dealt = rows.join(known, keys, "left").withColumn("part", F.when(F.col("known").isNotNull(), F.col("pos") + 1).otherwise(0))
    rest = groups.filter(~large).select(*keys, F.lit(0).cast("bigint").alias("part"), "rank")
    out = dealt.join(rest, [*keys, "part"], "left").withColumn("rank", F.coalesce("known", "rank"))
    return out.filter("rank is not null").select("pos", "doc", *extra, "rank")


def doubled(live: DataFrame, depth: int) -> DataFrame:
    """Ranks at twice the depth, from those at this depth: (pos, doc, rank)."""
    after = Window.partitionBy("doc").orderBy("pos").rangeBetween(depth, depth)
    pairs = live.select("pos", "doc", F.col("rank").alias("left"), F.max("rank").over(after).alias("right")).filter("right is not null")
    return stored(ranked(pairs, ["left", "right"], []), f"line-ranks-{2 * depth}")


def least_run(ahead: bool, min_words: int) -> Column:
    """Lines of the least run of min_words words that begins (or ends) at a row, all of them
    repeated and adjacent; null if there is none."""
    near = Window.partitionBy("doc").orderBy("pos" if ahead else F.desc("pos")).rangeBetween(0, min_words - 1)
    kind = "struct<n:int,words:int>"
    step = lambda acc, x: (
        F.when((acc["words"] >= min_words) | (x["far"] != acc["n"]), acc).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["words"] + x["words"]).alias("words")).cast(kind))
    )
    items = F.collect_list(F.struct("pos", "words")).over(near)
    return F.aggregate(
        F.transform(F.array_sort(items) if ahead else F.reverse(F.array_sort(items)), lambda x: F.struct(F.abs(x["pos"] - F.col("pos")).alias("far"), x["words"].alias("words"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("words")).cast(kind), step, lambda acc: F.when(acc["words"] >= min_words, acc["n"]),
    )


def repeated_runs(docs: DataFrame, *, min_words: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal runs of lines that are later copies: (doc_id, text_hash, first, last, depth), in line
    numbers from 0 within the text. Depth is the most lines, as a power of two, that one
    earlier place shares with the run (null with a floor). See drop_repeated_lines for what counts."""
    lines = stored(line_rows(docs, doc_id, text), "line-ids")
    if min_words > 1:
        gone = lines_of_later_runs(lines, min_words).withColumn("depth", F.lit(None).cast("bigint"))
    else:
        gone = later_copies(lines)
    ahead = Window.partitionBy("doc").orderBy("pos", F.desc("depth"))
    reach = F.max(F.col("pos") + F.coalesce("depth", F.lit(1)) - 1).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("pos") > reach + 1).cast("int"), F.lit(1))
    island = gone.withColumn("begins", begins).withColumn("island", F.sum("begins").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    whole = [F.any_value(c, True).alias(c) for c in ("doc_id", "text_hash")]
    return island.groupBy("doc", "island").agg(*whole, F.min("line").alias("first"), F.max("line").alias("last"), F.max("depth").alias("depth")).drop("doc", "island")


def later_copies(lines: DataFrame) -> DataFrame:
    """Positions that begin a later copy of `depth` lines, for every depth 2^k to the deepest
    interval: (doc, pos, depth), and at depth 1 the line's number and document too. Each line of
    a copy begins one of depth 1."""
    live, depth, found = stored(ranked(lines, ["a", "b"], ["doc_id", "text_hash", "line"]), "line-ranks-1"), 1, []
    while not live.isEmpty():
        found.append(live.filter("pos > rank").withColumn("depth", F.lit(depth).cast("bigint")).drop("rank"))
        live, depth = doubled(live, depth), depth * 2
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), found or [live.withColumn("depth", F.lit(depth).cast("bigint")).drop("rank")])


def lines_of_later_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """The rows of lines that lie in a run of min_words words or more that begins earlier too."""
    live = stored(ranked(lines, ["a", "b"], ["words"]), "line-ranks-0")
    sized = live.select("pos", "doc", least_run(True, min_words).alias("ahead"), least_run(False, min_words).alias("back"))
    starts = F.explode(F.array(F.struct(F.lit(True).alias("ahead"), F.col("pos").alias("start"), F.col("ahead").alias("m")), F.struct(F.lit(False).alias("ahead"), (F.col("pos") - F.col("back") + 1).alias("start"), F.col("back").alias("m"))))
    runs = sized.select("doc", starts.alias("r")).select("doc", "r.*").filter("m is not null")
    runs = stored(runs.withColumn("k", F.floor(F.log2("m")).cast("int")), "line-runs")
    ranks, depth = live.select("pos", F.lit(0).alias("k"), "rank"), 1
    while depth * 2 <= min_words:
        live, depth = doubled(live, depth), depth * 2
        ranks = ranks.unionByName(live.select("pos", F.lit(depth.bit_length() - 1).alias("k"), "rank"))
    power = F.expr("shiftleft(1L, k)")
    named = runs.withColumn("end", F.col("start") + F.col("m") - power)
    head = ranks.select(F.col("pos").alias("start"), "k", F.col("rank").alias("left"))
    foot = ranks.select(F.col("pos").alias("end"), "k", F.col("rank").alias("right"))
    named = stored(named.join(head, ["start", "k"]).join(foot, ["end", "k"]), "line-named-runs")
    same = ["ahead", "m", "left", "right"]
    firsts = named.groupBy(*same).agg(F.min("start").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = named.join(firsts, same).filter("start > first").select("doc", "start", (F.col("start") + F.col("m") - 1).alias("stop"), "ahead")
    marks = copies.groupBy("doc", F.when(F.col("ahead"), F.col("start")).otherwise(F.col("stop")).alias("pos")).agg(F.max(F.when(F.col("ahead"), F.col("stop"))).alias("to"), F.min(F.when(~F.col("ahead"), F.col("start"))).alias("since"))
    touched = copies.select("doc").distinct()
    within = lines.join(touched, "doc", "left_semi").join(marks, ["doc", "pos"], "left")
    up, down = Window.partitionBy("doc").orderBy("pos"), Window.partitionBy("doc").orderBy(F.desc("pos"))
    return within.withColumn("reach", F.max("to").over(up)).withColumn("from", F.min("since").over(down)).filter("reach >= pos or from <= pos")


def drop_repeated_lines(docs: DataFrame, *, min_words: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without later copies of repeated line runs, all columns and rows kept;
    n_lines and n_removed (lines) are added, replacing columns of these names.

    Lines are compared without white space at their ends; blank lines are no part of runs
    (those between two deleted lines go with them). A run of adjacent lines with min_words words
    or more that also begins earlier (in a document of smaller id, null first, or before
    in the same document, even overlapping) is deleted; the first copy stays. By default
    there is no floor: every repeated line goes but its first copy. Null texts
    stay null, with 0 lines. Rows that share id and text are one document and are treated
    alike; documents of equal id and other texts are ordered by a hash of the text. A
    document may lose all its lines and then has an empty text."""
    runs = repeated_runs(docs, min_words=min_words, doc_id=doc_id, text=text)
    key, digest, cut, parts = fresh("key", "digest", "runs", "lines")
    per_doc = runs.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias(cut)).withColumnsRenamed({"doc_id": key, "text_hash": digest})
    keyed = docs.drop("n_lines", "n_removed").withColumns({key: F.col(doc_id), digest: F.xxhash64(text_or_empty(text))})
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = keyed.join(per_doc, same_key(keyed, per_doc, [key, digest]), "left").select(*[keyed[c] for c in columns], per_doc[cut])
    joined = joined.withColumn(parts, F.when(F.col(cut).isNotNull(), F.split(F.col(text), "\n", -1)))
    gaps = F.transform(F.col(cut), lambda r, i: F.struct(F.when(i == 0, 0).otherwise(F.element_at(F.col(cut), i)["last"] + 1).alias("first"), r["first"].alias("end")))
    gaps = F.concat(gaps, F.array(F.struct((F.element_at(F.col(cut), -1)["last"] + 1).alias("first"), F.size(parts).alias("end"))))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col(parts), g["first"] + 1, g["end"] - g["first"])))
    removed = F.aggregate(F.col(cut), F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    body = text_or_empty(text)
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.char_length(body) - F.char_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1)
    return joined.withColumns({"n_lines": n_lines.cast("long"), "n_removed": F.coalesce(removed, F.lit(0)).cast("long"), text: F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))}).drop(cut, parts)
