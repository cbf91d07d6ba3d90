import hashlib
import zlib

from pyspark.sql import functions as F

from leafaudit.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    d, t, lang, source, n = row
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t) if lower and t is not None else t
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, t)))


def tree(nodes):
    """Root, and for each node the (left, right) siblings upward."""
    paths, at, levels = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(levels) > 1:
        for i, p in enumerate(at):
            run = p // 8 * 8
            paths[i].append(("".join(levels[run:p]), "".join(levels[p + 1 : run + 8])))
            at[i] = p // 8
        levels = [h(*levels[i : i + 8]) for i in range(0, len(levels), 8)]
    return (levels or [None])[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    trees = {g: tree([leaf(r) for r in ordered[g]]) for g in names}
    root, upper = tree([trees[g][0] for g in names])
    out = []
    for g, over in zip(names, upper, strict=True):
        for r, path in zip(ordered[g], trees[g][1], strict=True):
            path = path + over
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(r, hit)
            for left, right in path:
                folded = h(left, folded, right)
            out.append((r[0], leaf(r), trees[g][0], root, h(*(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, g string, leaf string, p int").repartition(3)
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.merkle_manifest(docs, received={"text": F.when(struck, merkle.lower_ascii("text")).otherwise(F.col("text"))})
    return sorted(map(tuple, found.collect()), key=str)


def test_manifest_matches_brute_force(spark):
    rows = [(i, f"Text {i} ÀB", "en", f"s{i % 4}", i) for i in range(530)]  # the hot group
    rows += [(-5, "A", "en", "s", 1), (None, "N", "en", None, None), (None, None, "en", None, None), (7, "other", "en", "s", 1)] + [(9, "AA", "en", "s", 2)] * 20
    rows += [(1000 + i, "Z" * 5000 * i, lang, "", 0) for i, lang in enumerate([None, "", "=", "a", "B", "é", "日本", "😀", "zz", "zy"])]
    rows += [(i, None, "fr", None, None) for i in range(2000, 2009)]
    result = got(spark, rows)
    assert result == brute(rows)
    assert any(r[-1] for r in result) and not all(r[-1] for r in result)


def test_small_trees(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, "x", None, None, None)]) == brute([(1, "x", None, None, None)])
    for n in (2, 8, 9):
        rows = [(i, "Ab", "en", "s", 2) for i in range(n)]
        assert got(spark, rows) == brute(rows)


def test_lower_ascii_leaves_other_letters(spark):
    texts = ["ABC xyz", "ÀÉ ABC İ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(merkle.lower_ascii("text"))
    assert [r[0] for r in df.collect()] == ["abc xyz", "ÀÉ abc İ", "", None]
