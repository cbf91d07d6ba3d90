import random

from pyspark.sql import functions as F

from leafaudit.llm.lines import drop_repeated_lines, repeated_runs


def expected(rows, min_words):
    docs = sorted({(d, t or "") for d, t in rows})
    seq = []
    for d, t in docs:
        kept = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
        seq += [(d, t, i, x, len(kept) - k) for k, (i, x) in enumerate(kept)]
    gone = set()
    for p in range(len(seq)):
        best = 0
        for q in range(p):
            n = 0
            while n < seq[p][4] and n < seq[q][4] and seq[p + n][3] == seq[q + n][3]:
                n += 1
            best = max(best, n)
        if best and sum(len(seq[p + i][3].split()) for i in range(best)) >= min_words:
            gone |= set(range(p, p + best))
    out = []
    for d, t in rows:
        whole = set()
        for p in gone:
            if seq[p][:2] == (d, t or ""):
                # blank lines between two deleted lines go with them
                last = seq[p + 1][2] if p + 1 in gone and seq[p][4] > 1 else seq[p][2] + 1
                whole |= set(range(seq[p][2], last))
        kept = [x for i, x in enumerate((t or "").split("\n")) if i not in whole]
        out.append((d, t if not whole else "\n".join(kept), 0 if t is None else t.count("\n") + 1, len(whole)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rnd = random.Random(5)
    pool = [" ".join("abcdefgh"[rnd.randrange(8)] for _ in range(rnd.randrange(1, 5))) for _ in range(12)] + ["", "  ", "long " * 9]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(14)))) for i in range(60)]
    rows += [(7, rows[3][1]), (90, rows[3][1]), (91, None), (92, ""), (3, rows[3][1]), (93, "x " * 40 + "\n\n" + "y " * 40), (94, " " + "x " * 40 + "\n" + "y " * 40), (95, "a\n" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for min_words in (3, 8, 17):
        got = drop_repeated_lines(docs, min_words=min_words).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert sorted(map(tuple, got), key=str) == expected(rows, min_words)


def test_null_ids_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "b " * 60, "x"), (1, "b " * 60, "y"), (None, None, None)], "doc_id long, text string, first string")
    got = {(r.doc_id, r.first): (r.text, r.n_removed) for r in drop_repeated_lines(docs).collect()}
    assert got == {(None, "x"): ("b " * 60, 0), (1, "y"): ("", 1), (None, None): (None, 0)}
    assert drop_repeated_lines(docs.limit(0)).count() == 0


def test_by_default_no_repeated_line_is_too_short(spark):
    rnd = random.Random(6)
    pool = [" ".join("abcdefgh"[rnd.randrange(8)] for _ in range(rnd.randrange(1, 5))) for _ in range(40)] + ["", "  "]
    long = "\n".join(f"line {i}" for i in range(80))
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(14)))) for i in range(60)]
    rows += [(7, rows[3][1]), (90, rows[3][1]), (91, None), (92, long), (93, "new\n" + long + "\nend"), (94, "x"), (95, "x\n\nx\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = drop_repeated_lines(docs).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, 1)
    kept = [x.strip() for r in got if r.doc_id != 7 and r.text for x in r.text.split("\n") if x.strip()]
    assert len(kept) == len(set(kept))


def test_query_and_pipeline_stage_leave_no_short_repeated_line(spark, tmp_path):
    import corpus_pipeline
    from leafaudit.llm.jobs import op2_line_dedup

    rows = [(1, "one\nall rights kept here", 24), (2, "all rights kept here\ntwo", 24), (3, "all rights kept here", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, r.n_removed) for r in op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("two", 1), 3: ("", 1)}
    assert sorted(map(tuple, corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect())) == [rows[0], (2, "two", 3)]


def test_runs_come_from_the_deepest_intervals(spark):
    rnd = random.Random(8)
    pool = [f"line {i}" for i in range(9)] + ["", " "]
    docs = [(i, [rnd.choice(pool) for _ in range(rnd.randrange(30))]) for i in range(40)]
    docs += [(50, [f"own {i}" for i in range(70)]), (51, ["new"] + [f"own {i}" for i in range(70)]), (52, ["z"] * 21), (53, [f"own {i}" for i in range(9, 30)])]
    seq = [(d, i, x.strip()) for d, ls in docs for i, x in enumerate(ls) if x.strip()]
    best = []
    for p in range(len(seq)):
        n = 0
        for q in range(p):
            k = 0
            while p + k < len(seq) and seq[p + k][0] == seq[p][0] and seq[q + k][0] == seq[q][0] and seq[p + k][2] == seq[q + k][2]:
                k += 1
            n = max(n, k)
        best.append(n)
    want, p = [], 0
    while p < len(seq):
        if best[p]:
            end, most, at = p + best[p], best[p], p
            while at < len(seq) and seq[at][0] == seq[p][0] and at <= end and best[at]:
                end, most, at = max(end, at + best[at]), max(most, best[at]), at + 1
            want.append((seq[p][0], seq[p][1], seq[at - 1][1], 1 << (most.bit_length() - 1)))
            p = at
        else:
            p += 1
    table = spark.createDataFrame([(d, "\n".join(ls)) for d, ls in docs], "doc_id long, text string").repartition(3)
    got = repeated_runs(table)
    assert sorted(tuple(r) for r in got.select("doc_id", "first", "last", "depth").collect()) == sorted(want)
    assert {64, 16} <= {r.depth for r in got.collect()}


def test_a_line_of_a_third_of_all_rows(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common\n"), F.col("id"), F.lit("\nmore "), F.col("id")).alias("text")).repartition(3)
    out = drop_repeated_lines(rows)
    assert out.agg(F.sum("n_removed")).first()[0] == 3999 and out.filter("text like 'common%'").count() == 1
