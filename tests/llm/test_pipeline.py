import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _before string, _id long, _y long, score double, TEXT string, n_removed string"
EXTRA = ("password = hunter22", 7, 8, -5.0, "own", "mine")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t), *EXTRA) for i, t in rows], SCHEMA)


def test_stages_leave_other_columns_alone(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, [(1, "head\npassword = hunter22"), (2, "head\n" + long), (3, None), (4, ""), (5, long + " tail")])
    masked = corpus_pipeline.secret_scans(spark, docs, "")
    assert masked.columns == docs.columns
    got = {r.doc_id: r for r in masked.collect()}
    assert got[1].text == "head\n[SECRET]" and got[1].n_chars == len(got[1].text) and got[2].text == "head\n" + long and got[3].text is None
    assert all(tuple(r)[5:] == EXTRA for r in got.values())
    lines = corpus_pipeline.line_dedup(spark, docs, "")
    found = {r.doc_id: r for r in lines.collect()}
    assert found[2].text == long and found[1].text.startswith("head\n") and set(found) == {1, 2, 3, 4, 5} and all(tuple(r)[5:] == EXTRA for r in found.values())
    kept = corpus_pipeline.near_duplicates(spark, lines, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4] and kept.columns == docs.columns
    packed = corpus_pipeline.pack(spark, docs.filter(F.col("doc_id") < 3), "")
    assert {r.doc_id for r in packed.collect()} == {1, 2}


def test_scoring_bears_columns_of_its_own_names(spark):
    from leafaudit.llm import quality

    docs = documents(spark, [(i, f"good words here {i}" if i % 2 else "xx yy zz", ) for i in range(12)])
    docs = docs.toDF(*["other" if c == "TEXT" else c for c in docs.columns])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels)
    assert out.count() == 12 and {"_id", "_y", "score", "predicted"} <= set(out.columns)
