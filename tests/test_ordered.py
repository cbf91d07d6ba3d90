"""Ordered helpers against brute force, with one group holding most of the rows."""

import random

from conftest import rows
from pyspark.sql import functions as F

from leafaudit.operators import ordered, state

K = ["book", "page"]


def log(seed, n=400):
    rng = random.Random(seed)
    out, seq = [], 0
    for _ in range(n):
        seq += rng.choice([1, 1, 2, 50])
        hot = rng.random() < 0.7
        chunk = rng.choice(["text a", "text b", "✓ write: x", "▶ read", "[note]", "long " * 30, "  "])
        out.append(("hot" if hot else rng.choice("abc"), 1 if hot else rng.randint(1, 3), seq, chunk))
    rng.shuffle(out)
    return out


def groups(data):
    found = {}
    for b, p, seq, chunk in sorted(data, key=lambda r: r[2]):
        found.setdefault((b, p), []).append((seq, chunk))
    return found


def frame(spark, data):
    return spark.createDataFrame(data, "book string, page long, seq long, chunk string")


def test_columns_over_buckets_equal_a_plain_pass(spark):
    for seed, width in ((1, 7), (2, 64), (3, 100000)):
        data = log(seed)
        df = frame(spark, data).withColumn("one", F.lit(1)).withColumn("note", F.when(F.col("chunk").startswith("text"), F.col("chunk")))
        got = ordered.ordered_columns(
            df, K, ["seq"], ordered.by_width("seq", width), rank="rk", lags={"prev": "chunk"}, leads={"nxt": "chunk"},
            sums={"total": "one"}, lasts={"seen": "note"},
        )
        want = []
        for (b, p), items in groups(data).items():
            seen = None
            for i, (seq, chunk) in enumerate(items):
                seen = chunk if chunk.startswith("text") else seen
                prev = items[i - 1][1] if i else None
                nxt = items[i + 1][1] if i + 1 < len(items) else None
                want.append((b, p, seq, i + 1, prev, nxt, i + 1, seen))
        picked = rows(got, "book", "page", "seq", "rk", "prev", "nxt", "total", "seen")
        assert picked == sorted(want, key=lambda r: tuple((v is None, v) for v in r))


def test_islands_merge_across_bucket_borders(spark):
    rng = random.Random(5)
    data = {("hot", p) for p in range(0, 300) if rng.random() < 0.8} | {("b", p) for p in (0, 7, 8, 15, 16, 17, 40)} | {("c", p) for p in range(64)}
    df = spark.createDataFrame(list(data) * 2, "book string, page long")
    want = []
    for b in {b for b, _ in data}:
        ps = sorted(p for x, p in data if x == b)
        start = prev = ps[0]
        for p in ps[1:] + [10**9]:
            if p != prev + 1:
                want.append((b, start, prev, prev - start + 1))
                start = p
            prev = p
    for width in (4, 8, 1024):
        assert rows(ordered.islands(df, ["book"], "page", width=width), "book", "first", "last", "n") == sorted(want)


def test_log_jobs_on_a_hot_page(spark, monkeypatch):
    monkeypatch.setattr(state, "by_width", lambda c: F.floor(F.col(c) / 16))
    data = log(9)
    df = frame(spark, data)
    kept, acts, tools = [], [], []
    for (b, p), items in groups(data).items():
        last, frags, n, label = None, [], 0, None
        for seq, chunk in items:
            if chunk != last:
                kept.append((b, p, seq))
            last = chunk
            text = chunk.strip()
            if text.startswith("✓ "):
                n, label = n + 1, text[2:].strip()
            tools.append((b, p, seq, n, label))
            if text and not text.startswith(("[", "▶ ", "✓ ")):
                frags = (frags + [text[:100]])[-4:]
                joined = " … ".join(frags)
                acts.append((b, p, seq, "…" + joined[-199:] if len(joined) > 200 else joined))
    assert rows(state.collapse_repeats(df), "book", "page", "seq") == sorted(kept)
    key = lambda r: tuple((v is None, v) for v in r)
    assert rows(state.running_tool_count(df), "book", "page", "seq", "tool_calls", "last_tool") == sorted(tools, key=key)
    assert rows(state.rolling_activity(df), "book", "page", "seq", "activity") == sorted(acts)


def test_trailing_window_over_block_borders(spark):
    df = spark.range(1, 41).select(F.lit("k").alias("k"), F.col("id").alias("r"))
    got = ordered.trailing_window(
        df, ["k"], "r", 4, lambda d, w: d.withColumn("l", F.array_join(F.collect_list(F.col("r").cast("string")).over(w), ",")), block=5
    )
    assert rows(got, "r", "l") == [(r, ",".join(map(str, range(max(1, r - 3), r + 1)))) for r in range(1, 41)]


def test_retention_and_tail(spark):
    data = [("hot", 1, i, f"l{i}") for i in range(100)] + [("a", 1, i, "x") for i in range(5)]
    df = frame(spark, data).withColumn("ts", F.timestamp_seconds(F.floor(F.col("seq") / 3)))
    stale = state.retain_latest(df, K, ["ts", "seq"], keep=20)
    assert rows(stale, "book", "seq") == [("hot", i) for i in range(80)]
    tail = rows(state.log_tail(df, 7), "book", "line_no", "seq")
    assert tail == [("a", i + 1, i) for i in range(5)] + [("hot", i + 1, 93 + i) for i in range(7)]


def test_next_batch_and_pending(spark):
    books = spark.createDataFrame([("b", 4, ["en", "vi"]), ("z", 0, ["en"])], "book string, page_count long, languages array<string>")
    source = spark.createDataFrame([("b", p) for p in (1, 2, 3, 9)], "book string, page long")
    valid = spark.createDataFrame([("b", 1, "en"), ("b", 1, "vi"), ("b", 2, "en")], "book string, page long, lang string")
    pending = state.pending_pages(books, source, valid)
    assert rows(pending) == [("b", 2, "vi"), ("b", 3, "en,vi")]
    assert rows(state.next_batch(pending, 1)) == [("b", 2)]
