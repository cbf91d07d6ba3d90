import random

from pyspark.sql import functions as F

from leafaudit.llm import near
from leafaudit.llm.near import near_components


def components(rows, width, num, den):
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d is None, d or 0, len(sets[i]), (least.get(find(i)) if sets[i] else d) or 0) for i, (d, _) in enumerate(rows))


def make_rows(seed):
    rnd = random.Random(seed)
    word = lambda: "w%d" % rnd.randrange(400)
    base = [[word() for _ in range(n)] for n in (60, 61, 25, 12, 9, 30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(140):
        b = list(base[0] if i % 3 else rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(b))
            b[at : at + rnd.randrange(2)] = [word()]
        rows.append((100 + i, " ".join(b).replace("w1", "W1") + " \n"))
    passage = " ".join(word() for _ in range(20))
    rows += [(300 + i, passage + " " + " ".join(word() for _ in range(rnd.randrange(1, 40)))) for i in range(40)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one two"), (404, "ONE\ttwo"), (405, "one"), (403, "one two"), (None, "one two"), (None, " ".join(base[2]))]
    return rows


def test_components_match_brute_force(spark):
    for width, num, den, most in ((3, 9, 10, 2), (5, 8, 10, 3), (3, 8, 10, 16)):
        rows = make_rows(width + den + most)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(3)
        got = near_components(docs, width=width, num=num, den=den, most=most).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == components(rows, width, num, den)


def test_empty_table(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_shared_passage_compares_no_unrelated_documents(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} " + " ".join(f"d{i}w{j}" for j in range(90))) for i in range(80)]
    rows += [(100 + i, t + " more") for i, t in rows[:3]]
    seen, kept = {}, near.stored

    def counted(df, label):
        out = kept(df, label)
        seen[label] = max(seen.get(label, 0), out.count())
        return out

    monkeypatch.setattr(near, "stored", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near.near_components(docs, width=5, num=8, den=10).collect()
    assert sorted((False, r.doc_id, r.n_shingles, r.component_id) for r in got) == components(rows, 5, 8, 10)
    assert seen["near-pairs"] < 10 and seen["near-stars"] == 0
