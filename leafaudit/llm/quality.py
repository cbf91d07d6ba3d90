"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Every word has an index vector (a few signed ones at places its hash names). A word's
context vector is the sum of the index vectors of its neighbours over the training
texts. A document is the mean of its words' index and context vectors and of the index
vectors of their forms (which kinds of characters, in which order), with its length and
its share of new words. A two-layer numpy network is trained on the driver on a bounded
sample of labelled rows, and its temperature is fitted on rows it wasn't trained on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafaudit.llm.common import each_batch, fresh, text_or_empty

WIDTH = 32
FORM_WIDTH = 16
ONES = 4
REACH = 2
CACHE_WORDS = 120_000
#: Kinds of characters for forms: a run of one kind leaves one letter, two or more a doubled one.
KINDS = [(re.compile(r"[^\W\d_]+"), lambda m: kind(m[0])), (re.compile(r"\d+"), lambda m: "9")]
RUNS = re.compile(r"([^\w])\1+")


def kind(letters: str) -> str:
    name = "L" if letters.islower() else "U" if letters.isupper() else "C"
    return name + "+" if len(letters) > 24 else name


def form(word: str) -> str:
    """Kinds of a word's characters. Words of letters, with or without one mark after
    them, are most of a text and need no pattern."""
    if word.isalpha():
        return kind(word)
    if word[:-1].isalpha() and not word[-1:].isalnum():
        return kind(word[:-1]) + word[-1]
    for pattern, name in KINDS:
        word = pattern.sub(name, word)
    return RUNS.sub(r"\1\1", word)[:12]


def index_vectors(words: list[str], width: int, seed: int) -> np.ndarray:
    """Sparse signed index vectors, the same on every worker."""
    out = np.zeros((len(words), width), np.float32)
    h = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words], np.uint64)
    rows = np.arange(len(words))
    for i in range(ONES):
        part = (h >> np.uint64(16 * i)) & np.uint64(0xFFFF)
        sign = np.where(part & np.uint64(1), 1.0, -1.0).astype(np.float32)
        out[rows, ((part >> np.uint64(1)) % np.uint64(width)).astype(np.int64)] += sign
    return out


@dataclass
class WordTable:
    """Rows of word vectors, made as words are met; bounded, and cleared when full."""

    contexts: dict[str, np.ndarray]
    rows: dict[str, int] = field(default_factory=dict)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 2 * WIDTH + FORM_WIDTH), np.float32))
    used: int = 0

    def add(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.rows]
        if self.used + len(new) > CACHE_WORDS:
            self.rows.clear()
            self.used, new = 0, list(words)
        if not new:
            return
        made = np.zeros((len(new), 2 * WIDTH + FORM_WIDTH), np.float32)
        made[:, :WIDTH] = index_vectors(new, WIDTH, 1)
        at = dict(zip(new, range(len(new)), strict=True))
        for w in self.contexts.keys() & at.keys():
            made[at[w], WIDTH : 2 * WIDTH] = self.contexts[w]
        numbers: dict[str, int] = {}
        which = [numbers.setdefault(f, len(numbers)) for f in map(form, new)]
        made[:, 2 * WIDTH :] = index_vectors(list(numbers), FORM_WIDTH, 2)[which]
        if self.used + len(new) > len(self.vectors):
            grown = np.zeros((max(2 * len(self.vectors), self.used + len(new)), made.shape[1]), np.float32)
            grown[: self.used] = self.vectors[: self.used]
            self.vectors = grown
        self.vectors[self.used : self.used + len(new)] = made
        self.rows.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def pooled(self, texts: list[str]) -> np.ndarray:
        """One row per text; a text without words is a row of zeros."""
        width = 2 * WIDTH + FORM_WIDTH
        out = np.zeros((len(texts), width + 3), np.float32)
        words = [t.split() for t in texts]
        sets = [set(w) for w in words]
        self.add(set().union(*sets))
        get = self.rows.__getitem__
        for i, (w, own) in enumerate(zip(words, sets, strict=True)):
            if w:
                for at in range(0, len(w), 8192):
                    out[i, :width] += self.vectors.take(list(map(get, w[at : at + 8192])), axis=0).sum(axis=0)
                out[i, :width] /= len(w)
                out[i, width:] = np.log1p(len(w)) / 5, len(own) / len(w), len(texts[i]) / len(w) / 10
        return out


def context_sums(texts: DataFrame, *, least: int) -> dict[str, np.ndarray]:
    """Context vectors of all words met least times or more in a DataFrame with one text column.
    Every word of every batch is counted, and least holds for the counts over all
    batches, so neither their cut nor the partitions change the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 512):
            words = [t.split() for t in batch.column(0).to_pylist()]
            rows = {w: i for i, w in enumerate(sorted(set().union(*words)))}
            base = index_vectors(list(rows), WIDTH, 1)
            sums, count = np.zeros_like(base), np.zeros(len(rows), np.int64)
            for ws in words:
                ids = np.fromiter(map(rows.__getitem__, ws), np.int64, len(ws))
                np.add.at(count, ids, 1)
                for d in range(1, min(REACH, len(ids) - 1) + 1):
                    np.add.at(sums, ids[d:], base[ids[:-d]])
                    np.add.at(sums, ids[:-d], base[ids[d:]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.string()), pa.array(count), pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), WIDTH).cast(pa.list_(pa.float32()))],
                ["word", "n", "v"],
            )

    parts = texts.mapInArrow(run, "word string, n long, v array<float>")
    total = parts.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(WIDTH)])
    met = total.filter(F.col("n") >= least).select("word", *[F.col(f"v{i}").cast("float") for i in range(WIDTH)]).toArrow()
    vectors = np.stack([c.to_numpy() for c in met.columns[1:]], axis=1)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return dict(zip(met.column(0).to_pylist(), vectors / np.where(norms > 0, norms, 1) * 2, strict=True))


@dataclass
class Network:
    """Two layers over standardised inputs; a score is the probability of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64) / self.temperature, -30, 30)))

    @staticmethod
    def constant(width: int, share: float) -> Network:
        zero = np.zeros(width, np.float32)
        odds = np.log((share + 1e-6) / (1 - share + 1e-6))
        return Network(zero, zero + 1, np.zeros((width, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), float(odds))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, *, hidden: int = 24, epochs: int = 40, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> Network:
        if not len(y) or y.min() == y.max():
            return Network.constant(x.shape[1], float(y.mean()) if len(y) else 0.5)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        if len(y) < 20 or y[used].min() == y[used].max():
            held, used = order[:0], order  # too few to hold any back
        mean, scale = x[used].mean(0), x[used].std(0) + 1e-3
        p = {"w1": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, hidden**-0.5, hidden), "b2": np.zeros(1)}
        m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        z = (x - mean) / scale
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
                h = np.tanh(z[rows] @ p["w1"] + p["b1"])
                d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - y[rows]) / len(rows)
                back = np.outer(d, p["w2"]) * (1 - h * h)
                g = {"w1": z[rows].T @ back + decay * p["w1"], "b1": back.sum(0), "w2": h.T @ d + decay * p["w2"], "b2": d.sum(keepdims=True)}
                t += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        out = Network(mean.astype(np.float32), scale.astype(np.float32), p["w1"].astype(np.float32), p["b1"].astype(np.float32), p["w2"].astype(np.float32), float(p["b2"][0]))
        if not len(held):
            return out
        margin = out.margin(x[held]).astype(np.float64)
        loss = lambda temp: np.logaddexp(0, np.where(y[held] > 0, -1, 1) * margin / temp).mean()
        out.temperature = float(min(np.geomspace(0.5, 8, 41), key=loss))
        return out


def score_quality(docs: DataFrame, labels: DataFrame, may_train: Column | None = None, *, sample_rows: int = 16_000, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Score every whole text: all columns of docs, with score and predicted after them.

    labels has doc_id and a 0/1 label; may_train (a condition on its doc_id) picks the rows
    to learn from. At most sample_rows of them are used, those of least hashed id; the driver
    holds their features and the context vectors of all words they hold four times or more.
    Other words have index and form vectors only.
    Only the text is an input of a score. A null or empty text is scored like one without
    words. Labels that are null, or whose document is absent, are left out; if a document
    has several, the least counts. Without labels of both kinds every score is the share
    of label 1 (a half if there is none); of fewer than 20 all train, and the temperature
    stays 1. Rows may repeat, and ids may be null. New columns
    replace input columns of the same name."""
    own_id, own_label = fresh("id", "label")
    usable = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    usable = usable if may_train is None else usable.filter(may_train)
    picked = usable.groupBy(F.col(doc_id).alias(own_id)).agg(F.min(F.col(label).cast("int")).alias(own_label))
    picked = picked.orderBy(F.xxhash64(own_id), own_id).limit(sample_rows)
    given = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("_text"))
    taught = given.join(F.broadcast(picked), F.col("_id") == F.col(own_id)).select("_id", F.col(own_label).alias("_y"), "_text")
    contexts = context_sums(taught.select("_text"), least=4)
    table = docs.sparkSession.sparkContext.broadcast(contexts)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(table.value)
        for batch in each_batch(batches, 256):
            x = words.pooled(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["_id", "_y", "x"])

    rows = taught.mapInArrow(features, "_id long, _y int, x binary").groupBy("_id").agg(F.min("_y").alias("y"), F.min("x").alias("x")).orderBy("_id").collect()
    width = 2 * WIDTH + FORM_WIDTH + 3
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(-1, width)
    network = Network.fit(x, np.array([r.y for r in rows], np.float64))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(table.value)
        for batch in each_batch(batches, 256):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            p = network.score(words.pooled(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    base = docs.drop("score", "predicted")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(scores, f"{kinds}, score double, predicted int")
