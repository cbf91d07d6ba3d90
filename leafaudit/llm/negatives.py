"""Hard-negative mining with an angular triangle filter.

For each row the angles to a few reference directions are stored. For an anchor a and a
candidate c with angles x and y to one direction, the angle between them lies within
|x - y| and x + y, so that cos(x + y) <= cos(a, c) <= cos(x - y). Times both norms, and
widened for rounding, that bounds the integer score before it is computed. The narrowest
interval over all directions decides: only candidates whose interval meets a window of
scores that the anchor looks for are scored exactly.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafaudit.llm.common import stored
from leafaudit.llm.search import best_of_block, dense, integer_components

ANCHORS_AT_ONCE, COLUMNS_AT_ONCE = 64, 16_384
#: Cells of candidates that may hold an anchor's label; a cell holds whole labels.
LABEL_CELLS = 16
#: Scores below this are exact in floating point, however they are summed.
EXACT = 2.0**52
#: Part of the product of the norms by which a bound may be off (cosines of rounded angles
#: near 0 or a half turn err by about 1e-8).
SLACK = 1e-6


def reference_directions(rows: DataFrame, count: int) -> np.ndarray:
    """Mean vectors of the labels with most rows, at most `count` (one row each)."""
    common = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(count).select("label")
    parts = rows.join(F.broadcast(common), "label").select("label", F.posexplode("v").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.sum(F.col("x").cast("double")).alias("x")).toArrow()
    if not means.num_rows:
        return np.zeros((0, 0))
    labels, which = np.unique(means.column("label").to_numpy(), return_inverse=True)
    at = means.column("at").to_numpy()
    out = np.zeros((len(labels), at.max() + 1))
    out[which, at] = means.column("x").to_numpy()
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norms > 0, norms, 1))[norms[:, 0] > 0]


def angles_to(vectors: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of vectors, and their angles to each direction (a quarter turn for zero vectors)."""
    width = max(vectors.shape[1], directions.shape[1])
    wide = [np.pad(m.astype(np.float64), ((0, 0), (0, width - m.shape[1]))) for m in (vectors, directions)]
    norms = np.linalg.norm(wide[0], axis=1)
    cosines = wide[0] @ wide[1].T / np.where(norms > 0, norms, 1)[:, None]
    return norms, np.arccos(np.clip(cosines, -1, 1))


class Side:
    """Anchors or candidates of a cell: ids, labels, vectors, norms and angles."""

    def __init__(self, table: pa.Table):
        ids = table.column("vec_id").to_pylist()
        self.known = np.array([i is not None for i in ids], bool)
        self.ids = np.array([i if i is not None else 0 for i in ids], np.int64)
        self.labels = table.column("label").to_numpy()
        self.vectors = dense(table.column("v"))
        self.norms = table.column("norm").to_numpy()
        angles = table.column("angles").combine_chunks().flatten().to_numpy()
        angles = angles.reshape(len(ids), -1)
        self.cos, self.sin = np.cos(angles), np.sin(angles)


def score_bounds(a: Side, rows: slice, c: Side, columns: slice) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each anchor with each candidate, safe against rounding."""
    low, high = -1.0, 1.0
    for k in range(a.cos.shape[1]):
        even = np.multiply.outer(a.cos[rows, k], c.cos[columns, k])
        odd = np.multiply.outer(a.sin[rows, k], c.sin[columns, k])
        low, high = np.maximum(low, even - odd), np.minimum(high, even + odd)
    norms = np.multiply.outer(a.norms[rows], c.norms[columns])
    low, high = (low - SLACK) * norms - 1, (high + SLACK) * norms + 1
    wraps = norms >= 2.0**62  # such sums may leave 64 bits: no bound holds
    return np.where(wraps, -np.inf, low), np.where(wraps, np.inf, high)


def exact_scores(a: Side, rows: slice, c: Side, at: np.ndarray) -> np.ndarray:
    width = max(a.vectors.shape[1], c.vectors.shape[1])
    left, right = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a.vectors[rows], c.vectors[at]))
    if a.norms[rows].max(initial=0) * c.norms[at].max(initial=0) < EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return left @ right.T


def cuts(n: int, size: int) -> list[slice]:
    return [slice(i, min(i + size, n)) for i in range(0, n, size)]


def in_order(table: pa.Table) -> pa.Table:
    """By id, unknown ids last, so that among equal scores the first is the one wanted."""
    return table.take(pc.sort_indices(table, sort_keys=[("vec_id", "ascending")], null_placement="at_end"))


class Best:
    """The best candidates of a cell for each key (anchor, and place of its positive)."""

    def __init__(self, k: int):
        self.k, self.held, self.out = k, {}, [array("q") for _ in range(4)]

    def offer(self, key: tuple[int, int], scores: np.ndarray, at: np.ndarray) -> None:
        picked = best_of_block(scores, self.k)
        if len(picked):
            self.held.setdefault(key, []).append((scores[picked], at[picked]))

    def settle(self) -> None:
        """Keep k of what was offered for each key; candidates come in order of their ids."""
        for key, parts in self.held.items():
            scores, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            picked = best_of_block(scores, self.k)
            for column, values in zip(self.out, ([key[0]] * len(picked), [key[1]] * len(picked), at[picked].tolist(), scores[picked].tolist()), strict=True):
                column.extend(values)
        self.held = {}

    def table(self, ids: pa.ChunkedArray) -> pa.Table:
        anchor, positive, at, score = (np.frombuffer(c, np.int64) if len(c) else np.zeros(0, np.int64) for c in self.out)
        return pa.table([pa.array(anchor), pa.array(positive), ids.take(pa.array(at)), pa.array(score)], names=RESULT_NAMES)


RESULT_NAMES = ["anchor", "positive", "vec_id", "score"]
RESULT = "anchor long, positive long, vec_id long, score long"


def nearest_positives(positives: int):
    """Function over (key, anchors, candidates) of a cell: the best rows of the anchor's label."""

    def search(key, anchors: pa.Table, table: pa.Table) -> pa.Table:
        best, table = Best(positives), in_order(table)
        if anchors.num_rows and table.num_rows:
            a, c, keys = Side(anchors), Side(table), anchors.column("anchor").to_pylist()
            for rows in cuts(len(a.ids), ANCHORS_AT_ONCE):
                for columns in cuts(len(c.ids), COLUMNS_AT_ONCE):
                    own = (a.labels[rows, None] == c.labels[None, columns]) & ((a.ids[rows, None] != c.ids[None, columns]) | ~c.known[None, columns])
                    low, high = score_bounds(a, rows, c, columns)
                    low[~own] = -np.inf
                    if (spare := low.shape[1] - positives) > 0:
                        own &= high >= np.partition(low, spare, axis=1)[:, spare, None]
                    at = np.flatnonzero(own.any(axis=0)) + columns.start
                    scores = exact_scores(a, rows, c, at)
                    for i, line in enumerate(scores):
                        mine = own[i, at - columns.start]
                        best.offer((keys[rows.start + i], 0), line[mine], at[mine])
                best.settle()
        return best.table(table.column("vec_id"))

    return search


def windowed_negatives(negatives: int, percent: int):
    """Function over (key, anchors, candidates) of a cell: for each positive the best rows
    of other labels within its window of scores."""

    def search(key, anchors: pa.Table, table: pa.Table) -> pa.Table:
        best, table = Best(negatives), in_order(table)
        if anchors.num_rows and table.num_rows:
            a, c, keys = Side(anchors), Side(table), anchors.column("anchor").to_pylist()
            windows = [[(-(-percent * s["score"] // 100), s["score"]) for s in own] for own in anchors.column("found").to_pylist()]
            for rows in cuts(len(a.ids), ANCHORS_AT_ONCE):
                for columns in cuts(len(c.ids), COLUMNS_AT_ONCE):
                    other = (a.labels[rows, None] != c.labels[None, columns]) & ((a.ids[rows, None] != c.ids[None, columns]) | ~c.known[None, columns])
                    low, high = score_bounds(a, rows, c, columns)
                    for i in range(len(low)):
                        meets = np.zeros(low.shape[1], bool)
                        for least, most in windows[rows.start + i]:
                            if least <= most:
                                meets |= (high[i] >= least) & (low[i] <= most)
                        other[i] &= meets
                    at = np.flatnonzero(other.any(axis=0)) + columns.start
                    scores = exact_scores(a, rows, c, at)
                    for i, line in enumerate(scores):
                        mine = other[i, at - columns.start]
                        for n, (least, most) in enumerate(windows[rows.start + i]):
                            fits = mine & (line >= least) & (line <= most)
                            best.offer((keys[rows.start + i], n), line[fits], at[fits])
                best.settle()
        return best.table(table.column("vec_id"))

    return search


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    directions: int = 8,
    block_rows: int = 131_072,
    anchor_rows: int = 65_536,
    vec_id: str = "vec_id",
    label: str = "label",
    components: str = "components",
) -> DataFrame:
    """The hard negatives of each anchor and positive: (anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score).

    A score is the integer inner product with the anchor (shorter arrays count as filled
    with zeros, sums wrap at 64 bits). An anchor's positives are its `positives` highest
    rows of equal label; negatives of a positive are the `negatives` highest rows of
    another label that score from `percent` hundredths of the positive's score up to it.
    Ties go to the smaller id, null ids last. An anchor's own id is never a candidate, nor
    is a row with a null label, array or component. A positive without a negative in its
    window, and an anchor without positives, give no row. Equal anchor rows are answered
    once; other repeated rows count each. Other columns are ignored; an empty table gives
    no rows.

    Blocks hold at most block_rows candidates and anchor_rows anchors on average (fewer of
    wide vectors), so memory doesn't grow with the table; no block passes the driver."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(components).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    base = reference_directions(rows, directions)

    def add_angles(batches):
        for batch in batches:
            norms, angles = angles_to(dense(pa.chunked_array([batch.column(2)])), base)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel()), max(angles.shape[1], 1)) if angles.shape[1] else pa.array([[]] * len(norms), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms), lists.cast(pa.list_(pa.float64()))], [*batch.schema.names, "norm", "angles"])

    table = rows.mapInArrow(add_angles, "vec_id long, label long, v array<long>, asks boolean, norm double, angles array<double>")
    table = stored(table.withColumn("salt", F.monotonically_increasing_id()), "negatives-angles")
    total, asked, width = table.select(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    tasks = max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wide = -(-max(width or 1, 1) // 64)
    blocks = max(1, -(-total * wide // block_rows), min(tasks, total // 4096))
    sides = max(1, -(-asked * wide // anchor_rows))
    deal = F.pmod(F.xxhash64("salt"), F.lit(blocks)).cast("int")
    kind = F.pmod(F.xxhash64("label"), F.lit(LABEL_CELLS)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = table.filter("asks").select("vec_id", "label", "v", "norm", "angles").dropDuplicates(["vec_id", "label", "v"])
    anchors = stored(anchors.withColumn("anchor", F.monotonically_increasing_id()).withColumn("side", F.pmod(F.xxhash64("anchor"), F.lit(sides)).cast("int")), "negatives-anchors")
    data = ["vec_id", "label", "v", "norm", "angles"]

    def in_cells(asking: DataFrame, cell: Column) -> tuple:
        keys = ["cell", "block", "side"]
        left = asking.withColumn("cell", cell).withColumn("block", each(blocks))
        right = table.select(*data, cell.alias("cell"), deal.alias("block"), each(sides).alias("side"))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys))

    close = in_cells(anchors, kind).applyInArrow(nearest_positives(positives), RESULT)
    by_score = [F.desc("score"), F.asc_nulls_last("vec_id")]
    close = close.withColumn("at", F.row_number().over(Window.partitionBy("anchor").orderBy(*by_score))).filter(F.col("at") <= positives)
    lists = close.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found"))
    asking = stored(anchors.join(lists, "anchor"), "negatives-positives")

    hard = in_cells(asking, F.lit(0)).applyInArrow(windowed_negatives(negatives, percent), RESULT)
    order = Window.partitionBy("anchor", "positive").orderBy(*by_score)
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = asking.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("found").alias("positive", "p"))
    out = hard.withColumn("positive", F.col("positive").cast("int")).join(named, ["anchor", "positive"])
    return out.select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score")
    )


def mining_rows(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label and integer components of rows with whole vectors."""
    return embeddings.select("vec_id", "label", integer_components(scale=scale).alias("components"))
