"""Exact top-k search by term-at-a-time accumulation.

Queries and candidates are dealt into blocks; a task gets one block of queries and one of
candidates. For each term (component) the candidates' posting column is scattered,
weighted by each query that has the term, into a dense array of scores, query by
candidate. Partition selection takes the best of the block, and the blocks' bests meet
in one ranking per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERIES_AT_ONCE = 64


def dense(column: pa.Array, terms: int | None = None) -> np.ndarray:
    """Rows of a list column as an array, short rows filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(terms or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def best_of_block(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores; among equal scores the first columns."""
    if len(scores) <= k:
        return np.arange(len(scores))
    floor = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > floor)
    return np.r_[above, np.flatnonzero(scores == floor)[: k - len(above)]]


def accumulate(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores of queries (rows) against candidates, term by term; postings: terms by candidates."""
    scores = np.zeros((len(queries), postings.shape[1]), np.int64)
    for term, column in enumerate(postings):
        weights = queries[:, term]
        rows = np.flatnonzero(weights)
        if len(rows) and column.any():
            scores[rows] += weights[rows, None] * column
    return scores


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, block_rows: int = 16_384, query_rows: int = 8_192, vec_id: str = "vec_id", components: str = "components") -> DataFrame:
    """The k rows of highest integer inner product for each query row.

    vectors: an id and an array of bigint components (rows with a null array or a null
    component take no part; a shorter array counts as filled with zeros). Every row but
    those with the query's id is a candidate; ties go to the smaller id, null ids last.
    Repeated candidate rows count each; equal query rows are answered once. Returns
    (query_id, rank, vec_id, score); sums wrap at 64 bits. Blocks have a fixed mean size,
    so the number of tasks grows with the data and a task's memory doesn't; no block is
    sent through the driver."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(components).alias("v"), is_query.alias("asks"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    total, asked = rows.select(F.count("*"), F.count_if("asks")).first()
    blocks, sides = -(-max(total, 1) // block_rows), -(-max(asked, 1) // query_rows)
    spread = F.xxhash64("vec_id", "v")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "v", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), every(sides).alias("side"))
    queries = rows.filter("asks").select("vec_id", "v").distinct()
    queries = queries.select("vec_id", "v", F.pmod(spread, F.lit(sides)).cast("int").alias("side"), every(blocks).alias("block"))

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            right = right.take(pa.compute.sort_indices(right, sort_keys=[("vec_id", "ascending")], null_placement="at_end"))
            ids = right.column("vec_id").to_pylist()
            known = np.array([x is not None for x in ids])
            numbers = np.array([x if x is not None else 0 for x in ids], np.int64)
            q = dense(left.column("v"))
            postings = dense(right.column("v"), q.shape[1])
            q = dense(left.column("v"), postings.shape[1])
            postings = np.ascontiguousarray(postings.T)
            asks = left.column("vec_id").to_pylist()
            same = [hash_of for hash_of in left.column("v_hash").to_pylist()]
            for at in range(0, len(q), QUERIES_AT_ONCE):
                with np.errstate(over="ignore"):
                    scores = accumulate(q[at : at + QUERIES_AT_ONCE], postings)
                for i, line in enumerate(scores):
                    ask = asks[at + i]
                    others = np.flatnonzero((numbers != ask) | ~known) if ask is not None else np.flatnonzero(known)
                    picked = others[best_of_block(line[others], k)]
                    out += [(ask, same[at + i], ids[j], int(line[j])) for j in picked.tolist()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "v_hash", "vec_id", "score"])

    queries = queries.withColumn("v_hash", F.xxhash64("v"))
    pairs = queries.groupBy("block", "side").cogroup(candidates.groupBy("block", "side"))
    found = pairs.applyInArrow(score, "query_id long, v_hash long, vec_id long, score long")
    order = Window.partitionBy("query_id", "v_hash").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def integer_components(embedding: str = "embedding", scale: float = 1024.0) -> Column:
    """floor(scale * x) of each component; null if the array or one of its components is
    null, not a number or infinite."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long")))
