"""Merkle manifest of a dataset, with an inclusion proof for every row.

Rows are leaves; per group they are ordered, and runs of FANOUT consecutive nodes hash to
their parent, level by level, until one node is left (the subroot). The subroots, ordered
by group, make the upper tree. On each level fixed-offset lag and lead columns, masked by
a node's slot and its run's length, give its siblings, and the first node of a run hashes
itself and what follows to the parent. Windows span blocks of whole runs, never a group,
so a group that holds most rows is spread over the cluster like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafaudit.llm.common import stored

FANOUT = 8
#: Nodes of one window: a whole number of runs.
BLOCK = FANOUT**4
STEP = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value (numbers in decimal)."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def lower_ascii(text: str | Column) -> Column:
    """A-Z as a-z, all other characters as they are."""
    text = F.col(text) if isinstance(text, str) else text
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def positioned(rows: DataFrame, order: Sequence[str], label: str) -> tuple[DataFrame, int]:
    """Rows of (g, ...) with p, their place in g along `order` from 0, and n, the rows of g;
    and the largest n. Equal rows get places of their own.

    The rows are dealt by ranges of (g, order) and sorted within them; only one count for
    each group of a range is summed along the group."""
    (salt, at, part) = "_salt", "_at", "_part"
    rows = stored(rows.withColumn(salt, F.monotonically_increasing_id()), f"{label}-rows")
    keys = ["g", *order, salt]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(salt)
    dealt = stored(dealt.withColumns({at: F.monotonically_increasing_id(), part: F.spark_partition_id()}), f"{label}-ordered")
    along = Window.partitionBy("g").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("g", part).agg(F.min(at).alias("_first"), F.count("*").alias("_rows"))
    counts = stored(
        counts.select("g", part, "_first", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy("g")).alias("n")), f"{label}-counts"
    )
    most = counts.agg(F.max("n")).first()[0] or 0
    placed = dealt.join(counts, ["g", part]).withColumn("p", F.col(at) - F.col("_first") + F.col("_before"))
    return placed.drop(at, part, "_first", "_before"), most


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (g, p, n, digest, ...) with the digests before (left) and after (right) them in their run."""
    slot = F.col("p") % FANOUT
    length = F.least(F.lit(FANOUT), F.col("n") - F.col("p") + slot)
    w = Window.partitionBy("g", F.floor(F.col("p") / BLOCK)).orderBy("p")
    before = [F.when(slot >= k, F.lag("digest", k).over(w)) for k in range(FANOUT - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("digest", k).over(w)) for k in range(1, FANOUT)]
    return nodes.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *after)})


def levels_of(nodes: DataFrame, most: int, label: str) -> list[DataFrame]:
    """The nodes (g, p, n, digest) of each level; a group is absent above its subroot (n = 1)."""
    levels = [nodes.select("g", "p", "n", "digest")]
    while most > 1:
        firsts = with_siblings(levels[-1].filter("n > 1")).filter(F.col("p") % FANOUT == 0)
        parents = firsts.select(
            "g", F.floor(F.col("p") / FANOUT).alias("p"), F.ceil(F.col("n") / FANOUT).alias("n"), F.sha2(F.concat("digest", "right"), 256).alias("digest")
        )
        levels.append(stored(parents, f"{label}-{len(levels)}"))
        most = -(-most // FANOUT)
    return levels


def subroots_of(levels: Sequence[DataFrame]) -> DataFrame:
    out = levels[0].filter("n = 1")
    for nodes in levels[1:]:
        out = out.unionByName(nodes.filter("n = 1"))
    return out.select("g", F.col("digest").alias("subroot"))


def with_paths(levels: Sequence[DataFrame], tops: DataFrame, label: str) -> DataFrame:
    """Nodes of the lowest level with subroot and path: the (left, right) of the node and of
    each node above it. tops: (g, subroot, path) with the path from the subroot up."""
    known = None
    for at in range(len(levels) - 1, -1, -1):
        nodes = levels[at]
        own = nodes.filter("n = 1").join(tops, "g")
        if known is not None:
            above = known.select("g", F.col("p").alias("parent"), "subroot", F.col("path").alias("upper"))
            inner = with_siblings(nodes.filter("n > 1")).withColumn("parent", F.floor(F.col("p") / FANOUT)).join(above, ["g", "parent"])
            step = F.array(F.struct("left", "right"))
            own = own.unionByName(inner.withColumn("path", F.concat(step, "upper")).drop("left", "right", "parent", "upper"))
        known = stored(own, f"{label}-paths-{at}") if at else own
    return known


def merkle_manifest(
    docs: DataFrame,
    *,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    order: str = "doc_id",
    received: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per document: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    A leaf hashes the named fields, null ones as `-`; nothing else of a row counts, so
    further columns, of whatever name, are ignored. `received` gives the value of a field
    as it came back (by default what it was): folded_root is computed from the leaf of
    those values and the siblings of the untouched dataset, and verified tells whether it
    is the root.

    Leaves ascend by order, nulls first, then by digest; repeated rows are leaves of their
    own. Null groups are one group, the first. An empty text differs from a null one, and
    texts count whole. An empty table has no rows and no root."""
    received = received or {}
    values = [F.col(f) for f in fields]
    back = [received.get(f, F.col(f)) for f in fields]
    touched = F.lit(False)
    for f in received:
        touched = touched | ~F.col(f).eqNullSafe(received[f])
    g = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = docs.select(
        g.alias("g"), F.col(order).alias("doc_id"), leaf_digest(values).alias("digest"), F.when(touched, leaf_digest(back)).alias("back")
    )
    placed, most = positioned(leaves, ["doc_id", "digest"], "merkle-leaves")
    levels = levels_of(placed, most, "merkle-level")

    subroots, groups = positioned(subroots_of(levels).select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("subroot").alias("digest")), ["name"], "merkle-subroots")
    subroots = stored(subroots, "merkle-subroots-placed")
    upper = levels_of(subroots, groups, "merkle-upper")
    top = subroots_of(upper).first()
    none = F.array().cast(STEP)
    over = with_paths([subroots, *upper[1:]], subroots_of(upper).withColumn("path", none), "merkle-upper")
    tops = stored(over.select(F.col("name").alias("g"), F.col("digest").alias("subroot"), "path"), "merkle-tops")

    found = with_paths([placed, *levels[1:]], tops, "merkle")
    root = F.lit(top.subroot if top else None).cast("string")
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("back", "digest"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
