"""Source-to-rendered text loss and source-to-translation structure checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafaudit.functions import text as tx
from leafaudit.operators.corpus import tag_signature


def token_loss(source: DataFrame, rendered: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset difference source - rendered of visible tokens, for pages that exist in both.

    Source tokens count +1 and rendered tokens -1 into one map-side combined
    aggregation on (keys, token): a single shuffle and no join of token tables.
    Only the surviving tokens meet the rendered page keys."""

    def signed(pages: DataFrame, sign: int) -> DataFrame:
        words = tx.visible_words(F.col("html"))
        return pages.select(*keys, F.explode(words).alias("token"), F.lit(sign).alias("d"))

    balance = (
        signed(source, 1)
        .unionByName(signed(rendered, -1))
        .groupBy(*keys, "token")
        .agg(F.sum("d").alias("missing"))
        .filter("missing > 0")
    )
    return balance.join(rendered.select(*keys).distinct(), keys, "left_semi")


def top_missing_tokens(loss: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The n most frequent missing tokens of a page as text, with the page total."""
    order = Window.partitionBy(*keys).orderBy(F.desc("missing"), F.asc("token"))
    shown = (
        loss.withColumn("rk", F.row_number().over(order))
        .filter(F.col("rk") <= n)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rk", "token", "missing"))).alias("top"))
    )
    totals = loss.groupBy(*keys).agg(F.sum("missing").alias("total_missing"))
    label = F.transform(
        "top",
        lambda t: F.when(t["missing"] > 1, F.concat(t["token"], F.lit("×"), t["missing"].cast("string"))).otherwise(
            t["token"]
        ),
    )
    return totals.join(shown, keys).select(*keys, "total_missing", F.array_join(label, ", ").alias("missing_text"))


def structure_divergence(source: DataFrame, translated: DataFrame, keys: list[str]) -> DataFrame:
    """First tag position where two versions of a page differ, with both lengths.

    Each side is reduced to its tag array before the shuffle, so page bodies do
    not travel; the comparison then happens inside the joined row."""
    left = source.select(*keys, tag_signature(F.col("html")).alias("a"))
    right = translated.select(*keys, tag_signature(F.col("html")).alias("b"))
    # array_position of the first unequal pair; if one side is a prefix of the other
    # the answer is the shorter length.
    differs = F.expr("array_position(transform(slice(a, 1, least(size(a), size(b))), (x, i) -> x <> b[i]), true)")
    return (
        left.join(right, keys)
        .filter(~F.col("a").eqNullSafe(F.col("b")))
        .select(
            *keys,
            F.when(differs > 0, differs - 1)
            .otherwise(F.least(F.size("a"), F.size("b")))
            .cast("bigint")
            .alias("first_diff"),
            F.size("a").cast("bigint").alias("source_len"),
            F.size("b").cast("bigint").alias("translated_len"),
        )
    )
