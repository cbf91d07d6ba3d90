"""Ordered computations that stay exact when one group holds most of the rows.

A plain window puts a whole group into one task. Here a group is cut into buckets
along its order column; windows run inside (group, bucket), a map-side combined
summary holds one row per bucket, and only the summaries are ordered per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafaudit.session import shared_table

BUCKET = "_bucket"


def by_width(order: str, width: int = 4096) -> Column:
    """Bucket of a numeric order column; at most `width` distinct values share a bucket."""
    return F.floor(F.col(order) / width)


def ordered_columns(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    *,
    rank: str | None = None,
    lags: dict[str, str] | None = None,
    leads: dict[str, str] | None = None,
    sums: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
) -> DataFrame:
    """Add exact per-group columns over a total order whose first part drives `bucket`.

    rank: name of a row_number column. lags / leads: {new: column} value of the
    previous / next row. sums: {new: column} running sum including the row. lasts: {new: column} latest
    non-null value up to the row."""
    lags, leads, sums, lasts = lags or {}, leads or {}, sums or {}, lasts or {}
    rows = df.withColumn(BUCKET, bucket)
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    sofar = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct(*order)

    local = rows.select(
        "*",
        F.row_number().over(inside).alias("_rn"),
        *[F.lag(c).over(inside).alias(f"_lag_{n}") for n, c in lags.items()],
        *([F.lead(F.lit(1)).over(inside).isNull().alias("_end")] if leads else []),
        *[F.lead(c).over(inside).alias(f"_lead_{n}") for n, c in leads.items()],
        *[F.sum(c).over(sofar).alias(f"_sum_{n}") for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(sofar).alias(f"_last_{n}") for n, c in lasts.items()],
    )
    summary = rows.groupBy(*keys, BUCKET).agg(
        F.count("*").alias("_n"),
        *[F.max_by(c, key).alias(f"_l_{n}") for n, c in lags.items()],
        *[F.min_by(c, key).alias(f"_f_{n}") for n, c in leads.items()],
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[
            F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), key)).alias(f"_v_{n}")
            for n, c in lasts.items()
        ],
    )
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        BUCKET,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.lag(f"_l_{n}").over(across).alias(f"_l0_{n}") for n in lags],
        *[F.lead(f"_f_{n}").over(across).alias(f"_f0_{n}") for n in leads],
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s0_{n}") for n in sums],
        *[F.last(f"_v_{n}", ignorenulls=True).over(before).alias(f"_v0_{n}") for n in lasts],
    )
    out = local.join(carried, [*keys, BUCKET])
    added = [
        *([(F.col("_rn") + F.col("_n0")).cast("bigint").alias(rank)] if rank else []),
        *[F.when(F.col("_rn") == 1, F.col(f"_l0_{n}")).otherwise(F.col(f"_lag_{n}")).alias(n) for n in lags],
        *[F.when(F.col("_end"), F.col(f"_f0_{n}")).otherwise(F.col(f"_lead_{n}")).alias(n) for n in leads],
        *[(F.coalesce(F.col(f"_sum_{n}"), F.lit(0)) + F.col(f"_s0_{n}")).alias(n) for n in sums],
        *[F.coalesce(F.col(f"_last_{n}"), F.col(f"_v0_{n}")).alias(n) for n in lasts],
    ]
    return out.select(*[F.col(c) for c in df.columns], *added)


def whole_columns(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    lags: dict[str, str] | None = None,
    leads: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
) -> DataFrame:
    """The same columns for groups known to be small: one plain window, one shuffle."""
    along = Window.partitionBy(*keys).orderBy(*order)
    sofar = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        "*",
        *[F.lag(c).over(along).alias(n) for n, c in (lags or {}).items()],
        *[F.lead(c).over(along).alias(n) for n, c in (leads or {}).items()],
        *[F.last(c, ignorenulls=True).over(sofar).alias(n) for n, c in (lasts or {}).items()],
    )


def trailing_window(
    df: DataFrame, keys: list[str], rank: str, depth: int, build, *, block: int = 4096
) -> DataFrame:
    """Apply build(window) over the last `depth` rows, given a dense rank per group.

    Rows are cut into blocks of ranks; the last depth - 1 rows of a block are copied
    into the next one as context, so no block needs its neighbour."""
    home = F.floor((F.col(rank) - 1) / block)
    is_tail = (F.col(rank) - 1) % block >= block - (depth - 1)
    spread = df.select("*", F.explode(F.when(is_tail, F.array(home, home + 1)).otherwise(F.array(home))).alias(BUCKET))
    w = Window.partitionBy(*keys, BUCKET).orderBy(rank).rowsBetween(-(depth - 1), 0)
    return build(spread, w).filter(F.col(BUCKET) == home).drop(BUCKET)


def islands(df: DataFrame, keys: list[str], value: str, *, width: int = 1024) -> DataFrame:
    """Runs of consecutive integers per group as (first, last, n).

    Runs are built inside buckets of `width` values; only runs that touch a bucket
    border (at most two per bucket) are merged along the group."""
    distinct = df.select(*keys, value).distinct().withColumn(BUCKET, F.floor(F.col(value) / width))
    inside = Window.partitionBy(*keys, BUCKET).orderBy(value)
    local = (
        distinct.withColumn("_g", F.col(value) - F.row_number().over(inside))
        .groupBy(*keys, BUCKET, "_g")
        .agg(F.min(value).alias("first"), F.max(value).alias("last"))
    )
    on_border = (F.col("first") == F.col(BUCKET) * width) | (F.col("last") == F.col(BUCKET) * width + width - 1)
    along = Window.partitionBy(*keys).orderBy("first")
    opens = F.coalesce(F.col("first") != F.lag("last").over(along) + 1, F.lit(True))
    merged = (
        local.filter(on_border)
        .withColumn("_new", opens.cast("int"))
        .withColumn("_run", F.sum("_new").over(along))
        .groupBy(*keys, "_run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("_run")
    )
    runs = local.filter(~on_border).select(*keys, "first", "last").unionByName(merged)
    return runs.withColumn("n", F.col("last") - F.col("first") + 1)


def explode_range(df: DataFrame, keep: list[str], low: Column, high: Column, out: str, *, step: int = 65536) -> DataFrame:
    """One row per integer low..high.

    A long range is first cut into pieces of `step` that are spread over the cluster
    (a fixed partition number, so that tiny pieces are not merged again), then
    expanded; a single huge book does not expand in one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = (
        df.withColumn("_a", low.cast("bigint"))
        .withColumn("_z", high.cast("bigint"))
        .filter("_a <= _z")
        .select(*keep, "_z", F.explode(F.sequence("_a", "_z", F.lit(step).cast("bigint"))).alias("_from"))
        .repartition(n, *keep, "_from")
    )
    last = F.least(F.col("_from") + (step - 1), F.col("_z"))
    return pieces.select(*keep, F.explode(F.sequence("_from", last)).alias(out))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rk") -> DataFrame:
    """The first n rows of every group; Spark keeps at most n per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def join_unique(left: DataFrame, right: DataFrame, key: str, *, floor: int = 10_000, counted: DataFrame | None = None) -> DataFrame:
    """Left join to a table with one row per key, when some keys may hold much of the left side.

    Keys of more than a thousandth of the rows (and of the floor) are at most a thousand;
    their rows of the right side are broadcast, all other keys are joined by shuffle.
    counted: rows with the keys of the left side, if those are had with less work."""
    counted = left if counted is None else counted
    counts = shared_table(counted.groupBy(key).agg(F.count("*").alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = [r[0] for r in counts.filter(F.col("_n") > max(floor, total // 1000)).select(key).collect() if r[0] is not None]
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.filter(F.col(key).isin(hot)))
    return left.filter(is_hot).join(few, key, "left").unionByName(left.filter(~is_hot).join(right, key, "left"))
