"""Measured page geometry to issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafaudit.operators.ordered import top_n

# Fixed values of the sheet contract, in CSS pixels.
WIDTH = 210 * 96 / 25.4
HEIGHTS = [296 * 96 / 25.4, 297 * 96 / 25.4]
SHELL_TOLERANCE = 2.0
CONTENT_TOLERANCE = 4.5


def one_decimal(value: Column) -> Column:
    """Text of a double with one decimal, rounded on its exact binary value.

    The JVM formatter rounds the shortest decimal form (6.55 -> 6.6 although the stored
    number is below 6.55). Ten times the value is kept exactly as a sum and its rounding
    error, so the half is decided on the real number."""
    x = F.abs(value)
    a, b = x * 8, x * 2
    s = a + b
    part = s - a
    error = (a - (s - part)) + (b - part)
    whole = F.floor(s)
    over = (s - whole - 0.5) + error
    tenths = F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), whole + 1).otherwise(whole)
    sign = F.when((value < 0) & (tenths > 0), "-").otherwise("")
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def _px(value: Column) -> Column:
    return F.concat(one_decimal(value), F.lit("px"))


def layout_metric_issues(metrics: DataFrame, keys: list[str], *, scale_range: tuple[float, float] = (0.5, 1.0)) -> DataFrame:
    """Issue rows (keys, seq, message, suggested_scale) of measured pages.

    metrics: sheet_count, width, height, o_left.. o_bottom overflow, allow_vertical, and
    clipped array of (selector, x, y). A wrong sheet count hides the other checks."""
    one = F.col("sheet_count") == 1
    tall = F.col("allow_vertical")
    w, h = F.col("width"), F.col("height")
    off_height = F.least(*[F.abs(h - x) for x in HEIGHTS])
    side = F.greatest("o_left", "o_right")
    vert = F.greatest("o_top", "o_bottom")
    near = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("page content"))

    def clip_issue(c: Column) -> Column:
        x = F.when(c["x"] > CONTENT_TOLERANCE, F.concat(_px(c["x"]), F.lit(" horizontally")))
        y = F.when(~tall & (c["y"] > CONTENT_TOLERANCE), F.concat(_px(c["y"]), F.lit(" vertically")))
        text = F.concat(
            F.lit("clipped text/content overflow in "), F.coalesce(c["selector"], F.lit("element")), F.lit(": "),
            F.concat_ws(" and ", x, y),
        )
        return F.when(x.isNotNull() | y.isNotNull(), text)

    fixed = F.array(
        F.when(
            ~one,
            F.concat(
                F.lit("rendered page must contain exactly one A4 sheet (found "), F.col("sheet_count").cast("string"), F.lit(")")
            ),
        ),
        F.when(
            one & (F.abs(w - WIDTH) > SHELL_TOLERANCE),
            F.concat(F.lit("rendered page width is "), _px(w), F.lit(f"; expected 210mm ({WIDTH:.1f}px)")),
        ),
        F.when(
            one & ~tall & (off_height > SHELL_TOLERANCE),
            F.concat(F.lit("rendered page height is "), _px(h), F.lit("; expected 296–297mm A4 height")),
        ),
        F.when(
            one & (side > CONTENT_TOLERANCE),
            F.concat(
                F.lit("horizontal overflow by "), _px(side), F.lit(" near "),
                F.when(F.col("o_left") >= F.col("o_right"), near("at_left")).otherwise(near("at_right")),
            ),
        ),
        F.when(
            one & ~tall & (vert > CONTENT_TOLERANCE),
            F.concat(
                F.lit("vertical overflow by "), _px(vert), F.lit(" near "),
                F.when(F.col("o_top") >= F.col("o_bottom"), near("at_top")).otherwise(near("at_bottom")),
            ),
        ),
    )
    clips = F.when(one, F.transform(F.coalesce("clipped", F.array()), clip_issue)).otherwise(F.array().cast("array<string>"))
    found = F.filter(F.concat(fixed, clips), lambda m: m.isNotNull())
    low, high = scale_range
    scale = F.greatest(F.lit(low), F.least(F.lit(high), WIDTH / (WIDTH + F.greatest(side, F.lit(0.0)))))
    return metrics.select(*keys, F.round(scale, 4).alias("suggested_scale"), F.posexplode(found).alias("seq", "message")).withColumn(
        "seq", F.col("seq").cast("bigint")
    )


def issue_cap(issues: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """The first n issues of each page, in order."""
    return top_n(issues, keys, [F.col("seq").asc()], n)


def has_issue() -> Column:
    """Whether a measured page has an issue at all, without its messages."""
    one, tall = F.col("sheet_count") == 1, F.col("allow_vertical")
    off_height = F.least(*[F.abs(F.col("height") - x) for x in HEIGHTS])
    true = lambda c: F.coalesce(c, F.lit(False))
    clipped = F.exists(F.coalesce("clipped", F.array()), lambda c: true(c["x"] > CONTENT_TOLERANCE) | true(~tall & (c["y"] > CONTENT_TOLERANCE)))
    return (
        true(~one)
        | true(one & (F.abs(F.col("width") - WIDTH) > SHELL_TOLERANCE))
        | true(one & ~tall & (off_height > SHELL_TOLERANCE))
        | true(one & (F.greatest("o_left", "o_right") > CONTENT_TOLERANCE))
        | true(one & ~tall & (F.greatest("o_top", "o_bottom") > CONTENT_TOLERANCE))
        | true(one & clipped)
    )


def first_issues(metrics: DataFrame, keys: list[str], order: str, n: int = 6) -> DataFrame:
    """The first n issues of each page over its measured sheets, in order.

    Each sheet with an issue gives one at least, so messages are written for the first n
    such sheets of a page alone."""
    place = Window.partitionBy(*keys).orderBy(order)
    sheets = metrics.filter(has_issue()).withColumn("_place", F.rank().over(place)).filter(F.col("_place") <= n).drop("_place")
    found = layout_metric_issues(sheets, [*keys, order])
    return issue_cap(found.withColumn("seq", F.struct(order, "seq")), keys, n)
