"""Rectangle expressions over four double columns, and the grid join for near boxes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafaudit.session import shared_table


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        return cls(*[F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")])

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return F.greatest(self.width, F.lit(0.0)) * F.greatest(self.height, F.lit(0.0))

    def grow(self, by: float | Column) -> "Box":
        return Box(self.x0 - by, self.y0 - by, self.x1 + by, self.y1 + by)

    def clip(self, other: "Box") -> "Box":
        return Box(
            F.greatest(self.x0, other.x0),
            F.greatest(self.y0, other.y0),
            F.least(self.x1, other.x1),
            F.least(self.y1, other.y1),
        )

    def columns(self, prefix: str = "") -> list[Column]:
        return [getattr(self, c).alias(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")]


def page_box(w: str = "page_w", h: str = "page_h") -> Box:
    return Box(F.lit(0.0), F.lit(0.0), F.col(w), F.col(h))


def valid_box(values: Column, *, unit: bool = False) -> Column:
    """Whether an array is a box (x0, y0, x1, y1) with an area; unit: all within 0 and 1."""
    v = [F.get(values, F.lit(i)) for i in range(4)]
    good = (F.size(values) == 4) & (v[2] > v[0]) & (v[3] > v[1])
    for x in v:
        good = good & (x.between(0.0, 1.0) if unit else ~F.isnan(x))
    return F.coalesce(good, F.lit(False))


def normalised_box(values: Column, page: Box) -> Box:
    """An array of shares of the page's width and height as a box on the page."""
    at = lambda i, low, size: low + F.get(values, F.lit(i)) * size
    return Box(at(0, page.x0, page.width), at(1, page.y0, page.height), at(2, page.x0, page.width), at(3, page.y0, page.height))


def distance2(a: Box, b: Box) -> Column:
    """Squared distance of two boxes, 0 where they meet."""
    dx = F.greatest(a.x0 - b.x1, b.x0 - a.x1, F.lit(0.0))
    dy = F.greatest(a.y0 - b.y1, b.y0 - a.y1, F.lit(0.0))
    return dx * dx + dy * dy


def intersects(a: Box, b: Box) -> Column:
    """True if the boxes share an area."""
    c = a.clip(b)
    return (c.x0 < c.x1) & (c.y0 < c.y1)


def overlap_score(a: Box, b: Box) -> Column:
    """Shared area over the smaller area."""
    small = F.least(a.area, b.area)
    return F.when(small > 0, a.clip(b).area / small).otherwise(0.0)


def similar_area(a: Box, b: Box, max_ratio: float = 4.0) -> Column:
    small, large = F.least(a.area, b.area), F.greatest(a.area, b.area)
    return F.coalesce((small > 0) & (large <= small * max_ratio), F.lit(False))


#: Tile sides of the grid levels, finest first; above them a level of one tile a page.
TILES = (16.0, 128.0)


def tile_of(value: Column, tile: float) -> Column:
    """Tile index along one axis."""
    return F.floor(value / tile)


def _level(box: Box, tiles: tuple[float, ...]) -> Column:
    """Finest level whose tile is no smaller than the box, so that a box covers four tiles at most."""
    size = F.greatest(box.width, box.height)
    out = F.lit(len(tiles))
    for i in range(len(tiles) - 1, -1, -1):
        out = F.when(size <= tiles[i], i).otherwise(out)
    return out


def _in_cells(df: DataFrame, box: Box, tiles: tuple[float, ...], meets: tuple[int, ...], probes: tuple[int, ...]) -> DataFrame:
    """One row per cell (level, role, tx, ty) of a box: on its own level in the roles `meets`,
    on each coarser one in the roles `probes`."""
    own = _level(box, tiles)
    entries = []
    for level in range(len(tiles) + 1):
        span = [tile_of(c, tiles[level]) for c in (box.x0, box.x1, box.y0, box.y1)] if level < len(tiles) else [F.lit(0).cast("bigint")] * 4
        for role in (0, 1):
            on = (own == level) if role in meets else F.lit(False)
            on = on | (own < level) if role in probes else on
            named = [c.alias(n) for c, n in zip(span, ("_x0", "_x1", "_y0", "_y1"), strict=True)]
            entries.append(F.when(on, F.struct(F.lit(level).alias("_level"), F.lit(role).alias("_role"), *named)))
    rows = df.select("*", F.inline(F.array_compact(F.array(*entries))))
    rows = rows.withColumn("_tx", F.explode(F.sequence("_x0", "_x1"))).withColumn("_ty", F.explode(F.sequence("_y0", "_y1")))
    return rows.drop("_x0", "_x1", "_y0", "_y1")


#: Boxes of a page on either side up to which its pairs are formed without tiles; results don't depend on it.
FEW_ON_PAGE = 256


def crowded_pages(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the pages that hold more than a few boxes on either side."""
    ones = [df.select(*keys, F.lit(i).alias("_side")) for i, df in enumerate((left, right))]
    counts = ones[0].unionByName(ones[1]).groupBy(*keys).agg(F.sum("_side").alias("_r"), F.count("*").alias("_n"))
    return shared_table(counts.filter(F.greatest(F.col("_r"), F.col("_n") - F.col("_r")) > FEW_ON_PAGE).select(*keys), "crowded-pages")


def near_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], gap: float | Column, *, lp: str = "l_", rp: str = "r_", tiles: tuple[float, ...] = TILES
) -> DataFrame:
    """Pairs of boxes on the same page whose extents, grown by gap, meet.

    Pages with few boxes are joined whole, one row per box. On a crowded page a box belongs
    to the grid level of its size and covers at most four tiles there. Two boxes meet on the
    coarser of their levels: each looks up (role 0 or 1) the other side's boxes of coarser
    levels, and only boxes of one level are compared tile by tile. So small boxes of a
    crowded page meet in small tiles, however large other boxes or the page are. A pair that
    shares several tiles is kept in the tile of its lower common corner. left and right carry
    prefixed x0..y1 columns and are read more than once; a box with x1 < x0 or y1 < y0 after
    growing meets nothing."""
    grown, other = Box.of(lp).grow(gap), Box.of(rp)
    sound = lambda box: (box.x0 <= box.x1) & (box.y0 <= box.y1)
    left, right = left.filter(sound(grown)), right.filter(sound(other))
    corner_x, corner_y = F.greatest(grown.x0, other.x0), F.greatest(grown.y0, other.y0)
    meet = (corner_x <= F.least(grown.x1, other.x1)) & (corner_y <= F.least(grown.y1, other.y1))
    crowded = crowded_pages(left, right, keys)
    if crowded.isEmpty():
        return left.join(right, keys).filter(meet)
    cell = ["_level", "_role", "_tx", "_ty"]
    a = _in_cells(left.join(crowded, keys, "left_semi"), grown, tiles, meets=(0, 1), probes=(0,))
    b = _in_cells(right.join(crowded, keys, "left_semi"), other, tiles, meets=(0,), probes=(1,))
    here = F.col("_level") == len(tiles)
    for i, t in enumerate(tiles):
        here = here | ((F.col("_level") == i) & (tile_of(corner_x, t) == F.col("_tx")) & (tile_of(corner_y, t) == F.col("_ty")))
    tiled = a.join(b, [*keys, *cell]).filter(meet & here).drop(*cell)
    return left.join(crowded, keys, "left_anti").join(right, keys).filter(meet).unionByName(tiled)


def prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{prefix}{c}") for c in df.columns])
