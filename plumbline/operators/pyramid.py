"""A pyramid of cells over boxes, and the boxes that rays meet by descending it.

Cells of one level are cubes a quarter as wide as those above; each occupied cell keeps how many items it has and the box that
holds them, so a level is one aggregate of the level below. A ray begins at the coarsest cells and goes into those only
whose boxes it meets. That is an equi-join with the children of the cells that are left, once a level: nothing is compared with all.

The finest level is chosen by the items' own occupancy, counted for all levels in one pass, as scans are surfaces and not
volumes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.store import stored

AXES = ("x", "y", "z")
#: Items a finest cell holds on average at most, and the most levels there are.
FULL, LEVELS = 8, 13
#: Slack of comparisons of squared distances.
SLACK = 1 + 1e-9
_CELL, _BOX = [f"c{a}" for a in AXES], [f"{e}{a}" for e in ("lo_", "hi_") for a in AXES]


def _meets_box() -> Column:
    """Whether the ray meets the box: what the three pairs of planes leave of it isn't empty. Boxes are widened by what rounding may take."""
    inside, enters, leaves = F.lit(True), [F.lit(0.0)], []
    for a in AXES:
        o, d, low, high = F.col(f"o{a}"), F.col(f"d{a}"), F.col(f"lo_{a}"), F.col(f"hi_{a}")
        slack = (F.abs(o) + F.abs(low) + F.abs(high)) * (SLACK - 1)
        first, second = (low - slack - o) / F.nullif(d, F.lit(0.0)), (high + slack - o) / F.nullif(d, F.lit(0.0))
        inside = inside & ((d != 0) | ((o >= low - slack) & (o <= high + slack)))
        enters.append(F.least(first, second))
        leaves.append(F.greatest(first, second))
    return inside & (F.greatest(*enters) <= F.least(*leaves))


class Pyramid:
    """items: any columns, and lo_x .. hi_z. Only a few numbers and the coarsest 64 cells reach the driver."""

    def __init__(self, items: DataFrame) -> None:
        bounds = items.agg(F.count("*"), *[f(c) for e, f in (("lo_", F.min), ("hi_", F.max)) for c in (f"{e}{a}" for a in AXES)]).first()
        self.count, origin = bounds[0], bounds[1:4]
        if not self.count:
            self.items = items
            return
        side = max(*(h - low for low, h in zip(origin, bounds[4:], strict=True)), 1e-9) * (1 + 1e-6)
        self.place = [((F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2 - o) / side for a, o in zip(AXES, origin, strict=True)]
        depth = self._depth(items)
        self.items = items.select("*", *[self._cell(p, depth).alias(c) for p, c in zip(self.place, _CELL, strict=True)])
        aggs = [F.sum("n").alias("n"), *[(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in _BOX]]
        cells = stored(self.items.withColumn("n", F.lit(1).cast("bigint")).groupBy(*_CELL).agg(*aggs), "cells")
        self.levels = [cells]
        for _ in range(depth - 1):
            up = self.levels[0].select(*[F.floor(F.col(c) / 4).cast("bigint").alias(c) for c in _CELL], "n", *_BOX)
            self.levels.insert(0, stored(up.groupBy(*_CELL).agg(*aggs), "cells"))
        self.top = self.levels[0].collect()

    @staticmethod
    def _cell(place: Column, level: int) -> Column:
        return F.floor(place * 4.0**level).cast("bigint")

    def _depth(self, items: DataFrame) -> int:
        """The first level whose cells hold FULL items or fewer, or beyond which no finer ones part them."""
        cells = items.agg(*[F.approx_count_distinct(F.xxhash64(*[self._cell(p, level) for p in self.place]), 0.05) for level in range(1, LEVELS + 1)]).first()
        for level in range(1, LEVELS + 1):
            if self.count / max(1, cells[level - 1]) <= FULL or level > 1 and level < LEVELS and cells[level] < 1.1 * cells[level - 1] and cells[level - 1] > 0.5 * cells[-1]:
                return level
        return LEVELS

    def met(self, rays: DataFrame) -> DataFrame:
        """rays' columns with the columns of every item in a finest cell whose box a ray meets.

        rays: ox, oy, oz (origin), dx, dy, dz (direction, not zero) and more, all finite; none of the names that items have.
        """
        return self._descended(rays, lambda left: left.filter(_meets_box()).select(*rays.columns, *_CELL))

    def _descended(self, queries: DataFrame, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """queries with the items of the finest cells that are left; kept says which cells of a level are."""
        if not self.count:
            return queries.join(self.items.drop(*_BOX), F.lit(False))
        top = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in (*_CELL, "n", *_BOX)]) for r in self.top])
        left = kept(queries.select("*", F.explode(top).alias("cell")).select(*queries.columns, "cell.*"))
        for cells in self.levels[1:]:
            children = cells.select(*[F.floor(F.col(c) / 4).cast("bigint").alias(f"up_{c}") for c in _CELL], *_CELL, "n", *_BOX)
            left = kept(left.select(*queries.columns, *[F.col(c).alias(f"up_{c}") for c in _CELL]).join(children, [f"up_{c}" for c in _CELL]))
        return left.select(*queries.columns, *_CELL).join(self.items.drop(*_BOX), _CELL).drop(*_CELL)
