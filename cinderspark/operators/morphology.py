"""Masks as sets of cells: dilation, erosion, components, holes, distances.

A mask is a DataFrame (y, x, m) with one row per cell of a grid.  Rectangular
elements are separable, so dilation and erosion are two windows, one along rows
and one along columns; outside the grid everything is False.  Components work
on runs of cells along a row, cut at the edges of tiles, rather than on cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import staged
from ..shipping import ship
from .graph import connected_components


#: Columns of a tile: a row of a tile has half as many runs at most.
TILE = 256
#: Rows of the grid that a task of the distance transform takes at once.
BAND = 64
#: Neighbours to each side that the distance transform tries before it walks a row's lower envelope.
NEAR = 32
#: A squared distance, or a row, that is not known.
UNKNOWN = 1 << 62


def _along(by: str, order: str, k: int):
    return Window.partitionBy(by).orderBy(order).rangeBetween(-k, k)


def dilate(mask: DataFrame, k: int) -> DataFrame:
    """True where any cell of the (2k+1)-square is."""
    rows = mask.select("y", "x", F.max("m").over(_along("y", "x", k)).alias("m"))
    return rows.select("y", "x", F.max("m").over(_along("x", "y", k)).alias("m"))


def erode(mask: DataFrame, k: int) -> DataFrame:
    """True where all cells of the (2k+1)-square are, none of them outside."""
    full = lambda by, order: F.sum(F.col("m").cast("int")).over(_along(by, order, k)) == 2 * k + 1
    return mask.select("y", "x", full("y", "x").alias("m")).select("y", "x", full("x", "y").alias("m"))


def close(mask: DataFrame, k: int) -> DataFrame:
    return erode(dilate(mask, k), k)


def box_fraction(mask: DataFrame, size: int) -> DataFrame:
    """Share of True cells in the size-square around each cell; an even square reaches one further back."""
    low, high = -(size // 2), size - size // 2 - 1
    along = lambda by, order: Window.partitionBy(by).orderBy(order).rangeBetween(low, high)
    rows = mask.select("y", "x", "m", F.sum(F.col("m").cast("long")).over(along("y", "x")).alias("s"))
    return rows.select("y", "x", "m", (F.sum("s").over(along("x", "y")) / F.lit(float(size * size))).alias("fraction"))


def runs(mask: DataFrame) -> DataFrame:
    """Maximal runs of True cells along rows within a tile: run (its first cell, numbered row by row), y, tile, first, last."""
    islands = mask.where("m").withColumn("tile", F.floor(F.col("x") / TILE))
    islands = islands.withColumn("g", F.col("x") - F.row_number().over(Window.partitionBy("y", "tile").orderBy("x")))
    out = islands.groupBy("y", "tile", "g").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    return out.select((F.col("y") * F.lit(1 << 31) + F.col("first")).alias("run"), "y", "tile", "first", "last")


def label(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    """(y, x, label) of the True cells; a label is the component's first cell, numbered row by row.

    Runs meet those of the next row by (row, tile), and go on across a tile's edge by (row, column).
    """
    pieces = staged(runs(mask), "runs")
    d = int(diagonal)
    tile = lambda c: F.floor(c / TILE)
    reach = F.explode(F.array_distinct(F.array(tile(F.col("first") - d), tile(F.col("first")), tile(F.col("last") + d))))
    above = pieces.select(F.col("run").alias("a"), (F.col("y") + 1).alias("y"), F.col("first").alias("f"), F.col("last").alias("l"), reach.alias("tile"))
    touching = above.join(pieces, ["y", "tile"]).where((F.col("f") <= F.col("last") + d) & (F.col("first") <= F.col("l") + d))
    before = pieces.select(F.col("run").alias("a"), "y", (F.col("last") + 1).alias("first")).where(F.col("first") % TILE == 0)
    onward = before.join(pieces, ["y", "first"])
    edges = touching.select("a", F.col("run").alias("b")).unionByName(onward.select("a", F.col("run").alias("b")))
    roots = connected_components(edges, "a", "b", "label-edges")
    joined = pieces.join(roots, pieces.run == roots.node, "left")
    return joined.select("y", F.explode(F.sequence("first", "last")).alias("x"), F.coalesce("root", "run").alias("label"))


def fill_holes(mask: DataFrame) -> DataFrame:
    """Background that isn't connected, by edges, to the border becomes True."""
    frame = mask.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    back = label(mask.select("y", "x", (~F.col("m")).alias("m")))
    on_border = (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1")) | (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1"))
    outer = back.crossJoin(F.broadcast(frame)).where(on_border).select("label").distinct()
    hole = back.join(outer, "label", "left_anti").select("y", "x", F.lit(True).alias("hole"))
    return mask.join(hole, ["y", "x"], "left").select("y", "x", (F.col("m") | F.coalesce("hole", F.lit(False))).alias("m"))


def keep_large(mask: DataFrame, least: int, diagonal: bool = False) -> DataFrame:
    """Only components of at least so many cells stay."""
    cells = staged(label(mask, diagonal), "labels")
    large = cells.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("label")
    stays = cells.join(large, "label", "left_semi").select("y", "x", F.lit(True).alias("stay"))
    return mask.join(stays, ["y", "x"], "left").select("y", "x", F.coalesce("stay", F.lit(False)).alias("m"))


def largest(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """The largest component's cells; of equal ones the first."""
    cells = staged(label(mask, diagonal), "labels")
    sizes = cells.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return cells.join(F.broadcast(best), "label", "left_semi").select("y", "x")


def footprint(mask: DataFrame, k: int = 3, least: int = 2000) -> DataFrame:
    """Close, fill holes, and keep the large components."""
    return keep_large(fill_holes(staged(close(mask, k), "closed")), least)


def _lower_envelope(xs: list[int], gs: list[int], at: list[int]) -> list[int]:
    """For each place of ``at``, ascending, the least (place - x)^2 + g over the parabolas (x, g), x ascending.

    Parabolas that are nowhere lowest are dropped as the next ones come, so the work is linear.
    """
    seat = [0]  # parabolas of the envelope
    begin = [0]  # the first place where each is lowest
    for k in range(1, len(xs)):
        while True:
            j = seat[-1]
            # k is below j from the first whole place that is not before this one on
            top = gs[k] + xs[k] * xs[k] - gs[j] - xs[j] * xs[j]
            start = -(-top // (2 * (xs[k] - xs[j])))
            if len(seat) > 1 and start <= begin[-1]:
                seat.pop()
                begin.pop()
            else:
                break
        seat.append(k)
        begin.append(start)
    out, s = [], 0
    for x in at:
        while s + 1 < len(seat) and begin[s + 1] <= x:
            s += 1
        j = seat[s]
        out.append((x - xs[j]) ** 2 + gs[j])
    return out


def _squares(above: np.ndarray, below: np.ndarray, true: np.ndarray, y0: int, xs: np.ndarray) -> np.ndarray:
    """Squared distances of a band's cells, a row of the grid for each row; UNKNOWN if there is no True cell.

    ``above`` and ``below`` are the rows of each column's nearest True cells outside the band.  Columns first.  Then a
    row takes its neighbours at 1, 2, ... columns, until no farther one can be nearer; rows that are not done after NEAR
    of them go to the lower envelope, so the work is linear in the width.
    """
    y = y0 + np.arange(len(true))[:, None]
    up = np.maximum.accumulate(np.vstack([above, np.where(true, y, -UNKNOWN)]))[1:]
    down = np.minimum.accumulate(np.vstack([below, np.where(true, y, UNKNOWN)[::-1]]))[:0:-1]
    known = (up[0] > -UNKNOWN) | (down[0] < UNKNOWN)
    column = np.full(true.shape, UNKNOWN)
    column[:, known] = np.where(down < UNKNOWN, np.where(up > -UNKNOWN, np.minimum(y - up, down - y), down - y), y - up)[:, known] ** 2
    out = column.copy()
    if not known.any():
        return out
    todo, tried = np.arange(len(true)), 0
    reach = min(NEAR, len(xs) - 1) if len(xs) == xs[-1] - xs[0] + 1 else 0
    while tried < reach and len(todo := todo[out[todo].max(axis=1) > (tried + 1) ** 2]):
        tried += 1
        best, far = out[todo], column[todo] + tried * tried
        np.minimum(best[:, tried:], far[:, :-tried], out=best[:, tried:])
        np.minimum(best[:, :-tried], far[:, tried:], out=best[:, :-tried])
        out[todo] = best
    if tried == len(xs) - 1:
        return out
    todo = todo[out[todo].max(axis=1) > (tried + 1) ** 2]
    at, places = xs.tolist(), xs[known].tolist()
    for k in todo:
        out[k] = _lower_envelope(places, column[k, known].tolist(), at)
    return out


def squared_distance(mask: DataFrame) -> DataFrame:
    """(y, x, sq): the squared distance to the nearest True cell, exact; NULL for an all-False mask, or without a y.  One row
    for each cell, and rows and columns may lack some of theirs.

    Rows are taken BAND at a time.  What a band must know of the others is each column's nearest True cell above and
    below it: from the first and the last one in each band, by running windows over bands.  Squares stay integers.
    """
    ship(mask.sparkSession)
    cells = mask.select("y", "x", "m", (F.col("y") - F.pmod("y", F.lit(BAND))).alias("band"))
    here = F.when(F.col("m"), F.col("y"))
    ends = cells.groupBy("band", "x").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    # all three read both ends and no filter is inferred from the keys, so that Spark computes them once
    bands = ends.where("first IS NULL OR first <= last").select(F.col("band").alias("of")).distinct()
    columns = ends.where("first <= last").select(F.col("x").alias("column")).distinct()
    same = F.col("of").eqNullSafe(F.col("band")) & F.col("column").eqNullSafe(F.col("x"))
    every = bands.crossJoin(columns).join(ends, same, "left")
    up = Window.partitionBy("column").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("column").orderBy(F.desc("of")).rowsBetween(Window.unboundedPreceding, -1)
    outside = every.select("of", "column", F.max("last").over(up).alias("above"), F.min("first").over(down).alias("below"))

    def rows(cells: pa.Table, outside: pa.Table) -> pa.Table:
        if cells.column("y").null_count:
            xs = np.unique(cells.column("x").to_numpy())
            return pa.table({"y": pa.nulls(len(xs), pa.int64()), "x": xs, "sq": pa.nulls(len(xs), pa.int64())})
        y, x, y0 = cells.column("y").to_numpy(), cells.column("x").to_numpy(), cells.column("band")[0].as_py()
        xs = np.union1d(x, outside.column("column").to_numpy())
        true, given = np.zeros((BAND, len(xs)), bool), np.zeros((BAND, len(xs)), bool)
        at = y - y0, np.searchsorted(xs, x)
        given[at] = True
        some = cells.column("m").fill_null(False).to_numpy()
        true[at[0][some], at[1][some]] = True
        above, below = np.full(len(xs), -UNKNOWN), np.full(len(xs), UNKNOWN)
        place = np.searchsorted(xs, outside.column("column").to_numpy())
        above[place] = outside.column("above").fill_null(-UNKNOWN).to_numpy()
        below[place] = outside.column("below").fill_null(UNKNOWN).to_numpy()
        sq = _squares(above, below, true, y0, xs)[given]
        row, col = np.nonzero(given)
        return pa.table({"y": y0 + row, "x": xs[col], "sq": pa.array(sq, pa.int64(), mask=sq == UNKNOWN)})

    return cells.groupBy("band").cogroup(outside.groupBy("of")).applyInArrow(rows, "y long, x long, sq long")


def distance(mask: DataFrame, res: float = 1.0) -> DataFrame:
    """(y, x, distance) to the nearest True cell, exact; NULL for an all-False mask."""
    return squared_distance(mask).select("y", "x", (F.sqrt(F.col("sq").cast("double")) * res).alias("distance"))


def gradient(grid: DataFrame, value: str) -> DataFrame:
    """(y, x, d_dy, d_dx): central differences, one-sided at the border."""

    def along(by: str, order: str):
        w = Window.partitionBy(by).orderBy(order)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        low, high = F.coalesce(before, F.col(value)), F.coalesce(after, F.col(value))
        steps = before.isNotNull().cast("int") + after.isNotNull().cast("int")
        return F.when(steps > 0, (high - low) / steps)

    return grid.select("y", "x", value, along("x", "y").alias("d_dy"), along("y", "x").alias("d_dx"))


def slope_aspect(grid: DataFrame, value: str, degrees_per_cell: float, mid_lat: float) -> DataFrame:
    """(y, x, slope in degrees, northness, eastness) of a height grid whose rows run south."""
    metres = degrees_per_cell * 111320.0
    g = gradient(grid, value)
    dzdy, dzdx = F.col("d_dy") / metres, F.col("d_dx") / (metres * F.cos(F.radians(F.lit(mid_lat))))
    aspect = F.atan2(-dzdx, dzdy)
    return g.select(
        "y", "x", F.degrees(F.atan(F.hypot(dzdx, dzdy))).alias("slope"), F.cos(aspect).alias("northness"), F.sin(aspect).alias("eastness")
    )

