"""Polygons, lines, morphology, components, distances and chip choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import raster as R
from ..operators import morphology as M, spatial, zonal
from ..sources.derived import dense, pixels, polygons, side
from .raster_plans import delta
from .registry import query

#: Cells of the dense raster above these values are True; the higher, the sparser the mask.
DENSE_T, SPARSE_T = 0.05, 0.2


def mask(spark: SparkSession, sf_dir: str, over: float = DENSE_T) -> DataFrame:
    return dense(spark, sf_dir).select("y", "x", (F.col("v") >= over).alias("m"))


_M = "m AS (SELECT y, x, v >= {t}::DOUBLE AS m FROM dense)"


def _mask_sql(over: float) -> str:
    return _M.format(t=over)


def dilate_sql(src: str, k: int, out: str) -> str:
    return f"""{out}_r AS (SELECT y, x, max(m) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS m FROM {src}),
    {out} AS (SELECT y, x, max(m) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS m FROM {out}_r)"""


def erode_sql(src: str, k: int, out: str) -> str:
    n = 2 * k + 1
    return f"""{out}_r AS (SELECT y, x, sum(m::INT) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) = {n} AS m FROM {src}),
    {out} AS (SELECT y, x, sum(m::INT) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) = {n} AS m FROM {out}_r)"""


def reach_sql(src: str, near: str, out: str) -> str:
    """Every True cell with the cells that it reaches, by repeated steps."""
    return f"""{out} AS (SELECT y, x, y AS ry, x AS rx FROM {src} WHERE m UNION SELECT r.y, r.x, c.y, c.x FROM {out} r JOIN {src} c ON c.m AND {near})"""


NEAR4 = "abs(c.y - r.ry) + abs(c.x - r.rx) = 1"
NEAR8 = "abs(c.y - r.ry) <= 1 AND abs(c.x - r.rx) <= 1"
LABELS_SQL = "l AS (SELECT y, x, min(ry * 2147483648 + rx)::BIGINT AS label FROM reach GROUP BY y, x)"


@query("a1_closing", f"WITH {_mask_sql(SPARSE_T)}, {dilate_sql('m', 3, 'd')}, {erode_sql('d', 3, 'c')} SELECT y, x FROM c WHERE m", "dense")
def a1(spark, sf_dir):
    return M.close(mask(spark, sf_dir, SPARSE_T), 3).where("m").select("y", "x")


@query("a1_dilation", f"WITH {_mask_sql(SPARSE_T)}, {dilate_sql('m', 4, 'd')} SELECT y, x FROM d WHERE m", "dense")
def a1d(spark, sf_dir):
    return M.dilate(mask(spark, sf_dir, SPARSE_T), 4).where("m").select("y", "x")


@query("a6_erosion", f"WITH {_mask_sql(-0.1)}, {erode_sql('m', 1, 'e')} SELECT y, x FROM e WHERE m", "dense")
def a6(spark, sf_dir):
    return M.erode(mask(spark, sf_dir, -0.1), 1).where("m").select("y", "x")


@query("a3_label4", f"WITH RECURSIVE {_mask_sql(SPARSE_T)}, {reach_sql('m', NEAR4, 'reach')}, {LABELS_SQL} SELECT y, x, label FROM l", "dense")
def a3(spark, sf_dir):
    return M.label(mask(spark, sf_dir, SPARSE_T)).select("y", "x", "label")


@query("a4_largest8", f"WITH RECURSIVE {_mask_sql(SPARSE_T)}, {reach_sql('m', NEAR8, 'reach')}, {LABELS_SQL} SELECT y, x FROM l WHERE label = (SELECT label FROM l GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)", "dense")
def a4(spark, sf_dir):
    return M.largest(mask(spark, sf_dir, SPARSE_T)).select("y", "x")


@query("a5_size_filter", f"WITH RECURSIVE {_mask_sql(SPARSE_T)}, {reach_sql('m', NEAR4, 'reach')}, {LABELS_SQL} SELECT y, x FROM l WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) >= 3)", "dense")
def a5(spark, sf_dir):
    return M.keep_large(mask(spark, sf_dir, SPARSE_T), 3).where("m").select("y", "x")


_HOLES = """frame AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM {src}),
    o AS (SELECT y AS ry, x AS rx FROM {src}, frame WHERE NOT m AND (y = y0 OR y = y1 OR x = x0 OR x = x1)
    UNION SELECT c.y, c.x FROM o r JOIN {src} c ON NOT c.m AND abs(c.y - r.ry) + abs(c.x - r.rx) = 1)"""


@query("a2_fill_holes", f"WITH RECURSIVE {_mask_sql(DENSE_T)}, {_HOLES.format(src='m')} SELECT y, x FROM m WHERE (y, x) NOT IN (SELECT (ry, rx) FROM o)", "dense")
def a2(spark, sf_dir):
    return M.fill_holes(mask(spark, sf_dir)).where("m").select("y", "x")


_FOOT = f"""WITH RECURSIVE {_mask_sql(SPARSE_T)}, {dilate_sql('m', 1, 'd')}, {erode_sql('d', 1, 'cl')}, {_HOLES.format(src='cl')},
    filled AS (SELECT y, x, (y, x) NOT IN (SELECT (ry, rx) FROM o) AS m FROM cl), {reach_sql('filled', NEAR4, 'reach')}, {LABELS_SQL}
    SELECT y, x FROM l WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) >= 6)"""


@query("a8_footprint", _FOOT, "dense")
def a8(spark, sf_dir):
    return M.footprint(mask(spark, sf_dir, SPARSE_T), k=1, least=6).where("m").select("y", "x")


@query("a7_distance", f"WITH {_mask_sql(0.27)} SELECT a.y, a.x, round_even(sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))::DOUBLE) * 10, 6) AS distance FROM m a JOIN m b ON b.m GROUP BY a.y, a.x", "dense")
def a7(spark, sf_dir):
    d = M.distance(mask(spark, sf_dir, 0.27), 10.0).where("y IS NULL OR distance IS NOT NULL")
    return d.select("y", "x", F.bround("distance", 6).alias("distance"))


@query("j9_nearest_cell", f"WITH {_mask_sql(0.27)} SELECT a.y, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))::BIGINT AS least FROM m a JOIN m b ON b.m GROUP BY a.y", "dense")
def j9(spark, sf_dir):
    d = M.squared_distance(mask(spark, sf_dir, 0.27)).where("y IS NULL OR sq IS NOT NULL")
    return d.groupBy("y").agg(F.min("sq").alias("least"))


@query("w6_box_fraction", f"WITH {_mask_sql(DENSE_T)}, r AS (SELECT y, x, sum(m::INT) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS s FROM m) SELECT y, x, (sum(s) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 4 PRECEDING AND 3 FOLLOWING))::DOUBLE / 64 AS fraction FROM r", "dense")
def w6(spark, sf_dir):
    return M.box_fraction(mask(spark, sf_dir), 8).select("y", "x", "fraction")


_GRAD = """g AS (SELECT y, x, (coalesce(lead(v) OVER wy, v) - coalesce(lag(v) OVER wy, v)) / ((lead(v) OVER wy IS NOT NULL)::INT + (lag(v) OVER wy IS NOT NULL)::INT) AS d_dy,
    (coalesce(lead(v) OVER wx, v) - coalesce(lag(v) OVER wx, v)) / ((lead(v) OVER wx IS NOT NULL)::INT + (lag(v) OVER wx IS NOT NULL)::INT) AS d_dx
    FROM dense WINDOW wy AS (PARTITION BY x ORDER BY y), wx AS (PARTITION BY y ORDER BY x))"""


@query("w5_gradient", f"WITH {_GRAD} SELECT y, x, round_even(d_dy, 9) AS d_dy, round_even(d_dx, 9) AS d_dx FROM g", "dense")
def w5(spark, sf_dir):
    return M.gradient(dense(spark, sf_dir), "v").select("y", "x", F.bround("d_dy", 9).alias("d_dy"), F.bround("d_dx", 9).alias("d_dx"))


@query(
    "r13_slope_aspect",
    f"WITH {_GRAD}, s AS (SELECT y, x, d_dy / (0.001::DOUBLE * 111320) AS zy, d_dx / (0.001::DOUBLE * 111320 * cos(radians(48.4::DOUBLE))) AS zx FROM g) "
    "SELECT y, x, round_even(degrees(atan(sqrt(zx * zx + zy * zy))), 8) AS slope, round_even(cos(atan2(-zx, zy)), 6) AS northness, round_even(sin(atan2(-zx, zy)), 6) AS eastness FROM s",
    "dense",
)
def r13(spark, sf_dir):
    s = M.slope_aspect(dense(spark, sf_dir), "v", 0.001, 48.4)
    return s.select("y", "x", F.bround("slope", 8).alias("slope"), F.bround("northness", 6).alias("northness"), F.bround("eastness", 6).alias("eastness"))


# --- polygons and lines ----------------------------------------------------
_RASTER_SQL = """cells AS (SELECT y, x FROM (SELECT unnest(range(0, s)) AS y FROM dims), (SELECT unnest(range(0, s)) AS x FROM dims)),
    edges AS (SELECT seq, code, ring[k] AS a, ring[k % len(ring) + 1] AS b FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS k FROM polygons)),
    hits AS (SELECT y, x, seq, code FROM cells, edges WHERE (a.y > y + 0.5::DOUBLE) <> (b.y > y + 0.5::DOUBLE)
        AND x + 0.5::DOUBLE < (b.x - a.x) * (y + 0.5::DOUBLE - a.y) / (b.y - a.y) + a.x GROUP BY y, x, seq, code HAVING count(*) % 2 = 1),
    burnt AS (SELECT y, x, arg_max(code, seq) AS code FROM hits GROUP BY y, x)"""


@query("j7_rasterise_polygons", f"WITH {_RASTER_SQL} SELECT y, x, code FROM burnt", "polygons", "dims")
def j7(spark, sf_dir):
    s = side(spark, sf_dir)
    return spatial.rasterise(polygons(spark, sf_dir), s, s).select("y", "x", "code")


@query("j4_wide_masks", f"WITH {_RASTER_SQL} SELECT code, count(*) AS cells, count(*) FILTER (coalesce(dnbr >= 0.10, false) AND ok) AS low FROM burnt JOIN delta USING (y, x) GROUP BY code", "polygons", "dims", "delta")
def j4(spark, sf_dir):
    s = side(spark, sf_dir)
    joined = spatial.rasterise(polygons(spark, sf_dir), s, s).join(delta(spark, sf_dir), ["y", "x"])
    return joined.groupBy("code").agg(F.count(F.lit(1)).alias("cells"), F.count_if(R.at_least(F.col("dnbr"), R.LOW) & F.col("ok")).alias("low"))


@query("e2_severity_by_land", f"WITH {_RASTER_SQL} SELECT code, round_even(count(*) / 100::DOUBLE, 1) AS ha, round_even(sum((dnbr >= 0.27)::INT) * 100.0::DOUBLE / nullif(count(dnbr), 0), 1) AS pct_burned, round_even(median(dnbr), 3) AS dnbr_median FROM burnt JOIN delta USING (y, x) GROUP BY code", "polygons", "dims", "delta")
def e2(spark, sf_dir):
    s = side(spark, sf_dir)
    joined = spatial.rasterise(polygons(spark, sf_dir), s, s).join(delta(spark, sf_dir), ["y", "x"])
    return zonal.zones(joined, "code", 0.0).select("code", "ha", "pct_burned", "dnbr_median")


@query(
    "j8_rasterise_lines",
    """WITH seg AS (SELECT (n_nationkey * 5 % 43)::DOUBLE + 0.25::DOUBLE AS x0, (n_nationkey * 11 % 41)::DOUBLE + 0.75::DOUBLE AS y0, (n_nationkey * 5 % 43)::DOUBLE + 8.5::DOUBLE AS x1, (n_nationkey * 11 % 41)::DOUBLE + 5.125::DOUBLE AS y1 FROM nation),
    cells AS (SELECT y, x FROM (SELECT unnest(range(0, s)) AS y FROM dims), (SELECT unnest(range(0, s)) AS x FROM dims)),
    clipped AS (SELECT y, x, greatest(0, (x - x0) / (x1 - x0), (y - y0) / (y1 - y0)) AS t0, least(1, (x + 1 - x0) / (x1 - x0), (y + 1 - y0) / (y1 - y0)) AS t1 FROM cells, seg)
    SELECT DISTINCT y, x FROM clipped WHERE t0 < t1 - 1e-9""",
    "dims",
)
def j8(spark, sf_dir):
    from ..sources.tables import read

    s, k = side(spark, sf_dir), F.col("n_nationkey")
    x, y = (k * 5 % 43).cast("double"), (k * 11 % 41).cast("double")
    lines = read(spark, sf_dir, "nation").select((x + 0.25).alias("x0"), (y + 0.75).alias("y0"), (x + 8.5).alias("x1"), (y + 5.125).alias("y1"))
    return spatial.burn_lines(lines, s, s)


# --- chips -----------------------------------------------------------------
MIN_PURITY = 0.70


def pick_at_size(classes: DataFrame, burned: DataFrame, size: int) -> DataFrame:
    """One row: the chip centre of a class at a size, its purity, and the rule that found it.

    The largest component's centroid, if it is inside and pure enough; else its purest-enough
    cell with most burned around; else its purest cell.  First cell on ties.
    """
    comp = M.largest(classes)
    pure = M.box_fraction(classes, size).select("y", "x", F.col("fraction").alias("purity"))
    burnt = M.box_fraction(burned, size).select("y", "x", F.col("fraction").alias("burnt"))
    cells = comp.join(pure, ["y", "x"]).join(burnt, ["y", "x"])
    middle = cells.agg(F.bround(F.avg("y")).cast("long").alias("cy"), F.bround(F.avg("x")).cast("long").alias("cx"))
    enough = F.col("purity") >= MIN_PURITY
    rule = F.when((F.col("y") == F.col("cy")) & (F.col("x") == F.col("cx")) & enough, 2).when(enough, 1).otherwise(0)
    score = F.when(rule == 0, F.col("purity")).otherwise(F.col("burnt"))
    judged = cells.crossJoin(F.broadcast(middle)).select("y", "x", "purity", rule.alias("rule"), score.alias("score"))
    best = judged.agg(F.max_by(F.struct("y", "x", "purity", "rule"), F.struct("rule", "score", -F.col("y"), -F.col("x"))).alias("b"))
    how = F.get(F.array(F.lit("purest-in-patch"), F.lit("burnt-in-patch"), F.lit("centroid")), F.col("b.rule"))
    return best.where("b IS NOT NULL").select(F.lit(size).alias("size"), "b.y", "b.x", "b.purity", how.alias("how"))


@query("a10_chip_location")
def a10(spark, sf_dir):
    """Chip places for one class at each size, widest first; the first pure enough is the one to cut."""
    px = pixels(spark, sf_dir)
    classes = px.select("y", "x", (F.col("fuel") == 2).alias("m"))
    burned = delta(spark, sf_dir).select("y", "x", R.at_least(F.col("dnbr")).alias("m"))
    out = None
    for size in (8, 6, 4):
        one = pick_at_size(classes, burned, size)
        out = one if out is None else out.unionByName(one)
    w = Window.orderBy(F.col("purity") < MIN_PURITY, F.when(F.col("purity") >= MIN_PURITY, -F.col("size")).otherwise(-F.col("purity")))
    return out.withColumn("chosen", F.row_number().over(w) == 1)


@query("k13_clamped_window", "SELECT y, x, least(greatest(y - 4, 0), s - 8)::BIGINT AS r0, least(greatest(x - 4, 0), s - 8)::BIGINT AS c0 FROM px, dims", "px", "dims")
def k13(spark, sf_dir):
    s = side(spark, sf_dir)
    clamp = lambda c: F.least(F.greatest(F.col(c) - 4, F.lit(0)), F.lit(s - 8)).cast("long")
    return pixels(spark, sf_dir).select("y", "x", clamp("y").alias("r0"), clamp("x").alias("c0"))


#: Cells of a chip's side.
CHIP = 8
_CHIPS_SQL = f"""firsts AS (SELECT fuel, min(y * 1000000 + x) AS place FROM px WHERE fuel >= 0 GROUP BY fuel),
    w AS (SELECT fuel AS k, least(greatest(place // 1000000 - {CHIP // 2}, 0), s - {CHIP}) AS r0, least(greatest(place % 1000000 - {CHIP // 2}, 0), s - {CHIP}) AS c0 FROM firsts, dims),
    chip AS (SELECT k, r0, c0, y - r0 AS row, x - c0 AS col, fuel, floor(least(greatest(coalesce(red_pre, 0) / 0.30, 0), 1) * 255)::INT AS red
        FROM w JOIN px ON y >= r0 AND y < r0 + {CHIP} AND x >= c0 AND x < c0 + {CHIP})"""


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, r0, c0, row, col, fuel, red): for each class the window around its first cell, moved inside the grid, and its cells
    under the fixed stretch.  A window is an equi-join on its cells."""
    from ..sources.images import byte_level

    s = side(spark, sf_dir)
    px = pixels(spark, sf_dir)
    first = px.where("fuel >= 0").groupBy("fuel").agg(F.min(F.struct("y", "x")).alias("at"))
    clamp = lambda c: F.least(F.greatest(c - CHIP // 2, F.lit(0)), F.lit(s - CHIP))
    windows = first.select(F.col("fuel").alias("k"), clamp(F.col("at.y")).alias("r0"), clamp(F.col("at.x")).alias("c0"))
    spots = windows.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(CHIP - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(CHIP - 1))))
    spots = spots.select("k", "r0", "c0", F.col("row").cast("long"), F.col("col").cast("long"), (F.col("r0") + F.col("row")).alias("y"), (F.col("c0") + F.col("col")).alias("x"))
    return spots.join(px, ["y", "x"]).select("k", "r0", "c0", "row", "col", "fuel", byte_level(F.col("red_pre")).alias("red"))


@query("k13_fuel_chips", f"WITH {_CHIPS_SQL} SELECT k, row, col, fuel, red FROM chip", "px", "dims")
def k13c(spark, sf_dir):
    """The cells of each class's chip."""
    return chips(spark, sf_dir).select("k", "row", "col", "fuel", "red")


@query(
    "k13_fuel_meta",
    f"""WITH {_CHIPS_SQL} SELECT '{{"size":{CHIP},"classes":[' || string_agg('{{"code":' || k || ',"row":' || r0 || ',"col":' || c0 || ',"cells":' || n || ',"purity":' || purity || '}}', ',' ORDER BY k) || ']}}' AS document
    FROM (SELECT k, any_value(r0) AS r0, any_value(c0) AS c0, count(*) AS n, round_even(sum((fuel = k)::INT)::DOUBLE / count(*), 3) AS purity FROM chip GROUP BY k)""",
    "px", "dims",
)
def k13m(spark, sf_dir):
    """One document: where each chip was cut and how much of it is its class, counted again on the cut."""
    pure = F.bround(F.sum((F.col("fuel") == F.col("k")).cast("double")) / F.count(F.lit(1)), 3)
    each = chips(spark, sf_dir).groupBy("k", "r0", "c0").agg(F.count(F.lit(1)).alias("cells"), pure.alias("purity"))
    entry = F.struct(F.col("k").alias("code"), F.col("r0").alias("row"), F.col("c0").alias("col"), "cells", "purity")
    listed = each.agg(F.array_sort(F.collect_list(entry)).alias("classes"))
    return listed.select(F.to_json(F.struct(F.lit(CHIP).alias("size"), "classes")).alias("document"))
