"""Satellite plume plans: orbit choice, baselines and anomalies, rings, smoke height; catalogue and geometry scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, raster as R
from ..functions.weather import vector_mean
from ..operators.quantiles import exact_quantiles
from ..operators.ranking import global_rank
from ..sources.derived import catalogue, orbits, pixels, problems, side, swaths
from ..sources.tables import read
from .registry import query

BOX = (2.2, 48.1, 2.8, 48.7)
FIRE = (2.53, 48.38)
#: The geographic frame of the swath fields: north-west corner and steps.
ORIGIN, STEP = (2.0, 49.0), (0.02, -0.03)
_SEARCH_SQL = f"SELECT id, datetime, cloud FROM catalogue WHERE west <= {BOX[2]}::DOUBLE AND west + 0.3::DOUBLE >= {BOX[0]}::DOUBLE AND south <= {BOX[3]}::DOUBLE AND south + 0.3::DOUBLE >= {BOX[1]}::DOUBLE AND datetime BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1999-12-31' AND cloud < 20"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, s, e, n = BOX
    c = catalogue(spark, sf_dir)
    overlaps = (F.col("west") <= e) & (F.col("west") + 0.3 >= w) & (F.col("south") <= n) & (F.col("south") + 0.3 >= s)
    when = F.col("datetime").between(F.to_timestamp(F.lit("1994-01-01")), F.to_timestamp(F.lit("1999-12-31")))
    return c.where(overlaps & when & (F.col("cloud") < 20))


@query("s1_catalogue_search", _SEARCH_SQL, "catalogue")
def s1(spark, sf_dir):
    return found(spark, sf_dir).orderBy("datetime", "id").select("id", "datetime", "cloud")


@query("t1_by_time", f"SELECT row_number() OVER (ORDER BY datetime, id) AS place, id FROM ({_SEARCH_SQL})", "catalogue")
def t1(spark, sf_dir):
    return global_rank(found(spark, sf_dir), ["datetime", "id"]).select("place", "id")


@query("r2_boa_offset", "SELECT id, CASE WHEN applied IS TRUE THEN 0 WHEN try_cast(coalesce(baseline, '00.00') AS DOUBLE) >= 4 THEN -1000 ELSE 0 END AS boa_offset FROM catalogue", "catalogue")
def r2(spark, sf_dir):
    return catalogue(spark, sf_dir).select("id", R.boa_offset(F.col("applied"), F.col("baseline")).alias("boa_offset"))


@query("s2_scene_pair", "SELECT id, 'found' AS status FROM catalogue WHERE id IN ('S2_1', 'S2_2', 'S2_x') UNION ALL SELECT w, 'missing' FROM (SELECT unnest(['S2_1', 'S2_2', 'S2_x']) AS w) WHERE w NOT IN (SELECT id FROM catalogue)", "catalogue")
def s2(spark, sf_dir):
    items = catalogue(spark, sf_dir)
    wanted = spark.createDataFrame([("S2_1",), ("S2_2",), ("S2_x",)], "id string")
    have = items.join(wanted, "id", "left_semi").select("id", F.lit("found").alias("status"))
    return have.unionByName(wanted.join(items, "id", "left_anti").select("id", F.lit("missing").alias("status")))


@query("j2_semi_anti", "SELECT count(*) FILTER (EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')) AS semi, count(*) FILTER (NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')) AS anti FROM orders")
def j2(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    semi = o.join(c, "o_custkey", "left_semi").agg(F.count(F.lit(1)).alias("semi"))
    return semi.crossJoin(o.join(c, "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("anti")))


@query("r25_probe_flags", "SELECT id, v < 50 AS unusable, v >= 90 AS usable, cloud < 15 AND v < 50 AS disagree FROM (SELECT id, cloud, (cloud * 7) % 101 AS v FROM catalogue)", "catalogue")
def r25(spark, sf_dir):
    c = catalogue(spark, sf_dir).withColumn("v", F.col("cloud") * 7 % 101)
    return c.select("id", (F.col("v") < 50).alias("unusable"), (F.col("v") >= 90).alias("usable"), ((F.col("cloud") < 15) & (F.col("v") < 50)).alias("disagree"))


@query("j14_probe_default", "SELECT c.id, coalesce(p.v, -1) AS valid FROM catalogue c LEFT JOIN (SELECT id, cloud AS v FROM catalogue WHERE cloud < 50) p USING (id)", "catalogue")
def j14(spark, sf_dir):
    c = catalogue(spark, sf_dir)
    p = c.where("cloud < 50").select("id", F.col("cloud").alias("v"))
    return c.join(p, "id", "left").select("id", F.coalesce("v", F.lit(-1)).alias("valid"))


@query("g29_frame_counts", "SELECT count(v) AS frames, count(*) FILTER (v > 50) AS nodata, count(*) FILTER (v IS NULL OR v >= 50) AS shown FROM (SELECT nullif(cloud, 13) AS v FROM catalogue)", "catalogue")
def g29(spark, sf_dir):
    v = catalogue(spark, sf_dir).select(F.nullif(F.col("cloud"), F.lit(13)).alias("v"))
    return v.agg(F.count("v").alias("frames"), F.count_if(F.col("v") > 50).alias("nodata"), F.count_if(F.col("v").isNull() | (F.col("v") >= 50)).alias("shown"))


@query("p12_frame_width", "SELECT id, CASE WHEN v IS NULL OR v >= 50 THEN 900 ELSE 500 END AS width FROM (SELECT id, nullif(cloud, 13) AS v FROM catalogue)", "catalogue")
def p12(spark, sf_dir):
    v = F.nullif(F.col("cloud"), F.lit(13))
    return catalogue(spark, sf_dir).select("id", F.when(v.isNull() | (v >= 50), 900).otherwise(500).alias("width"))


@query("f17_cache_key", "SELECT id, substr(sha256(id || '|' || cloud), 1, 16) AS key FROM catalogue", "catalogue")
def f17(spark, sf_dir):
    return catalogue(spark, sf_dir).select("id", F.substring(F.sha2(F.concat_ws("|", "id", "cloud"), 256), 1, 16).alias("key"))


@query("f27_item_summary", "SELECT strftime(datetime, '%Y-%m-%d') || '  ' || lpad(cloud::VARCHAR, 3, ' ') || '%  ' || id AS line FROM catalogue", "catalogue")
def f27(spark, sf_dir):
    return catalogue(spark, sf_dir).select(F.format_string("%s  %3d%%  %s", F.date_format("datetime", "yyyy-MM-dd"), "cloud", "id").alias("line"))


# --- orbits ----------------------------------------------------------------
_WINDOW = r"_(\d{8}T\d{6})_(\d{8}T\d{6})_"
_PARSED_SQL = r"""WITH p AS (SELECT key, coverage, strptime(regexp_extract(key, '_(\d{8}T\d{6})_(\d{8}T\d{6})_', 1), '%Y%m%dT%H%M%S') AS t0,
    strptime(regexp_extract(key, '_(\d{8}T\d{6})_(\d{8}T\d{6})_', 2), '%Y%m%dT%H%M%S') AS t1 FROM orbits WHERE contains(key, 'PRODUCT_aerosol_index')),
    g AS (SELECT key, coverage, strftime(t0, '%Y-%m-%d') AS day, abs((hour(t0) * 60 + minute(t0) + hour(t1) * 60 + minute(t1)) / 120::DOUBLE - 12) AS gap FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY gap, key) AS k FROM g)"""


def ranked(spark: SparkSession, sf_dir: str, variable: str = "PRODUCT_aerosol_index", parity: bool = True) -> DataFrame:
    """Orbits of a variable by day, nearest to noon first.

    ``parity`` averages hours of day, which puts an orbit over midnight near noon; otherwise the middle of
    the window is taken in time.
    """
    stamp = lambda g: F.to_timestamp(F.regexp_extract("key", _WINDOW, g), "yyyyMMdd'T'HHmmss")
    o = orbits(spark, sf_dir).where(F.col("key").contains(variable)).where(F.col("key").rlike(_WINDOW))
    o = o.withColumns({"t0": stamp(1), "t1": stamp(2)})
    minutes = lambda c: F.hour(c) * 60 + F.minute(c)
    of_day = (minutes("t0") + minutes("t1")) / F.lit(120.0)
    mid = F.timestamp_seconds((F.unix_timestamp("t0") + F.unix_timestamp("t1")) / 2)
    hours = of_day if parity else minutes(mid) / F.lit(60.0)
    o = o.withColumn("day", F.date_format("t0", "yyyy-MM-dd")).withColumn("gap", F.abs(hours - 12))
    return o.withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy("gap", "key")))


@query("f15_orbit_times", r"SELECT key, strptime(regexp_extract(key, '_(\d{8}T\d{6})_', 1), '%Y%m%dT%H%M%S') AS t0 FROM orbits", "orbits")
def f15(spark, sf_dir):
    return orbits(spark, sf_dir).select("key", F.to_timestamp(F.regexp_extract("key", _WINDOW, 1), "yyyyMMdd'T'HHmmss").alias("t0"))


@query("f16_date_prefix", "SELECT DISTINCT 'COGT/OFFL/L2/' || strftime(ts, '%Y/%m/%d') || '/' AS prefix FROM events")
def f16(spark, sf_dir):
    parts = F.split(F.date_format("ts", "yyyy-MM-dd"), "-")
    return read(spark, sf_dir, "events").select(F.concat(F.lit("COGT/OFFL/L2/"), F.array_join(parts, "/"), F.lit("/")).alias("prefix")).distinct()


@query("p11_variable_filter", "SELECT count(*) AS n FROM orbits WHERE contains(key, 'PRODUCT_aerosol_index')", "orbits")
def p11(spark, sf_dir):
    return orbits(spark, sf_dir).where(F.col("key").contains("PRODUCT_aerosol_index")).agg(F.count(F.lit(1)).alias("n"))


@query("r26_qa_key", r"SELECT key, regexp_replace(key, 'PRODUCT_[a-z0-9_]+_4326\.tif$', 'PRODUCT_qa_value_4326.tif') AS qa_key FROM orbits", "orbits")
def r26(spark, sf_dir):
    return orbits(spark, sf_dir).select("key", F.regexp_replace("key", r"PRODUCT_[a-z0-9_]+_4326\.tif$", "PRODUCT_qa_value_4326.tif").alias("qa_key"))


@query("j10_nearest_orbit", _PARSED_SQL + " SELECT day, key, round_even(gap, 6) AS gap FROM r WHERE k = 1", "orbits")
def j10(spark, sf_dir):
    return ranked(spark, sf_dir).where("k = 1").select("day", "key", F.bround("gap", 6).alias("gap"))


@query("t6_candidate_orbits", _PARSED_SQL + " SELECT day, k::INT AS k, key FROM r WHERE k <= 5", "orbits")
def t6(spark, sf_dir):
    return ranked(spark, sf_dir).where("k <= 5").select("day", "k", "key")


@query(
    "s20_orbit_fallback",
    _PARSED_SQL + " SELECT day, coalesce(arg_min(key, k) FILTER (coverage >= 20), arg_max(key, coverage * 1000 - k)) AS key FROM r WHERE k <= 5 GROUP BY day",
    "orbits",
)
def s20(spark, sf_dir):
    """The first of five candidates that covers 20 %, else the one that covers most."""
    near = ranked(spark, sf_dir).where("k <= 5")
    first = F.min_by("key", F.when(F.col("coverage") >= 20, F.col("k")))
    most = F.max_by("key", F.struct("coverage", -F.col("k")))
    return near.groupBy("day").agg(F.coalesce(first, most).alias("key"))


# --- fields ----------------------------------------------------------------
_BASE_SQL = "base AS (SELECT y, x, median(v) AS ref FROM swaths WHERE day < 8 GROUP BY y, x)"


def anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = swaths(spark, sf_dir)
    base = s.where("day < 8").groupBy("y", "x").agg(F.median("v").alias("ref"))
    return s.where("day >= 8").join(base, ["y", "x"]).withColumn("anom", F.col("v") - F.col("ref"))


@query("g20_temporal_median", f"WITH {_BASE_SQL} SELECT y, x, round_even(ref, 6) AS ref FROM base", "swaths")
def g20(spark, sf_dir):
    return swaths(spark, sf_dir).where("day < 8").groupBy("y", "x").agg(F.bround(F.median("v"), 6).alias("ref"))


_ANOM_SQL = f"WITH {_BASE_SQL}, a AS (SELECT s.*, v - ref AS anom FROM swaths s JOIN base USING (y, x) WHERE day >= 8)"


@query("g21_anomaly_peak", _ANOM_SQL + " SELECT day, y, x, round_even(anom, 6) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY anom DESC, y, x) AS k FROM a WHERE anom IS NOT NULL) WHERE k = 1", "swaths")
def g21(spark, sf_dir):
    best = F.max_by(F.struct("y", "x", "anom"), F.struct(F.col("anom"), -F.col("y"), -F.col("x"))).alias("b")
    return anomaly(spark, sf_dir).where("anom IS NOT NULL").groupBy("day").agg(best).select("day", "b.y", "b.x", F.bround("b.anom", 6).alias("peak"))


@query("g22_field_stats", "SELECT day, round_even(count(v) * 100.0::DOUBLE / count(*), 2) AS coverage, round_even(median(v), 5) AS median, round_even(quantile_cont(v, 0.99), 5) AS p99 FROM swaths GROUP BY day", "swaths")
def g22(spark, sf_dir):
    s = swaths(spark, sf_dir).select("day", "v")
    q = exact_quantiles(s, ["day"], {"v": [0.5, 0.99]}).select("day", F.bround(F.get("v", F.lit(0)), 5).alias("median"), F.bround(F.get("v", F.lit(1)), 5).alias("p99"))
    return s.groupBy("day").agg(F.bround(F.count("v") * 100.0 / F.count(F.lit(1)), 2).alias("coverage")).join(q, "day")


@query("r19_pixel_centre", "SELECT DISTINCT y, x, round_even(2.0 + (x + 0.5) * 0.02, 6)::DOUBLE AS lon, round_even(49.0 + (y + 0.5) * -0.03, 6)::DOUBLE AS lat FROM swaths", "swaths")
def r19(spark, sf_dir):
    lon, lat = geo.pixel_centre(F.col("y"), F.col("x"), ORIGIN, STEP)
    return swaths(spark, sf_dir).select("y", "x").distinct().select("y", "x", F.bround(lon, 6).alias("lon"), F.bround(lat, 6).alias("lat"))


_AT_SQL = "SELECT id, (lon - 2.53::DOUBLE) * 74 AS dx, (lat - 48.38::DOUBLE) * 111 AS dy FROM problems"


@query("r20_distance_bearing", f"SELECT id, round_even(sqrt(dx * dx + dy * dy), 4) AS km, round_even((degrees(atan2(dx, dy)) + 360) % 360, 3) AS bearing FROM ({_AT_SQL})", "problems")
def r20(spark, sf_dir):
    km, bearing = geo.equirect(F.col("lon"), F.col("lat"), *FIRE)
    return problems(spark, sf_dir).select("id", F.bround(km, 4).alias("km"), F.bround(bearing, 3).alias("bearing"))


@query("r21_planar_metres", "SELECT id, round_even(sqrt(pow((lon - 2.53::DOUBLE) * 111320 * cos(radians(48.38::DOUBLE)), 2) + pow((lat - 48.38::DOUBLE) * 111320, 2)), 3) AS metres FROM problems", "problems")
def r21(spark, sf_dir):
    m = geo.planar_metres(F.col("lat"), F.col("lon"), F.lit(FIRE[1]), F.lit(FIRE[0]))
    return problems(spark, sf_dir).select("id", F.bround(m, 3).alias("metres"))


def ring(spark: SparkSession) -> DataFrame:
    """The points of two circles around the fire, and the fire."""
    radii = spark.createDataFrame([(25,), (60,)], "radius int")
    points = radii.crossJoin(spark.createDataFrame([(45 * k,) for k in range(8)], "bearing int"))
    points = points.unionByName(spark.createDataFrame([(0, -1)], "radius int, bearing int"))
    b = F.radians(F.col("bearing"))
    lat = F.when(F.col("radius") > 0, FIRE[1] + F.col("radius") * F.cos(b) / 111).otherwise(FIRE[1])
    lon = F.when(F.col("radius") > 0, FIRE[0] + F.col("radius") * F.sin(b) / 74).otherwise(FIRE[0])
    return points.select("radius", "bearing", F.bround(lat, 6).alias("lat"), F.bround(lon, 6).alias("lon"))


_RING_SQL = """SELECT r AS radius, b AS bearing, round_even(48.38::DOUBLE + r * cos(radians(b)) / 111, 6) AS lat, round_even(2.53::DOUBLE + r * sin(radians(b)) / 74, 6) AS lon
    FROM (SELECT unnest([25, 60]) AS r), (SELECT unnest([0, 45, 90, 135, 180, 225, 270, 315]) AS b) UNION ALL SELECT 0, -1, 48.38::DOUBLE, 2.53::DOUBLE"""


@query("r22_ring_points", _RING_SQL)
def r22(spark, sf_dir):
    return ring(spark)


#: The swath days as hours at the ring's points: place k of the ring is cell column k.
_RING_FIELD_SQL = f"""WITH ring AS (SELECT *, row_number() OVER (ORDER BY radius, bearing) - 1 AS k FROM ({_RING_SQL})),
    d AS (SELECT radius, bearing, round_even(avg(CASE WHEN day < 5 THEN v END), 4) AS pre, round_even(avg(CASE WHEN day >= 5 THEN v END), 4) AS fire, max(CASE WHEN day >= 5 THEN v END) AS peak
          FROM ring JOIN swaths ON x = k GROUP BY radius, bearing)"""


def ring_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ring(spark).withColumn("x", (F.row_number().over(Window.orderBy("radius", "bearing")) - 1).cast("long"))
    met = swaths(spark, sf_dir).join(F.broadcast(points), "x")
    pre, fire = F.when(F.col("day") < 5, F.col("v")), F.when(F.col("day") >= 5, F.col("v"))
    out = met.groupBy("radius", "bearing").agg(F.bround(F.avg(pre), 4).alias("pre"), F.bround(F.avg(fire), 4).alias("fire"), F.max(fire).alias("peak"))
    return out.withColumn("delta", F.bround(F.col("fire") - F.col("pre"), 4))


@query("g23_ring_deltas", _RING_FIELD_SQL + " SELECT radius, bearing, pre, fire, peak, round_even(fire - pre, 4) AS delta FROM d", "swaths")
def g23(spark, sf_dir):
    return ring_deltas(spark, sf_dir)


@query("g24_ring_contrast", _RING_FIELD_SQL + """ SELECT round_even(avg(CASE WHEN radius > 0 AND bearing IN (225, 270) THEN round_even(fire - pre, 4) END), 6) AS downwind,
    round_even(avg(CASE WHEN radius > 0 AND bearing IN (45, 90) THEN round_even(fire - pre, 4) END), 6) AS upwind, round_even(avg(CASE WHEN radius > 0 THEN round_even(fire - pre, 4) END), 6) AS ring_mean FROM d""", "swaths")
def g24(spark, sf_dir):
    return contrast(ring_deltas(spark, sf_dir))


def contrast(deltas: DataFrame) -> DataFrame:
    """Means of the deltas downwind, upwind and around the ring.

    Deltas have four digits, so the mean of sixteen is a tie at six digits one time in four.  They are added as whole
    ten-thousandths and divided once: the mean is the same in any order, and a tie goes to the even digit.
    """
    units, b = F.round(F.col("delta") * 10000).cast("long"), F.col("bearing")

    def mean(c):
        some = F.when((F.col("radius") > 0) & c, units)
        return F.bround(F.sum(some) / (F.count(some) * 10000), 6)

    return deltas.agg(mean(b.isin(225, 270)).alias("downwind"), mean(b.isin(45, 90)).alias("upwind"), mean(F.lit(True)).alias("ring_mean"))


def smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields of one place each, joined by cell: height, quality, index."""
    s = swaths(spark, sf_dir)
    lh = s.where("day = 0").select("y", "x", (F.col("v") * 4000 + 1200).alias("lh"))
    qa = s.where("day = 1").select("y", "x", (F.col("v") + 0.6).alias("qa"))
    ai = s.where("day = 2").select("y", "x", (F.col("v") * 4 + 1).alias("ai"))
    return lh.join(qa, ["y", "x"]).join(ai, ["y", "x"])


_SMOKE_SQL = """smoke AS (SELECT a.y, a.x, a.v * 4000 + 1200 AS lh, b.v + 0.6::DOUBLE AS qa, c.v * 4 + 1 AS ai FROM swaths a JOIN swaths b ON a.y = b.y AND a.x = b.x JOIN swaths c ON a.y = c.y AND a.x = c.x
    WHERE a.day = 0 AND b.day = 1 AND c.day = 2), good AS (SELECT * FROM smoke WHERE lh IS NOT NULL AND qa >= 0.5 AND ai >= 1.0)"""


@query("j5_three_fields", "WITH " + _SMOKE_SQL + " SELECT count(*) AS n, count(lh) AS lh, count(qa) AS qa, count(ai) AS ai FROM smoke", "swaths")
def j5(spark, sf_dir):
    return smoke(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in ("lh", "qa", "ai")])


@query("p9_smoke_predicate", "WITH " + _SMOKE_SQL + " SELECT y, x FROM good", "swaths")
def p9(spark, sf_dir):
    return smoke(spark, sf_dir).where("lh IS NOT NULL AND qa >= 0.5 AND ai >= 1.0").select("y", "x")


@query(
    "g25_smoke_height",
    "WITH " + _SMOKE_SQL + """, p AS (SELECT lh, (2.0::DOUBLE + (x + 0.5::DOUBLE) * 0.02::DOUBLE - 2.53::DOUBLE) * 74 AS dx, (49.0::DOUBLE + (y + 0.5::DOUBLE) * -0.03::DOUBLE - 48.38::DOUBLE) * 111 AS dy FROM good)
    SELECT count(*) AS n_smoke, round_even(median(lh), 3) AS median_m, round_even(quantile_cont(lh, 0.25), 3) AS p25_m, round_even(quantile_cont(lh, 0.75), 3) AS p75_m, round_even(max(lh), 3) AS max_m,
    round_even(sum((lh > 1865)::INT) * 100.0::DOUBLE / count(*), 1) AS pct_above, count(*) FILTER (sqrt(dx * dx + dy * dy) <= 120) AS near,
    round_even((degrees(atan2(avg(CASE WHEN sqrt(dx * dx + dy * dy) <= 120 THEN sin(atan2(dx, dy)) END), avg(CASE WHEN sqrt(dx * dx + dy * dy) <= 120 THEN cos(atan2(dx, dy)) END))) + 360) % 360, 2) AS bearing,
    round_even(avg(CASE WHEN sqrt(dx * dx + dy * dy) <= 120 THEN sqrt(dx * dx + dy * dy) END), 3) AS mean_km FROM p""",
    "swaths",
)
def g25(spark, sf_dir):
    lon, lat = geo.pixel_centre(F.col("y"), F.col("x"), ORIGIN, STEP)
    km, bearing = geo.equirect(lon, lat, *FIRE)
    p = smoke(spark, sf_dir).where("lh IS NOT NULL AND qa >= 0.5 AND ai >= 1.0").select("lh", km.alias("km"), bearing.alias("b"))
    near = F.col("km") <= 120
    mean_bearing, _ = vector_mean(F.when(near, F.lit(1.0)), F.when(near, F.col("b")))
    q = exact_quantiles(p, [], {"lh": [0.25, 0.5, 0.75]}).select(*[F.bround(F.get("lh", F.lit(k)), 3).alias(n) for k, n in enumerate(("p25_m", "median_m", "p75_m"))])
    return q.crossJoin(p.agg(
        F.count(F.lit(1)).alias("n_smoke"), F.bround(F.max("lh"), 3).alias("max_m"),
        F.bround(R.percent_where(F.col("lh") > 1865), 1).alias("pct_above"), F.count_if(near).alias("near"), F.bround(mean_bearing, 2).alias("bearing"), F.bround(F.avg(F.when(near, F.col("km"))), 3).alias("mean_km"),
    ))


# --- grids -----------------------------------------------------------------
@query("r15_utm_zone", "SELECT id, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon * 30 - 90 + 180) / 6)::INT + 1)::INT AS epsg FROM problems", "problems")
def r15(spark, sf_dir):
    return problems(spark, sf_dir).select("id", geo.utm_epsg(F.col("lon") * 30 - 90, F.col("lat")).alias("epsg"))


@query("r16_grid_snap", "SELECT id, floor(lon * 1000 / 10) * 10 AS west, floor(lat * 1000 / 10) * 10 AS south, ceil((lon * 1000 + 333) / 10) * 10 AS east, ceil((lat * 1000 + 77) / 10) * 10 AS north, round_even((ceil((lon * 1000 + 333) / 10) * 10 - floor(lon * 1000 / 10) * 10) / 10, 0)::BIGINT AS width, round_even((ceil((lat * 1000 + 77) / 10) * 10 - floor(lat * 1000 / 10) * 10) / 10, 0)::BIGINT AS height FROM problems", "problems")
def r16(spark, sf_dir):
    x, y = F.col("lon") * 1000, F.col("lat") * 1000
    return problems(spark, sf_dir).select("id", *[c.alias(n) for n, c in geo.snapped(x, y, x + 333, y + 77, 10.0).items()])


@query("r17_point_to_pixel", "SELECT id, round_even((lon * 1000 - 2400) / 10, 6) AS col, round_even((48600 - lat * 1000) / 10, 6) AS row FROM problems", "problems")
def r17(spark, sf_dir):
    col, row = geo.to_pixel(F.col("lon") * 1000, F.col("lat") * 1000, 2400.0, 48600.0, 10.0)
    return problems(spark, sf_dir).select("id", F.bround(col, 6).alias("col"), F.bround(row, 6).alias("row"))


@query("r18_zoom_slice", "SELECT id, greatest(0, floor(col_f)::INT - 3)::INT AS c0, least(s, floor(col_f)::INT + 4)::INT AS c1 FROM problems, dims", "problems", "dims")
def r18(spark, sf_dir):
    s = side(spark, sf_dir)
    c = F.floor("col_f").cast("int")
    return problems(spark, sf_dir).select("id", F.greatest(F.lit(0), c - 3).alias("c0"), F.least(F.lit(s), c + 4).cast("int").alias("c1"))


@query("r24_block_id", "SELECT y, x, (floor(y * 10 / 1000::DOUBLE) * 100000 + floor(x * 10 / 1000::DOUBLE))::BIGINT AS block FROM px", "px")
def r24(spark, sf_dir):
    return pixels(spark, sf_dir).select("y", "x", geo.block_id(F.col("y"), F.col("x")).alias("block"))


@query("c4_utm_round_trip", f"SELECT id, round_even(x, 3) AS x, round_even(y, 3) AS y, true AS lon_ok, true AS lat_ok FROM ({geo.utm_forward_sql('problems', 31)})", "problems")
def c4(spark, sf_dir):
    """Forward and inverse projection; the error of the round trip is far below a pixel."""
    p = problems(spark, sf_dir)
    x, y = geo.utm_forward(F.col("lon"), F.col("lat"), 31)
    p = p.select("id", "lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = geo.utm_inverse(F.col("x"), F.col("y"), 31)
    return p.select("id", F.bround("x", 3).alias("x"), F.bround("y", 3).alias("y"), (F.abs(lon - F.col("lon")) < 1e-7).alias("lon_ok"), (F.abs(lat - F.col("lat")) < 1e-7).alias("lat_ok"))


#: Corners of a projected grid.
CORNERS = [(x, y) for x in (470000.0, 499780.0) for y in (5350000.0, 5375000.0)]
_CORNERS_SQL = " UNION ALL ".join(f"SELECT {x}::DOUBLE AS x, {y}::DOUBLE AS y" for x, y in CORNERS)


@query(
    "k9_grid_bounds",
    f"""SELECT round_even(min(lon), 5) AS west, round_even(min(lat), 5) AS south, round_even(max(lon), 5) AS east, round_even(max(lat), 5) AS north
    FROM ({geo.utm_inverse_sql(f"({_CORNERS_SQL})", 31)})""",
)
def k9(spark, sf_dir):
    """Geographic bounds of a projected grid, from its four corners."""
    lon, lat = geo.utm_inverse(F.col("x"), F.col("y"), 31)
    p = spark.createDataFrame(CORNERS, "x double, y double").select(lon.alias("lon"), lat.alias("lat"))
    return p.agg(*[F.bround(f(c), 5).alias(n) for n, f, c in (("west", F.min, "lon"), ("south", F.min, "lat"), ("east", F.max, "lon"), ("north", F.max, "lat"))])
