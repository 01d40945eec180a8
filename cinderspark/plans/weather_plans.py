"""Fire weather plans: rolling rain, the index, ranks, winds, spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, raster as R, weather as fw
from ..operators import fireweather as ops, morphology as M
from ..scratch import staged
from ..sources.derived import hourly
from ..sources.tables import read
from .raster_plans import delta
from .registry import query
from .shape_plans import LABELS_SQL, NEAR4, dilate_sql, erode_sql, reach_sql


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fire_weather_index(ops.noon_rows(stations(spark, sf_dir), ["station"]))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly record with its station: there is one."""
    return hourly(spark, sf_dir).withColumn("station", F.lit(1))


NOON_SQL = """SELECT ts, temp, rh, wind, rain24, row_number() OVER (ORDER BY ts) AS k FROM (
    SELECT *, sum(precip) OVER (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS rain24 FROM hourly) WHERE hour(ts) = 11"""

#: The index as a recursive query: one step a day.
FWI_SQL = f"""WITH RECURSIVE noon AS ({NOON_SQL}),
le AS (SELECT [6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0]::DOUBLE[] AS le, [-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6]::DOUBLE[] AS lf),
days AS (
    SELECT 0::BIGINT AS k, NULL::TIMESTAMP AS ts, 0::DOUBLE AS temp, 0::DOUBLE AS rh, 0::DOUBLE AS wind, 0::DOUBLE AS rain, 85::DOUBLE AS ffmc, 6::DOUBLE AS dmc, 15::DOUBLE AS dc
    UNION ALL
    SELECT k, ts, temp, rh, wind, rain, 59.5 * (250 - m) / (147.2 + m),
        dm0 + 1.894e-4 * (greatest(temp, -1.1) + 1.1) * (100 - rh) * le[month(ts)],
        greatest(dr0 + 0.5 * greatest(0.36 * (greatest(temp, -2.8) + 2.8) + lf[month(ts)], 0), 0)
    FROM (
        SELECT *, CASE WHEN mo > ed THEN ed + (mo - ed) * pow(10, -(0.424 * (1 - pow(rh / 100, 1.7)) + 0.0694 * sqrt(wind) * (1 - pow(rh / 100, 8))) * 0.581 * exp(0.0365 * temp))
            WHEN mo < ew THEN ew - (ew - mo) * pow(10, -(0.424 * (1 - pow((100 - rh) / 100, 1.7)) + 0.0694 * sqrt(wind) * (1 - pow((100 - rh) / 100, 8))) * 0.581 * exp(0.0365 * temp))
            ELSE mo END AS m
        FROM (
            SELECT *, CASE WHEN rain > 0.5 THEN least(mp + 42.5 * (rain - 0.5) * exp(-100 / (251 - mp)) * (1 - exp(-6.93 / (rain - 0.5)))
                    + CASE WHEN mp > 150 THEN 0.0015 * pow(mp - 150, 2) * sqrt(rain - 0.5) ELSE 0 END, 250) ELSE mp END AS mo,
                0.942 * pow(rh, 0.679) + 11 * exp((rh - 100) / 10) + 0.18 * (21.1 - temp) * (1 - exp(-0.115 * rh)) AS ed,
                0.618 * pow(rh, 0.753) + 10 * exp((rh - 100) / 10) + 0.18 * (21.1 - temp) * (1 - exp(-0.115 * rh)) AS ew,
                CASE WHEN rain > 1.5 THEN greatest(0, 244.72 - 43.43 * ln(20 + exp(5.6348 - dmc / 43.43) + 1000 * (0.92 * rain - 1.27) / (48.77
                    + (CASE WHEN dmc <= 33 THEN 100 / (0.5 + 0.3 * dmc) WHEN dmc <= 65 THEN 14 - 1.3 * ln(dmc) ELSE 6.2 * ln(dmc) - 17.2 END) * (0.92 * rain - 1.27)) - 20)) ELSE dmc END AS dm0,
                CASE WHEN rain > 2.8 THEN greatest(dc - 400 * ln(1 + 3.937 * (0.83 * rain - 1.27) / (800 * exp(-dc / 400))), 0) ELSE dc END AS dr0
            FROM (SELECT n.k, n.ts, n.temp, least(greatest(n.rh, 0), 100) AS rh, n.wind, n.rain24 AS rain, d.ffmc, d.dmc, d.dc, le, lf,
                    147.2 * (101 - d.ffmc) / (59.5 + d.ffmc) AS mp FROM days d JOIN noon n ON n.k = d.k + 1, le)
        )
    )
),
indices AS (SELECT *, 19.1152 * exp(0.05039 * wind) * exp(-0.1386 * mf) * (1 + pow(mf, 5.31) / 4.93e7) AS isi FROM (SELECT *, 147.2 * (101 - ffmc) / (59.5 + ffmc) AS mf FROM days WHERE k > 0)),
built AS (SELECT *, CASE WHEN dmc <= 0 AND dc <= 0 THEN 0 WHEN dmc <= 0.4 * dc THEN greatest(0.8 * dmc * dc / (dmc + 0.4 * dc), 0)
    ELSE greatest(dmc - (1 - 0.8 * dc / (dmc + 0.4 * dc)) * (0.92 + pow(0.0114 * dmc, 1.7)), 0) END AS bui FROM indices),
index AS (SELECT *, 0.1 * isi * CASE WHEN bui <= 80 THEN 0.626 * pow(bui, 0.809) + 2 ELSE 1000 / (25 + 108.64 * exp(-0.023 * bui)) END AS b FROM built),
fwi AS (SELECT date_trunc('day', ts)::TIMESTAMP AS date, round_even(rain, 2) AS rain24, round_even(ffmc, 2) AS ffmc, round_even(dmc, 2) AS dmc, round_even(dc, 2) AS dc, round_even(isi, 2) AS isi,
    round_even(bui, 2) AS bui, round_even(CASE WHEN b > 1 THEN exp(2.72 * pow(0.434 * ln(b), 0.647)) ELSE b END, 2) AS fwi FROM index)
"""


@query("w1_rolling_rain", "SELECT ts, round_even(sum(precip) OVER (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS rain24 FROM hourly", "hourly")
def w1(spark, sf_dir):
    return ops.rolling_rain(stations(spark, sf_dir), ["station"]).select("ts", F.bround("rain24", 6).alias("rain24"))


@query("w2_fwi", FWI_SQL + "SELECT date, rain24, ffmc, dmc, dc, isi, bui, fwi FROM fwi", "hourly")
def w2(spark, sf_dir):
    return daily(spark, sf_dir).select("date", "rain24", "ffmc", "dmc", "dc", "isi", "bui", "fwi")


@query("w3_top_days", FWI_SQL + "SELECT date, fwi FROM fwi ORDER BY fwi DESC, date LIMIT 8", "hourly")
def w3(spark, sf_dir):
    return daily(spark, sf_dir).orderBy(F.desc("fwi"), "date").limit(8).select("date", "fwi")


@query("r11_danger_class", FWI_SQL + """SELECT date, CASE WHEN fwi >= 0 AND fwi < 5.2 THEN 'very low' WHEN fwi >= 5.2 AND fwi < 11.2 THEN 'low' WHEN fwi >= 11.2 AND fwi < 21.3 THEN 'moderate'
    WHEN fwi >= 21.3 AND fwi < 38 THEN 'high' WHEN fwi >= 38 AND fwi < 50 THEN 'very high' ELSE 'extreme' END AS danger FROM fwi""", "hourly")
def r11(spark, sf_dir):
    return daily(spark, sf_dir).select("date", fw.danger_class(F.col("fwi")).alias("danger"))


@query(
    "g16_summer_mean_rank",
    """WITH m AS (SELECT year(o_orderdate)::INT AS year, round_even(sum(round_even(o_totalprice * 100, 0)::BIGINT) / count(*) / 100, 2) AS mean FROM orders WHERE month(o_orderdate) IN (6, 7, 8) GROUP BY 1)
    SELECT year, mean, ((SELECT count(*) FROM m b WHERE b.mean < a.mean) + 1)::BIGINT AS rank FROM m a""",
)
def g16(spark, sf_dir):
    """Mean of June to August by year, and the year's rank from the lowest; the record of many years is that of orders."""
    days = read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"))
    return ops.season_means(days, "date", "value")


@query("g17_percent_below", "SELECT round_even(avg((temp < t)::INT) * 100, 2) AS pct_below FROM hourly, (SELECT temp AS t FROM hourly ORDER BY ts DESC LIMIT 1)", "hourly")
def g17(spark, sf_dir):
    h = hourly(spark, sf_dir)
    return ops.share_below(h, "temp", h.orderBy(F.desc("ts")).limit(1))


@query("g18_vector_wind", "SELECT day(ts)::INT AS day, round_even((degrees(atan2(avg(wind * sin(radians(dir))), avg(wind * cos(radians(dir))))) + 360) % 360, 4) AS bearing, round_even(sqrt(pow(avg(wind * sin(radians(dir))), 2) + pow(avg(wind * cos(radians(dir))), 2)), 4) AS speed FROM hourly GROUP BY 1", "hourly")
def g18(spark, sf_dir):
    b, s = fw.vector_mean(F.col("wind"), F.col("dir"))
    return hourly(spark, sf_dir).groupBy(F.day("ts").alias("day")).agg(F.bround(b, 4).alias("bearing"), F.bround(s, 4).alias("speed"))


RUNS = [("night", 0, 5), ("morning", 6, 11), ("afternoon", 12, 17)]
_RUNS_SQL = "(SELECT * FROM (VALUES ('night', 0, 5), ('morning', 6, 11), ('afternoon', 12, 17)) r(run, first, last))"


@query("g19_max_gust", f"SELECT run, max(gust) AS gust FROM hourly JOIN {_RUNS_SQL} ON hour(ts) BETWEEN first AND last GROUP BY run", "hourly")
def g19(spark, sf_dir):
    runs = spark.createDataFrame(RUNS, "run string, first int, last int")
    met = hourly(spark, sf_dir).join(F.broadcast(runs), F.hour("ts").between(F.col("first"), F.col("last")))
    return met.groupBy("run").agg(F.max("gust").alias("gust"))


@query("j12_interval_join", f"SELECT run, count(*) AS n, round_even(sum(wind), 4) AS wind FROM hourly JOIN {_RUNS_SQL} ON hour(ts) BETWEEN first AND last GROUP BY run", "hourly")
def j12(spark, sf_dir):
    runs = spark.createDataFrame(RUNS, "run string, first int, last int")
    met = hourly(spark, sf_dir).join(F.broadcast(runs), F.hour("ts").between(F.col("first"), F.col("last")))
    return met.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum("wind"), 4).alias("wind"))


@query("j11_noon_lookup", "SELECT h.ts, h.temp - n.temp AS over_noon FROM hourly h JOIN hourly n ON n.ts = date_trunc('day', h.ts) + INTERVAL 11 HOUR", "hourly")
def j11(spark, sf_dir):
    h = hourly(spark, sf_dir)
    noon = h.where("hour(ts) = 11").select(F.date_trunc("day", "ts").alias("day"), F.col("temp").alias("noon"))
    return h.withColumn("day", F.date_trunc("day", "ts")).join(noon, "day").select("ts", (F.col("temp") - F.col("noon")).alias("over_noon"))


@query("j13_class_by_range", "SELECT danger, count(*) AS n FROM (SELECT CASE WHEN wind < 5.2 THEN 'very low' WHEN wind < 11.2 THEN 'low' WHEN wind < 21.3 THEN 'moderate' WHEN wind < 38 THEN 'high' WHEN wind < 50 THEN 'very high' ELSE 'extreme' END AS danger FROM hourly) GROUP BY danger", "hourly")
def j13(spark, sf_dir):
    return hourly(spark, sf_dir).groupBy(fw.danger_class(F.col("wind")).alias("danger")).agg(F.count(F.lit(1)).alias("n"))


@query("p7_time_slice", "SELECT count(*) AS n FROM hourly WHERE ts >= (SELECT date_trunc('day', min(ts)) FROM hourly) + INTERVAL 1 DAY AND ts < (SELECT date_trunc('day', min(ts)) FROM hourly) + INTERVAL 4 DAY", "hourly")
def p7(spark, sf_dir):
    h = hourly(spark, sf_dir)
    first = h.agg(F.date_trunc("day", F.min("ts")).alias("d"))
    both = h.crossJoin(F.broadcast(first))
    return both.where((F.col("ts") >= F.col("d") + F.expr("INTERVAL 1 DAY")) & (F.col("ts") < F.col("d") + F.expr("INTERVAL 4 DAYS"))).agg(F.count(F.lit(1)).alias("n"))


@query("p8_calendar_filter", "SELECT ts FROM hourly WHERE hour(ts) = 11 AND month(ts) IN (1, 6, 7, 8)", "hourly")
def p8(spark, sf_dir):
    return hourly(spark, sf_dir).where(F.month("ts").isin(1, 6, 7, 8) & (F.hour("ts") == 11)).select("ts")


@query("s16_dedupe_keep_first", "SELECT ts, event_id FROM (SELECT date_trunc('hour', ts) AS ts, event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) AS k FROM events) WHERE k = 1")
def s16(spark, sf_dir):
    from ..sources.readers import first_of_duplicates

    e = read(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("ts"), "event_id")
    return first_of_duplicates(e, ["ts"], "event_id")


@query("u3_concat_parts", "SELECT event_type, count(*) AS n FROM (SELECT * FROM events WHERE event_id % 2 = 0 UNION ALL SELECT * FROM events WHERE event_id % 2 = 1) GROUP BY event_type")
def u3(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.where("event_id % 2 = 0").unionByName(e.where("event_id % 2 = 1")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("f23_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, month(ts)::INT AS month, hour(ts)::INT AS hour, date_trunc('day', ts)::TIMESTAMP AS midnight FROM events")
def f23(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.month("ts").alias("month"), F.hour("ts").alias("hour"), F.date_trunc("day", "ts").alias("midnight"))


#: Sectors are components of the closed scar; what one must have burned, in pixels, and on each of its two fronts.
SECTOR_CLOSE, SECTOR_PX, FRONT_PX = 1, 5, 2
SPREAD_SQL = f"""WITH RECURSIVE m AS (SELECT y, x, coalesce(dnbr >= 0.27, false) AS m FROM delta), {dilate_sql("m", SECTOR_CLOSE, "d")}, {erode_sql("d", SECTOR_CLOSE, "c")},
    {reach_sql("c", NEAR4, "reach")}, {LABELS_SQL},
    b AS (SELECT label, y, x, coalesce(dnbr >= 0.27, false) AS burned, ok FROM l JOIN delta USING (y, x)),
    v AS (SELECT label AS sector, count(*) AS closed_px, count(*) FILTER (burned) AS n, count(*) FILTER (burned AND ok) AS n_early, count(*) FILTER (burned AND NOT ok) AS n_late,
        sum(CASE WHEN burned AND NOT ok THEN y END) / count(*) FILTER (burned AND NOT ok) - sum(CASE WHEN burned AND ok THEN y END) / count(*) FILTER (burned AND ok) AS dr,
        sum(CASE WHEN burned AND NOT ok THEN x END) / count(*) FILTER (burned AND NOT ok) - sum(CASE WHEN burned AND ok THEN x END) / count(*) FILTER (burned AND ok) AS dc FROM b GROUP BY label)
    SELECT sector, closed_px, n AS burned_px, n_early, n_late, round_even((degrees(atan2(dc, -dr)) + 360) % 360, 3) AS bearing, round_even(sqrt(dr * dr + dc * dc) * 10, 3) AS metres
    FROM v WHERE n >= {SECTOR_PX} AND n_early >= {FRONT_PX} AND n_late >= {FRONT_PX}"""


@query("g26_spread_vector", SPREAD_SQL, "delta")
def g26(spark, sf_dir):
    """How far and which way each sector's late pixels lie from its early ones; sectors are components of the closed scar."""
    px = staged(delta(spark, sf_dir).select("y", "x", R.at_least(F.col("dnbr")).alias("m"), "ok"), "scar")
    cells = M.label(M.close(px.select("y", "x", "m"), SECTOR_CLOSE)).withColumnRenamed("label", "sector")
    both = cells.join(px, ["y", "x"]).select("sector", "y", "x", "m", (F.col("m") & F.col("ok")).alias("early"), (F.col("m") & ~F.col("ok")).alias("late"))
    mean = lambda c, w: F.sum(F.when(F.col(w), F.col(c))) / F.nullif(F.count_if(F.col(w)), F.lit(0))
    v = both.groupBy("sector").agg(
        F.count(F.lit(1)).alias("closed_px"), F.count_if("m").alias("burned_px"), F.count_if("early").alias("n_early"), F.count_if("late").alias("n_late"),
        (mean("y", "late") - mean("y", "early")).alias("dr"), (mean("x", "late") - mean("x", "early")).alias("dc"),
    )
    v = v.where((F.col("burned_px") >= SECTOR_PX) & (F.col("n_early") >= FRONT_PX) & (F.col("n_late") >= FRONT_PX))
    return v.select("sector", "closed_px", "burned_px", "n_early", "n_late", F.bround(geo.compass(F.col("dc"), -F.col("dr")), 3).alias("bearing"), F.bround(F.hypot("dr", "dc") * 10, 3).alias("metres"))


@query("r23_angles", "SELECT ts, (dir + 180) % 360 AS opposite, abs((dir - 50 + 180 + 360) % 360 - 180) AS diff FROM hourly", "hourly")
def r23(spark, sf_dir):
    return hourly(spark, sf_dir).select("ts", geo.opposite(F.col("dir")).alias("opposite"), geo.angle_between(F.col("dir"), F.lit(50.0)).alias("diff"))
