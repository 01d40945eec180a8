"""Resampling, scenes, re-reads of own outputs and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import raster as R
from ..operators import morphology as M, resample, sampling
from ..operators.quantiles import exact_quantiles
from ..scratch import scratch_path
from ..sources import sinks
from ..sources.derived import catalogue, dense, hourly, pixels, problems
from .feature_plans import CIRCUITS_SQL, dictionary, sampled
from .raster_plans import delta
from .registry import query


@query(
    "s3_bilinear_read",
    """WITH t AS (SELECT id, row_f - 0.5 AS r, col_f - 0.5 AS c FROM problems),
    k AS (SELECT id, floor(r)::BIGINT + a AS y, floor(c)::BIGINT + b AS x, r, c FROM t, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
    w AS (SELECT id, y, x, (1 - abs(r - y)) * (1 - abs(c - x)) AS w FROM k)
    SELECT id, round_even(sum(w * nir_pre) / sum(w), 9) AS nir FROM w JOIN px USING (y, x) WHERE w > 0 AND nir_pre IS NOT NULL GROUP BY id""",
    "problems", "px",
)
def s3(spark, sf_dir):
    grid = pixels(spark, sf_dir).select("y", "x", F.col("nir_pre").alias("nir"))
    return resample.bilinear(problems(spark, sf_dir), grid, "nir", ["id"]).select("id", F.bround("nir", 9).alias("nir"))


@query("s4_nearest_read", "SELECT id, scl_pre AS scl FROM problems JOIN px ON y = floor(row_f) AND x = floor(col_f)", "problems", "px")
def s4(spark, sf_dir):
    grid = pixels(spark, sf_dir).select("y", "x", F.col("scl_pre").alias("scl"))
    return resample.nearest(problems(spark, sf_dir), grid, "scl", ["id"])


@query(
    "s5_scene_round_trip",
    """SELECT fuel::VARCHAR AS scene_id, count(*) AS n, sum(scl_pre)::BIGINT AS scl, any_value(document) AS document, 0 AS again FROM px JOIN (
        SELECT fuel AS f, '{"pixels":' || sum(n)::BIGINT || ',"scl_pct":{' || string_agg('"' || scl_pre || '":' || round_even(n * 100.0::DOUBLE / t, 2), ',' ORDER BY scl_pre) || '}}' AS document
        FROM (SELECT fuel, scl_pre, count(*) AS n, sum(count(*)) OVER (PARTITION BY fuel) AS t FROM px GROUP BY fuel, scl_pre) GROUP BY fuel) ON f = fuel GROUP BY fuel""",
    "px",
)
def s5(spark, sf_dir):
    """Scenes are written partitioned and tile-sorted with their sidecars, those at hand are skipped, and all are read back."""
    path = scratch_path(spark, "scenes")
    scenes = pixels(spark, sf_dir).withColumn("scene_id", F.col("fuel").cast("string"))
    bands = ["nir_pre", "swir_pre", "red_pre"]
    sinks.write_scenes_once(scenes.where("fuel < 2"), path, "scl_pre", bands)
    sinks.write_scenes_once(scenes, path, "scl_pre", bands)
    again = sinks.write_scenes_once(scenes, path, "scl_pre", bands)
    back = spark.read.parquet(f"{path}/scenes").groupBy(F.col("scene_id").cast("string").alias("scene_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("scl_pre").cast("long")).alias("scl"))
    sidecars = spark.read.schema("scene_id string, document string").json(f"{path}/sidecars")
    return back.join(sidecars, "scene_id").select("scene_id", "n", "scl", "document", F.lit(again).alias("again"))


@query("s6_scene_load", "SELECT y, x, nir_pre FROM px WHERE fuel = 2", "px")
def s6(spark, sf_dir):
    path = scratch_path(spark, "scenes")
    sinks.write_scene(pixels(spark, sf_dir).withColumn("scene_id", F.col("fuel").cast("string")), path)
    return spark.read.parquet(path).where("scene_id = 2").select("y", "x", "nir_pre")


@query("s24_reread_outputs", "SELECT ts, temp, wind FROM hourly", "hourly")
def s24(spark, sf_dir):
    path = scratch_path(spark, "csv")
    sinks.write_csv(hourly(spark, sf_dir).select("ts", "temp", "wind"), path)
    return spark.read.schema("ts timestamp, temp double, wind double").option("header", True).csv(path)


@query("k1_csv_table", "SELECT id, name, colour FROM problems", "problems")
def k1(spark, sf_dir):
    path = scratch_path(spark, "csv")
    sinks.write_csv(problems(spark, sf_dir).select("id", "name", "colour"), path)
    return spark.read.schema("id long, name string, colour string").option("header", True).csv(path)


@query("f11_date_prefix", "SELECT id, substr(strftime(datetime, '%Y-%m-%dT%H:%M:%S'), 1, 10) AS day FROM catalogue", "catalogue")
def f11(spark, sf_dir):
    return catalogue(spark, sf_dir).select("id", F.substring(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss"), 1, 10).alias("day"))


@query("f24_array_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best, len(list_filter(embedding, lambda v: v > 0)) AS positive FROM embeddings")
def f24(spark, sf_dir):
    from ..sources.tables import read

    e = read(spark, sf_dir, "embeddings")
    best = F.array_position("embedding", F.array_max("embedding")) - 1
    return e.select("vec_id", best.alias("best"), F.size(F.filter("embedding", lambda v: v > 0)).cast("long").alias("positive"))


@query(
    "g30_terrain_stats",
    """SELECT label, round_even(min(v), 6) AS low, round_even(max(v), 6) AS high, round_even(median(v), 6) AS median, round_even(quantile_cont(v, 0.99), 6) AS p99,
    round_even(sum((v >= 0.2::DOUBLE)::INT) * 100.0::DOUBLE / count(*), 3) AS share FROM dense GROUP BY label""",
    "dense",
)
def g30(spark, sf_dir):
    r = lambda c: F.bround(c, 6)
    cells = dense(spark, sf_dir).select("label", "v")
    out = cells.groupBy("label").agg(r(F.min("v")).alias("low"), r(F.max("v")).alias("high"), F.bround(R.percent_where(F.col("v") >= 0.2), 3).alias("share"))
    q = exact_quantiles(cells, ["label"], {"v": [0.5, 0.99]}).select("label", r(F.get("v", F.lit(0))).alias("median"), r(F.get("v", F.lit(1))).alias("p99"))
    return out.join(q, "label")


@query("g33_distinct_count", "SELECT fuel, count(DISTINCT scl_pre) AS codes FROM px GROUP BY fuel", "px")
def g33(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("fuel").agg(F.countDistinct("scl_pre").alias("codes"))


@query(
    "a7_distance_to_burn",
    """WITH m AS (SELECT y, x, coalesce(dnbr >= 0.66, false) AS m FROM delta)
    SELECT a.y, a.x, round_even(sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))::DOUBLE) * 10, 6) AS distance FROM m a LEFT JOIN m b ON b.m GROUP BY a.y, a.x""",
    "delta",
)
def a7b(spark, sf_dir):
    """Metres from every pixel to the nearest of high severity."""
    burned = delta(spark, sf_dir).select("y", "x", R.at_least(F.col("dnbr"), 0.66).alias("m"))
    return M.distance(burned, 10.0).select("y", "x", F.bround("distance", 6).alias("distance"))


@query("s19_field_frame", "SELECT id, greatest(1, round_even(400 * (0.3::DOUBLE + (id % 7) / 10::DOUBLE) / (0.5::DOUBLE + (id % 3) / 10::DOUBLE), 0)::INT) AS height FROM problems", "problems")
def s19(spark, sf_dir):
    """Rows of a geographic field of 400 columns, from the box's shape."""
    tall, wide = 0.3 + (F.col("id") % 7) / F.lit(10.0), 0.5 + (F.col("id") % 3) / F.lit(10.0)
    return problems(spark, sf_dir).select("id", F.greatest(F.lit(1), F.bround(400 * tall / wide).cast("int")).alias("height"))


#: The frame of a field that is read over a box: columns, and the box in cells of the dense raster.
FRAME, FIELD_BOX = 400, (2.0, 3.0, 34.0, 19.0)


@query(
    "s19_field_read",
    f"""WITH f AS (SELECT {FRAME} AS w, greatest(1, round_even({FRAME} * ({FIELD_BOX[3]} - {FIELD_BOX[1]})::DOUBLE / ({FIELD_BOX[2]} - {FIELD_BOX[0]})::DOUBLE, 0)::INT) AS h),
    t AS (SELECT r AS row, c AS col, {FIELD_BOX[1]}::DOUBLE + (r + 0.5::DOUBLE) * {FIELD_BOX[3] - FIELD_BOX[1]}::DOUBLE / h - 0.5::DOUBLE AS a, {FIELD_BOX[0]}::DOUBLE + (c + 0.5::DOUBLE) * {FIELD_BOX[2] - FIELD_BOX[0]}::DOUBLE / w - 0.5::DOUBLE AS b
        FROM f, (SELECT unnest(range(0, {FRAME})) AS r), (SELECT unnest(range(0, {FRAME})) AS c) WHERE r < h),
    k AS (SELECT row, col, floor(a)::BIGINT + i AS y, floor(b)::BIGINT + j AS x, a, b FROM t, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
    w AS (SELECT row, col, y, x, (1 - abs(a - y)) * (1 - abs(b - x)) AS w FROM k)
    SELECT row, col, round_even(sum(w * v) / sum(w), 7) AS v FROM w JOIN dense USING (y, x) WHERE w > 0 AND v IS NOT NULL GROUP BY row, col""",
    "dense",
)
def s19r(spark, sf_dir):
    """A field read bilinearly over a box, at the frame that the box's shape gives."""
    west, north, east, south = FIELD_BOX
    height = max(1, round(FRAME * (south - north) / (east - west)))
    cells = spark.range(height * FRAME).select(F.floor(F.col("id") / FRAME).alias("row"), (F.col("id") % FRAME).alias("col"))
    places = cells.select(
        "row", "col", (F.lit(north) + (F.col("row") + 0.5) * (south - north) / F.lit(height)).alias("row_f"), (F.lit(west) + (F.col("col") + 0.5) * (east - west) / F.lit(FRAME)).alias("col_f")
    )
    return resample.bilinear(places, dense(spark, sf_dir), "v", ["row", "col"]).select("row", "col", F.bround("v", 7).alias("v"))


@query("s21_tile_counts", "SELECT 'N' || lpad(floor(lat)::INT::VARCHAR, 2, '0') || '_E' || lpad(floor(lon)::INT::VARCHAR, 3, '0') AS tile, count(*) AS n FROM problems GROUP BY 1", "problems")
def s21(spark, sf_dir):
    """Elevation tiles that the features need, by the whole degrees below them."""
    return problems(spark, sf_dir).groupBy(tile_name(F.col("lat"), F.col("lon")).alias("tile")).agg(F.count(F.lit(1)).alias("n"))


def tile_name(lat, lon):
    """Tiles are named after the whole degrees below a place, with its hemispheres."""
    return F.format_string("%s%02d_%s%03d", F.when(lat >= 0, "N").otherwise("S"), F.abs(F.floor(lat)).cast("int"), F.when(lon >= 0, "E").otherwise("W"), F.abs(F.floor(lon)).cast("int"))


_TILES_SQL = """tiles AS (SELECT 'N' || lpad(n::VARCHAR, 2, '0') || '_E' || lpad(e::VARCHAR, 3, '0') AS tile, y, x, v * 1000 + n * 10 + e AS height
    FROM dense, (SELECT unnest([48, 49]) AS n), (SELECT unnest([2, 3]) AS e))"""


@query(
    "s21_tile_read",
    f"""WITH {_TILES_SQL}, p AS (SELECT id, 'N' || lpad(floor(lat)::INT::VARCHAR, 2, '0') || '_E' || lpad(floor(lon)::INT::VARCHAR, 3, '0') AS tile, floor((floor(lat) + 1 - lat) * 64)::BIGINT AS y, floor((lon - floor(lon)) * 64)::BIGINT AS x FROM problems)
    SELECT id, tile, round_even(height, 4) AS height FROM p JOIN tiles USING (tile, y, x)""",
    "problems", "dense",
)
def s21r(spark, sf_dir):
    """Heights at the features, from the tiles that their places name: tiles are read by name, so others are never opened."""
    path = scratch_path(spark, "tiles")
    degrees = spark.createDataFrame([(n, e) for n in (48, 49) for e in (2, 3)], "n int, e int")
    height = (F.col("v") * 1000 + F.col("n") * 10 + F.col("e")).alias("height")
    tiles = dense(spark, sf_dir).crossJoin(F.broadcast(degrees)).select("y", "x", height, F.format_string("N%02d_E%03d", "n", "e").alias("tile"))
    tiles.repartition("tile").write.partitionBy("tile").parquet(path)
    lat, lon = F.col("lat"), F.col("lon")
    at = problems(spark, sf_dir).select("id", tile_name(lat, lon).alias("tile"), F.floor((F.floor(lat) + 1 - lat) * 64).alias("y"), F.floor((lon - F.floor(lon)) * 64).alias("x"))
    return at.join(spark.read.parquet(path), ["tile", "y", "x"]).select("id", "tile", F.bround("height", 4).alias("height"))


@query(
    "s12_landed_pages",
    """WITH c AS (SELECT c_custkey AS id, (c_custkey // 97)::INT AS page FROM customer), filled AS (SELECT page FROM c GROUP BY page HAVING count(*) = 97),
    e AS (SELECT min(p) AS last, max(top) AS top FROM (SELECT unnest(range(0, top + 2)) AS p, top FROM (SELECT max(page) AS top FROM c)) WHERE p NOT IN (SELECT page FROM filled))
    SELECT id, page, top < last AS truncated FROM c, e WHERE page <= last""",
)
def s12(spark, sf_dir):
    """Features of landed pages of 97, up to the first short page."""
    from ..sources import readers
    from ..sources.tables import read

    c = read(spark, sf_dir, "customer").withColumn("page", F.floor(F.col("c_custkey") / 97).cast("int"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("c_custkey").alias("id")).alias("properties"))
    pages = c.groupBy("page").agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value"))
    return readers.landed_pages(pages, 97).select(F.get_json_object("feature", "$.properties.id").cast("long").alias("id"), "page", "truncated")


_TOP_SQL = """SELECT area_name, colour, problems, round_even(pct_burned, 1) AS pct, round_even(dnbr_median, 3) AS med,
    row_number() OVER (ORDER BY pct_burned DESC, dnbr_median DESC, area_name, colour) AS place FROM circuits QUALIFY place <= 16"""


@query(
    "k14_page_rows",
    f"""WITH circuits AS ({CIRCUITS_SQL}), top AS ({_TOP_SQL}), codes AS (SELECT area_name AS area, row_number() OVER (ORDER BY min(id)) - 1 AS code FROM problems WHERE area_name IS NOT NULL GROUP BY area_name),
    html AS (SELECT '<table>' || string_agg('<tr><td>' || replace(area_name, '&', '&amp;') || '</td><td>' || colour || '</td><td>' || problems || '</td><td>' || pct || '</td><td>' || med || '</td></tr>', '' ORDER BY place) || '</table>' AS t FROM top),
    doc AS (SELECT '{{"names":[' || (SELECT string_agg('"' || area || '"', ',' ORDER BY code) FROM codes) || '],"points":[' || string_agg('[' || id || ',' || coalesce(code, -1) || ',' || coalesce((round_even(dnbr_median, 3) + 0::DOUBLE)::VARCHAR, 'null') || ']', ',' ORDER BY id) || ']}}' AS d
        FROM sampled LEFT JOIN codes ON codes.area = area_name WHERE in_aoi)
    SELECT t AS html, d AS points, strlen(t) AS html_bytes, strlen(d) AS points_bytes FROM html, doc""",
    "sampled",
)
def k14(spark, sf_dir):
    """A page's parts: the table of the sixteen most burned circuits, escaped; the points with names by code; their sizes."""
    from ..functions.text import html_escape

    features = sampled(spark, sf_dir)
    top = sampling.circuits(features).orderBy(F.desc("pct_burned"), F.desc("dnbr_median"), "area_name", "colour").limit(16)
    # unlike bround, this keeps the sign of what rounds to zero: the table says -0.0, as its SQL does
    median = F.rint(F.col("dnbr_median") * 1000) / 1000
    cell = lambda *parts: F.concat(*[F.concat(F.lit("<td>"), p, F.lit("</td>")) for p in parts])
    row = F.concat(F.lit("<tr>"), cell(html_escape(F.col("area_name")), F.col("colour"), F.col("problems"), F.bround("pct_burned", 1), median), F.lit("</tr>"))
    order = F.struct((-F.col("pct_burned")).alias("a"), (-F.col("dnbr_median")).alias("b"), "area_name", "colour", row.alias("row"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda r: r["row"]), "")
    html = top.agg(F.concat(F.lit("<table>"), joined(order), F.lit("</table>")).alias("html"))
    p = problems(spark, sf_dir)
    codes = dictionary(p)
    names = codes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "area_name"))), lambda r: F.concat(F.lit('"'), r["area_name"], F.lit('"'))), ",").alias("names"))
    coded = features.where("in_aoi").join(codes, "area_name", "left").select("id", F.coalesce("code", F.lit(-1)).alias("code"), F.bround("dnbr_median", 3).alias("dnbr"))
    point = F.concat(F.lit("["), F.concat_ws(",", "id", "code", sinks.json_value(coded, "dnbr")), F.lit("]"))
    points = coded.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", point.alias("row")))), lambda r: r["row"]), ",").alias("rows"))
    document = F.concat(F.lit('{"names":['), F.col("names"), F.lit('],"points":['), F.col("rows"), F.lit("]}"))
    out = html.crossJoin(names).crossJoin(points).select("html", document.alias("points"))
    return out.withColumns({"html_bytes": F.octet_length("html").cast("long"), "points_bytes": F.octet_length("points").cast("long")})
