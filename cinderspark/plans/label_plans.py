"""Map labels, text scalars, models, sources and sinks in landed formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import labels as L, validation as V
from ..operators.ranking import global_rank
from ..sources import readers
from ..sources.derived import pixels, places
from ..sources.sinks import payload, points_document
from ..sources.tables import read
from .raster_plans import delta
from .registry import query

_KEY = r"regexp_replace(lower(name), '[^\p{L}\p{N}]', '', 'g')"
_POP = "coalesce(try_cast(nullif(regexp_replace(coalesce(population, ''), '[^0-9]', '', 'g'), '') AS BIGINT), 0)"
_LABELS_SQL = f"""SELECT name, lat, lon, CASE WHEN place IN ('peak', 'locality') THEN 'sector' WHEN place = 'city' THEN 'town' ELSE place END AS kind,
    CASE WHEN place IN ('peak', 'locality') THEN 5 ELSE greatest(base + CASE WHEN people >= 10000 THEN -1 WHEN people > 0 AND people < 500 THEN 1 ELSE 0 END, 0) END AS rank,
    CASE WHEN place IN ('peak', 'locality') THEN 0 ELSE people END AS pop, CASE WHEN place IN ('peak', 'locality') THEN 'landmark' ELSE 'place' END AS src
    FROM (SELECT *, {_POP} AS people, CASE place WHEN 'city' THEN 0 WHEN 'town' THEN 0 WHEN 'village' THEN 2 WHEN 'hamlet' THEN 4 END AS base FROM places)
    WHERE base IS NOT NULL OR (place IN ('peak', 'locality') AND NOT regexp_matches(lower(name), '^(carrefour|rond-point|rond point|croix de|place de)'))"""
_SECTORS_SQL = """SELECT n_name AS name, 48.3::DOUBLE + n_nationkey / 100::DOUBLE AS lat, 2.5::DOUBLE + n_nationkey / 100::DOUBLE AS lon, count(*) AS problems_count
    FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name, n_nationkey"""


@query("f26_place_labels", _LABELS_SQL, "places")
def f26(spark, sf_dir):
    return L.place_labels(places(spark, sf_dir))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    counts = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("problems_count"))
    k = F.col("c_nationkey") / F.lit(100.0)
    areas = counts.join(n, "c_nationkey").select(
        F.col("n_name").alias("name"), "problems_count", (F.lit(48.3) + k - 0.0625).alias("south"), (F.lit(48.3) + k + 0.0625).alias("north"), (F.lit(2.5) + k - 0.0625).alias("west"), (F.lit(2.5) + k + 0.0625).alias("east")
    )
    return L.sector_labels(areas, (2.4, 48.2, 2.705, 48.505))


@query("f25_sector_ranks", f"SELECT name, CASE WHEN problems_count >= 300 THEN 1 WHEN problems_count >= 150 THEN 2 WHEN problems_count >= 60 THEN 3 WHEN problems_count >= 20 THEN 4 ELSE 5 END AS rank, problems_count AS pop FROM ({_SECTORS_SQL}) WHERE lon <= 2.705::DOUBLE AND lat <= 48.505::DOUBLE")
def f25(spark, sf_dir):
    return sectors(spark, sf_dir).select("name", "rank", "pop")


@query("w4_first_by_name", f"SELECT name, kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY src <> 'sector', rank, pop DESC, name, lat, lon) AS k FROM ({_LABELS_SQL})) WHERE k = 1", "places")
def w4(spark, sf_dir):
    return L.first_by_name(L.place_labels(places(spark, sf_dir))).select("name", "kind", "rank")


_TIER = "CASE WHEN problems_count >= 300 THEN 1 WHEN problems_count >= 150 THEN 2 WHEN problems_count >= 60 THEN 3 WHEN problems_count >= 20 THEN 4 ELSE 5 END"


@query(
    "u4_ordered_concat",
    f"""SELECT row_number() OVER (ORDER BY prio, rank, pop DESC, name, lat, lon) AS place, name, src FROM (
        SELECT 0 AS prio, name, {_TIER} AS rank, problems_count AS pop, lat, lon, 'sector' AS src FROM ({_SECTORS_SQL}) WHERE lon <= 2.705::DOUBLE AND lat <= 48.505::DOUBLE
        UNION ALL SELECT 1, name, rank, pop, lat, lon, src FROM ({_LABELS_SQL}))""",
    "places",
)
def u4(spark, sf_dir):
    """Sectors first, then the other labels, each in their own order."""
    both = sectors(spark, sf_dir).unionByName(L.place_labels(places(spark, sf_dir)))
    return global_rank(both, [F.col("src") != "sector", "rank", F.desc("pop"), "name", "lat", "lon"]).select("place", "name", "src")


@query("t3_label_order", f"SELECT row_number() OVER (ORDER BY rank, pop DESC, name, lat)::INT AS place, name FROM ({_LABELS_SQL})", "places")
def t3(spark, sf_dir):
    ranked = global_rank(L.place_labels(places(spark, sf_dir)), ["rank", F.desc("pop"), "name", "lat"])
    return ranked.select(F.col("place").cast("int").alias("place"), "name")


#: Labels that a map carries.
BUDGET = 200


def budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.place_labels(places(spark, sf_dir)).orderBy("rank", F.desc("pop"), "name", "lat").limit(BUDGET)


@query("t7_label_budget", f"SELECT name, rank FROM ({_LABELS_SQL}) ORDER BY rank, pop DESC, name, lat LIMIT {BUDGET}", "places")
def t7(spark, sf_dir):
    return budgeted(spark, sf_dir).select("name", "rank")


@query("a11_thin_labels")
def a11(spark, sf_dir):
    """The map's labels: sectors and places merged by name, landmarks thinned to 700 m."""
    merged = L.first_by_name(sectors(spark, sf_dir).unionByName(L.place_labels(places(spark, sf_dir))))
    return L.thin(merged.withColumn("map", L.sheet(F.col("lat"), F.col("lon"))), "map").drop("map")


@query(
    "k5_places_document",
    f"""SELECT document, strlen(document) AS bytes, strlen(document) > 60000 AS over FROM (
        SELECT '{{"columns":["name","lat","lon","kind","rank"],"rows":[' || string_agg('["' || name || '",' || round_even(lat, 5) || ',' || round_even(lon, 5) || ',"' || kind || '",' || rank || ']', ',' ORDER BY rank, pop DESC, name, lat) || ']}}' AS document
        FROM (SELECT * FROM ({_LABELS_SQL}) ORDER BY rank, pop DESC, name, lat LIMIT {BUDGET}))""",
    "places",
)
def k5(spark, sf_dir):
    """The labels within the budget as one document, with its size against 60 KB."""
    rows = budgeted(spark, sf_dir).withColumns({"lat": F.bround("lat", 5), "lon": F.bround("lon", 5)})
    return points_document(rows, ["name", "lat", "lon", "kind", "rank"], ["rank", (-F.col("pop")).alias("p"), "name", "lat"], 60_000)


@query("k5_places_payload")
def k5p(spark, sf_dir):
    """One compact document of at most 200 labels, with its size against the 60 KB budget."""
    return payload(a11(spark, sf_dir), ["name", "lat", "lon", "kind", "rank"])


# --- text ------------------------------------------------------------------
@query("p6_junctions", "SELECT name FROM places WHERE regexp_matches(lower(name), '^(carrefour|rond-point|rond point|croix de|place de)')", "places")
def p6(spark, sf_dir):
    return places(spark, sf_dir).where(T.is_junction(F.col("name"))).select("name")


@query("f12_name_key", f"SELECT name, {_KEY} AS key FROM places", "places")
def f12(spark, sf_dir):
    return places(spark, sf_dir).select("name", T.name_key(F.col("name")).alias("key"))


@query("f13_population", f"SELECT name, {_POP} AS people FROM places", "places")
def f13(spark, sf_dir):
    return places(spark, sf_dir).select("name", T.population(F.col("population")).alias("people"))


@query("f14_slug", r"SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(strip_accents(t)), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g')), ' ', '_', 'g'), '/', '_', 'g') AS slug FROM (SELECT doc_id, replace(replace(text, 'ß', ''), chr(10), ' ') AS t FROM documents)")
def f14(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    line = F.replace(F.replace("text", F.lit("ß"), F.lit("")), F.lit("\n"), F.lit(" "))
    return d.select("doc_id", T.slug(line).alias("slug"))


@query("f19_html_escape", "SELECT event_id, replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM events")
def f19(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", T.html_escape(F.col("props")).alias("html"))


@query("f18_base64", "SELECT c_custkey AS id, to_base64(c_name::BLOB) AS b64 FROM customer")
def f18(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.base64(F.col("c_name").cast("binary")).alias("b64"))


@query("f20_tile_name", "SELECT id, 'DEM_' || CASE WHEN lat - 48.3::DOUBLE >= 0 THEN 'N' ELSE 'S' END || lpad(abs(floor(lat - 48.3::DOUBLE))::INT::VARCHAR, 2, '0') || CASE WHEN lon - 2.6::DOUBLE >= 0 THEN '_E' ELSE '_W' END || lpad(abs(floor(lon - 2.6::DOUBLE))::INT::VARCHAR, 3, '0') AS tile FROM problems", "problems")
def f20(spark, sf_dir):
    from ..sources.derived import problems

    lat, lon = F.col("lat") - 48.3, F.col("lon") - 2.6
    tile = F.format_string("DEM_%s%02d%s%03d", F.when(lat >= 0, "N").otherwise("S"), F.abs(F.floor(lat)).cast("int"), F.when(lon >= 0, "_E").otherwise("_W"), F.abs(F.floor(lon)).cast("int"))
    return problems(spark, sf_dir).select("id", tile.alias("tile"))


@query("f21_json_parse", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def f21(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("f22_map_default", "SELECT event_type, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS code, count(*) AS n FROM events GROUP BY event_type")
def f22(spark, sf_dir):
    codes = F.create_map(F.lit("click"), F.lit(1), F.lit("view"), F.lit(2))
    kinds = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.select("event_type", F.coalesce(F.try_element_at(codes, F.col("event_type")), F.lit(0)).alias("code"), "n")


@query("f9_half_even", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4, 1) AS r FROM lineitem")
def f9(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bround(F.col("l_quantity") / 4, 1).alias("r"))


@query("f1_math", "SELECT l_partkey, round_even(exp(-l_discount), 9) AS e, round_even(ln(l_quantity), 9) AS l, round_even(sqrt(l_quantity), 9) AS s, round_even(pow(l_quantity, 0.647), 9) AS p, least(greatest(l_quantity, 10), 40) AS clipped, sign(l_quantity - 25)::DOUBLE AS sg FROM lineitem")
def f1(spark, sf_dir):
    q = F.col("l_quantity")
    r = lambda c: F.bround(c, 9)
    return read(spark, sf_dir, "lineitem").select(
        "l_partkey", r(F.exp(-F.col("l_discount"))).alias("e"), r(F.log(q)).alias("l"), r(F.sqrt(q)).alias("s"), r(F.pow(q, F.lit(0.647))).alias("p"), F.least(F.greatest(q, F.lit(10.0)), F.lit(40.0)).alias("clipped"), F.signum(q - 25).alias("sg")
    )


@query("f10_fill", "SELECT y, x, coalesce(dnbr, -0.3) AS filled FROM (SELECT y, x, round_even(dnbr, 6) AS dnbr FROM delta)", "delta")
def f10(spark, sf_dir):
    return delta(spark, sf_dir).select("y", "x", F.coalesce(F.bround("dnbr", 6), F.lit(-0.3)).alias("filled"))


# --- models ----------------------------------------------------------------
@query("m4_category_cast", "SELECT y, x, CASE fuel WHEN 0 THEN 'closed conifer' WHEN 1 THEN 'open conifer' WHEN 2 THEN 'broadleaf' WHEN 3 THEN 'heath' ELSE 'none' END AS fuel FROM px", "px")
def m4(spark, sf_dir):
    names = F.create_map(*[F.lit(v) for pair in enumerate(("closed conifer", "open conifer", "broadleaf", "heath")) for v in pair])
    return pixels(spark, sf_dir).select("y", "x", F.coalesce(F.try_element_at(names, F.col("fuel")), F.lit("none")).alias("fuel"))


def driver_sample(spark: SparkSession, sf_dir: str, n: int = 60_000) -> DataFrame:
    d = delta(spark, sf_dir).where("ok AND dnbr IS NOT NULL AND nir_pre IS NOT NULL AND red_pre IS NOT NULL")
    block = (F.floor(F.col("y") / 10) * 1000 + F.floor(F.col("x") / 10)).cast("long")
    rows = d.select("y", "x", "dnbr", "nir_pre", "swir_pre", "red_pre", F.col("fuel").cast("double").alias("fuel"), block.alias("block"))
    return V.hashed_sample(rows, ["y", "x"], n)


@query("a9_hashed_sample")
def a9(spark, sf_dir):
    """A bounded sample of usable pixels, the same on every run."""
    return driver_sample(spark, sf_dir)


@query("m2_block_folds", "WITH b AS (SELECT (y // 10 * 1000 + x // 10)::BIGINT AS block, count(*) AS n FROM px GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, block) - 1 AS k FROM b) SELECT block, n, CASE WHEN k // 5 % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END::INT AS fold FROM k", "px")
def m2f(spark, sf_dir):
    block = (F.floor(F.col("y") / 10) * 1000 + F.floor(F.col("x") / 10)).cast("long")
    return V.block_folds(pixels(spark, sf_dir).withColumn("block", block), "block")


_FEATURES = ["nir_pre", "swir_pre", "red_pre", "fuel"]


@query("m1_boosted_trees")
def m1(spark, sf_dir):
    """Burn severity predicted from the bands before the fire and the fuel."""
    return V.fit_trees(driver_sample(spark, sf_dir), _FEATURES, "dnbr", categories=["fuel"]).select("y", "x", "dnbr", "prediction")


@query("m2_cross_validation")
def m2(spark, sf_dir):
    """R2 under random folds and under spatial blocks."""
    rows = driver_sample(spark, sf_dir)
    blocks = rows.join(V.block_folds(rows, "block").select("block", "fold"), "block")
    scored = lambda folded, kind: V.cross_validate(folded, _FEATURES, "dnbr", categories=["fuel"]).withColumn("kind", F.lit(kind))
    return scored(V.random_folds(rows, ["y", "x"]), "random").unionByName(scored(blocks, "blocked"))


@query("m3_permutation_importance")
def m3(spark, sf_dir):
    rows = driver_sample(spark, sf_dir)
    blocks = rows.join(V.block_folds(rows, "block").select("block", "fold"), "block")
    return V.permutation_importance(blocks, _FEATURES, "dnbr", ["y", "x"], categories=["fuel"]).orderBy(F.desc("importance"), "feature")


@query("t8_importance_order")
def t8(spark, sf_dir):
    return m3(spark, sf_dir).withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


# --- landed formats --------------------------------------------------------
@query("s9_map_features", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey / 10::DOUBLE ELSE s_suppkey / 20::DOUBLE END AS lat, s_name AS name FROM supplier WHERE s_suppkey % 4 <> 1 AND s_suppkey > 0")
def s9(spark, sf_dir):
    k = F.col("s_suppkey")
    place = F.when(k % 4 == 1, F.lit("")).when(k % 3 == 0, F.format_string('"lat":%s,"lon":2.5,', k / F.lit(10.0))).otherwise(F.format_string('"center":{"lat":%s,"lon":2.5},', k / F.lit(20.0)))
    doc = F.concat(F.lit('{"elements":[{"type":"node","id":'), k, F.lit(","), place, F.lit('"tags":{"name":"'), F.col("s_name"), F.lit('","climbing":"crag"}}]}'))
    raw = read(spark, sf_dir, "supplier").where("s_suppkey > 0").select(doc.alias("value"))
    return readers.climbing_features(readers.map_elements(raw)).select("id", "lat", "name")


@query("s13_paths", "SELECT s_suppkey AS id, s_suppkey % 4 AS vertices FROM supplier WHERE s_suppkey % 4 >= 2")
def s13(spark, sf_dir):
    k = F.col("s_suppkey")
    vertices = F.array_join(F.slice(F.array(*[F.lit('{"lat":48.1,"lon":2.1}')] * 4), F.lit(1), (k % 4).cast("int")), ",")
    doc = F.concat(F.lit('{"elements":[{"type":"way","id":'), k, F.lit(',"tags":{"highway":"path"},"geometry":['), vertices, F.lit("]}]}"))
    raw = read(spark, sf_dir, "supplier").select(doc.alias("value"))
    return readers.paths(readers.map_elements(raw)).select("id", F.size("line").cast("long").alias("vertices"))


@query("s14_place_nodes", "SELECT name, place FROM places", "places")
def s14(spark, sf_dir):
    node = F.to_json(F.struct(F.array(F.struct(F.lit("node").alias("type"), "lat", "lon", F.create_map(F.lit("name"), "name", F.lit("place"), "place").alias("tags"))).alias("elements")))
    raw = places(spark, sf_dir).select(node.alias("value"))
    e = readers.map_elements(raw)
    return e.select(F.col("tags")["name"].alias("name"), F.col("tags")["place"].alias("place"))


@query("s15_hourly_payload", "SELECT ts, temp, precip FROM hourly", "hourly")
def s15(spark, sf_dir):
    from ..sources.derived import hourly

    days = hourly(spark, sf_dir).withColumn("day", F.to_date("ts")).groupBy("day").agg(F.sort_array(F.collect_list(F.struct("ts", "temp", "precip"))).alias("h"))
    time = F.transform("h", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm"))
    doc = F.to_json(F.struct(F.struct(time.alias("time"), F.col("h.temp").alias("temp"), F.col("h.precip").alias("precip")).alias("hourly")))
    return readers.hourly_series(days.select(doc.alias("value")), ["temp", "precip"])


@query("s18_bucket_listing", "SELECT key FROM orbits", "orbits")
def s18(spark, sf_dir):
    from ..sources.derived import orbits

    xml = F.concat(F.lit("<L><Contents><Key>"), F.col("key"), F.lit("</Key></Contents><Contents><Key>a.xml</Key></Contents></L>"))
    return readers.listed_keys(orbits(spark, sf_dir).select(xml.alias("value")))


@query("s22_positional_payload", "SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(w) AS word, (unnest(range(1, len(w) + 1)) - 1)::INT AS pos FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents))")
def s22(spark, sf_dir):
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(line, " ")).alias("pos", "word"))


@query("s11_feature_collection", "SELECT c_custkey AS id, c_name AS name FROM customer")
def s11(spark, sf_dir):
    doc = F.concat(F.lit('{"type":"FeatureCollection","features":[{"geometry":{"type":"Point","coordinates":[2.5,48.1]},"properties":{"id":'), F.col("c_custkey"), F.lit(',"name":"'), F.col("c_name"), F.lit('"}}]}'))
    raw = read(spark, sf_dir, "customer").select(doc.alias("value"))
    return readers.feature_collection(raw, "id:bigint,name:string").select("id", "name")
