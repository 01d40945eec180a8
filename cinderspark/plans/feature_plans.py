"""Plans on point features: joins, window samples, rollups, and the small filters around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import raster as R
from ..operators import sampling
from ..operators.ranking import global_rank
from ..sources.derived import problems, side, swaths
from ..sources.sinks import geojson_feature, points_document
from ..sources.tables import read
from .raster_plans import delta
from .registry import query

AOI = (2.45, 48.25, 2.70, 48.45)


def sampled(spark: SparkSession, sf_dir: str, snap: str = "round") -> DataFrame:
    s = side(spark, sf_dir)
    return sampling.sample(problems(spark, sf_dir), delta(spark, sf_dir), s, s, 2, snap)


@query("j1_problem_areas", "SELECT id, name, area_name, cluster_name, colour FROM problems", "problems")
def j1(spark, sf_dir):
    return problems(spark, sf_dir).select("id", "name", "area_name", "cluster_name", "colour")


@query("s7_problem_scan", "SELECT id, area_name, cluster_name FROM problems WHERE lat IS NOT NULL AND lon IS NOT NULL", "problems")
def s7(spark, sf_dir):
    return problems(spark, sf_dir).where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "area_name", "cluster_name")


@query(
    "s8_area_scan",
    "SELECT n_name AS name, count(*) AS problems_count FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name HAVING count(*) > 0 ORDER BY 2 DESC, 1",
)
def s8(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    counts = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("problems_count"))
    return counts.join(n, "c_nationkey").select("name", "problems_count").where("problems_count > 0").orderBy(F.desc("problems_count"), "name")


@query("r12_grade_rank", "SELECT id, CASE WHEN grade_no < 63 THEN (grade_no // 7 + 1)::VARCHAR || ['', 'a', 'a+', 'b', 'b+', 'c', 'c+'][grade_no % 7 + 1] ELSE 'project' END AS grade, CASE WHEN grade_no < 63 THEN grade_no END AS grade_rank FROM problems", "problems")
def r12(spark, sf_dir):
    order = [f"{n}{s}" for n in range(1, 10) for s in ("", "a", "a+", "b", "b+", "c", "c+")]
    ranks = F.create_map(*[F.lit(v) for pair in ((g, k) for k, g in enumerate(order)) for v in pair])
    grade = F.coalesce(F.get(F.array(*map(F.lit, order)), F.col("grade_no")), F.lit("project"))
    return problems(spark, sf_dir).select("id", grade.alias("grade")).withColumn("grade_rank", F.try_element_at(ranks, F.col("grade")))


@query("p1_bbox_clip", f"SELECT id FROM problems WHERE lon BETWEEN {AOI[0]}::DOUBLE AND {AOI[2]}::DOUBLE AND lat BETWEEN {AOI[1]}::DOUBLE AND {AOI[3]}::DOUBLE", "problems")
def p1(spark, sf_dir):
    w, s, e, n = AOI
    return problems(spark, sf_dir).where(F.col("lon").between(w, e) & F.col("lat").between(s, n)).select("id")


@query("p2_in_grid", "SELECT id, round_even(col_f, 0) < s AND round_even(row_f, 0) < s AS in_aoi FROM problems, dims", "problems")
def p2(spark, sf_dir):
    s = side(spark, sf_dir)
    return problems(spark, sf_dir).select("id", ((F.bround("col_f") < s) & (F.bround("row_f") < s)).alias("in_aoi"))


@query(
    "j6_neighbourhood",
    """SELECT id, count(*) AS cells, sum(y * 1000 + x)::BIGINT AS place FROM (SELECT id, round_even(col_f, 0)::BIGINT AS ci, round_even(row_f, 0)::BIGINT AS ri FROM problems) f, dims
    JOIN px ON true WHERE ci < s AND ri < s AND abs(y - ri) <= 2 AND abs(x - ci) <= 2 GROUP BY id""",
    "problems", "px",
)
def j6(spark, sf_dir):
    s = side(spark, sf_dir)
    near = sampling.neighbourhood(problems(spark, sf_dir), delta(spark, sf_dir).select("y", "x"), s, s)
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("y") * 1000 + F.col("x")).alias("place"))


@query(
    "g7_feature_sample",
    """SELECT id, in_aoi, dnbr_median, dnbr_p25, dnbr_p75, dnbr_iqr, dnbr_min, dnbr_max, label AS severity, edge, n_px
    FROM sampled LEFT JOIN names ON code = cls""",
    "sampled", "names",
)
def g7(spark, sf_dir):
    return sampled(spark, sf_dir).select("id", "in_aoi", "dnbr_median", "dnbr_p25", "dnbr_p75", "dnbr_iqr", "dnbr_min", "dnbr_max", "severity", "edge", "n_px")


@query("g8_class_counts", "SELECT code AS cls, label, count(id) AS n FROM names LEFT JOIN sampled ON cls = code GROUP BY code, label", "sampled", "names")
def g8(spark, sf_dir):
    return sampling.class_counts(sampled(spark, sf_dir))


_PCT = "round_even(sum((dnbr_median >= 0.27)::INT) * 100.0::DOUBLE / count(*), 1)"


@query("g9_colour_rollup", f"SELECT colour, count(*) AS problems, round_even(median(dnbr_median), 6) AS dnbr_median, {_PCT} AS pct_burned, max(dnbr_median) AS dnbr_max, sum(coalesce(edge::INT, 0))::BIGINT AS n_edge FROM sampled WHERE dnbr_median IS NOT NULL AND colour IS NOT NULL GROUP BY colour", "sampled")
def g9(spark, sf_dir):
    return sampling.colours(sampled(spark, sf_dir))


CIRCUITS_SQL = f"""SELECT area_name, colour, count(*) AS problems, round_even(median(dnbr_median), 6) AS dnbr_median, {_PCT} AS pct_burned,
    round_even(quantile_cont(dnbr_median, 0.9), 6) AS dnbr_p90, sum(coalesce(edge::INT, 0))::BIGINT AS n_unresolved
    FROM sampled WHERE dnbr_median IS NOT NULL AND area_name IS NOT NULL AND colour IS NOT NULL GROUP BY area_name, colour HAVING count(*) >= 5"""


@query("g10_circuit_rollup", CIRCUITS_SQL, "sampled")
def g10(spark, sf_dir):
    return sampling.circuits(sampled(spark, sf_dir))


@query("g11_area_rollup", f"SELECT area_name, count(*) AS problems, round_even(median(dnbr_median), 6) AS dnbr_median, {_PCT} AS pct_burned FROM sampled WHERE dnbr_median IS NOT NULL AND area_name IS NOT NULL GROUP BY area_name HAVING count(*) >= 10", "sampled")
def g11(spark, sf_dir):
    return sampling.areas(sampled(spark, sf_dir))


@query("p4_burned_features", "SELECT id, dnbr_median FROM sampled WHERE dnbr_median IS NOT NULL AND dnbr_median >= 0.10", "sampled")
def p4(spark, sf_dir):
    return sampled(spark, sf_dir).where(F.col("dnbr_median").isNotNull() & (F.col("dnbr_median") >= R.LOW)).select("id", "dnbr_median")


@query("p5_label_filter", "SELECT id, label AS severity FROM sampled JOIN names ON code = cls WHERE contains(label, 'severity') AND label <> 'low severity'", "sampled", "names")
def p5(spark, sf_dir):
    burned = [n for n in R.SEVERITY_LABELS if "severity" in n and n != "low severity"]
    return sampled(spark, sf_dir).where(F.col("severity").isin(burned)).select("id", "severity")


#: What a group must have to be reported, by rule.
LEAST = {"circuit": 5, "area": 10, "zone": 5.0, "sector": 100.0, "front": 200, "scar": 2000, "smoke": 5, "class": 0.01}


@query(
    "p10_having",
    f"""WITH g AS (
        SELECT 'circuit' AS rule, area_name || '/' || colour AS key, count(*)::DOUBLE AS size FROM sampled WHERE dnbr_median IS NOT NULL AND area_name IS NOT NULL AND colour IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'area', area_name, count(*) FROM sampled WHERE dnbr_median IS NOT NULL AND area_name IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'zone', fuel::VARCHAR, count(*) / 100::DOUBLE FROM delta WHERE fuel >= 0 GROUP BY ALL
        UNION ALL SELECT 'sector', fuel::VARCHAR, count(*) / 100::DOUBLE FROM delta WHERE fuel >= 0 AND coalesce(dnbr >= 0.10, false) GROUP BY ALL
        UNION ALL SELECT 'front', fuel || '/' || ok, count(*) FROM delta WHERE fuel >= 0 AND coalesce(dnbr >= 0.10, false) GROUP BY fuel, ok
        UNION ALL SELECT 'scar', cls::VARCHAR, count(*) FROM (SELECT CASE WHEN dnbr >= 0.27 THEN 1 ELSE 0 END AS cls FROM delta) GROUP BY cls
        UNION ALL SELECT 'smoke', day::VARCHAR, count(*) FROM swaths WHERE v >= 0.25 GROUP BY ALL
        UNION ALL SELECT 'class', scl_pre::VARCHAR, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () FROM px GROUP BY scl_pre)
    SELECT rule, key, round_even(size, 4) AS size FROM g WHERE CASE rule {" ".join(f"WHEN '{r}' THEN size >= {v}" for r, v in LEAST.items() if r != "class")} ELSE size > {LEAST["class"]} END""",
    "sampled", "swaths",
)
def p10(spark, sf_dir):
    """Groups that are large enough for each report."""
    text = lambda *c: F.concat_ws("/", *[F.col(x).cast("string") for x in c])
    many = F.count(F.lit(1)).cast("double")

    def rule(name, rows, keys, size):
        return rows.groupBy(*keys).agg(size.alias("size")).select(F.lit(name).alias("rule"), text(*keys).alias("key"), "size")

    known = sampled(spark, sf_dir).where("dnbr_median IS NOT NULL AND area_name IS NOT NULL")
    px = delta(spark, sf_dir)
    land, low = px.where("fuel >= 0"), R.at_least(F.col("dnbr"), R.LOW)
    scar = px.select(F.coalesce(F.col("dnbr") >= R.BURNED, F.lit(False)).cast("int").alias("cls"))
    classes = px.groupBy(F.col("scl_pre").alias("k")).agg(many.alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())  # twelve rows
    groups = [
        rule("circuit", known.where("colour IS NOT NULL"), ["area_name", "colour"], many),
        rule("area", known, ["area_name"], many),
        rule("zone", land, ["fuel"], R.hectares(many)),
        rule("sector", land.where(low), ["fuel"], R.hectares(many)),
        rule("front", land.where(low), ["fuel", "ok"], many),
        rule("scar", scar, ["cls"], many),
        rule("smoke", swaths(spark, sf_dir).where("v >= 0.25"), ["day"], many),
        classes.select(F.lit("class").alias("rule"), text("k").alias("key"), share.alias("size")),
    ]
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    enough = F.lit(False)
    for name, least in LEAST.items():
        enough = enough | ((F.col("rule") == name) & ((F.col("size") > least) if name == "class" else (F.col("size") >= least)))
    return out.where(enough).withColumn("size", F.bround("size", 4))


@query("t2_circuit_order", f"SELECT row_number() OVER (ORDER BY pct_burned DESC, dnbr_median DESC, area_name, colour)::INT AS place, area_name, colour FROM ({CIRCUITS_SQL})", "sampled")
def t2(spark, sf_dir):
    order = [F.desc("pct_burned"), F.desc("dnbr_median"), "area_name", "colour"]
    return global_rank(sampling.circuits(sampled(spark, sf_dir)), order).select(F.col("place").cast("int").alias("place"), "area_name", "colour")


@query("t4_top_features", "SELECT id, dnbr_median FROM sampled WHERE dnbr_median IS NOT NULL ORDER BY dnbr_median DESC, id LIMIT 30", "sampled")
def t4(spark, sf_dir):
    return sampled(spark, sf_dir).where("dnbr_median IS NOT NULL").orderBy(F.desc("dnbr_median"), "id").limit(30).select("id", "dnbr_median")


@query("g28_frequencies", "SELECT colour, count(*) AS n, count(DISTINCT area_id) AS areas, count(area_name) AS named FROM problems GROUP BY colour", "problems")
def g28(spark, sf_dir):
    return problems(spark, sf_dir).groupBy("colour").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("area_id").alias("areas"), F.count("area_name").alias("named"))


@query("g32_grouping_sets", "SELECT area_name, colour, count(*) AS n FROM problems WHERE area_name IS NOT NULL AND colour IS NOT NULL GROUP BY GROUPING SETS ((area_name, colour), (area_name), (colour))", "problems")
def g32(spark, sf_dir):
    known = problems(spark, sf_dir).where("area_name IS NOT NULL AND colour IS NOT NULL")
    area, colour = F.col("area_name"), F.col("colour")
    return known.groupingSets([(area, colour), (area,), (colour,)], area, colour).agg(F.count(F.lit(1)).alias("n"))


@query("j17_first_by_key", "SELECT colour, id FROM (SELECT colour, id, row_number() OVER (PARTITION BY colour ORDER BY lat, id) AS k FROM problems) WHERE k = 1", "problems")
def j17(spark, sf_dir):
    w = Window.partitionBy("colour").orderBy("lat", "id")
    return problems(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("colour", "id")


@query(
    "a12_dictionary_encode",
    """SELECT id, coalesce(code, -1)::INT AS code FROM problems LEFT JOIN (SELECT area_name AS a, row_number() OVER (ORDER BY min(id)) - 1 AS code FROM problems
    WHERE area_name IS NOT NULL GROUP BY area_name) ON a = area_name""",
    "problems",
)
def a12(spark, sf_dir):
    p = problems(spark, sf_dir)
    return p.join(dictionary(p), "area_name", "left").select("id", F.coalesce("code", F.lit(-1)).alias("code"))


def dictionary(features: DataFrame) -> DataFrame:
    """(area_name, code): names numbered from 0 in the order in which they first come up."""
    first = features.where("area_name IS NOT NULL").groupBy("area_name").agg(F.min("id").alias("first"))
    return global_rank(first, ["first"], "code").select("area_name", (F.col("code") - 1).cast("int").alias("code"))


#: Adding zero makes a negative zero a plain one.
_POINT = "round_even(lon, 5) AS lon, round_even(lat, 5) AS lat, round_even(dnbr_median, 3) + 0::DOUBLE AS dnbr"


@query(
    "k4_points_payload",
    f"""SELECT document, strlen(document) AS bytes, strlen(document) > 16777216 AS over FROM (
        SELECT '{{"columns":["id","lon","lat","dnbr","sev","edge"],"rows":[' || string_agg('[' || id || ',' || lon || ',' || lat || ',' || coalesce(dnbr::VARCHAR, 'null') || ',' || sev || ',' || edge || ']', ',' ORDER BY id) || ']}}' AS document
        FROM (SELECT id, {_POINT}, coalesce(cls, -1) AS sev, coalesce(edge::INT, 0) AS edge FROM sampled WHERE in_aoi))""",
    "sampled",
)
def k4(spark, sf_dir):
    """The features of a page: names of columns once, rows as arrays, with the size against what a page may carry."""
    points = sampled(spark, sf_dir).where("in_aoi").select(
        "id", F.bround("lon", 5).alias("lon"), F.bround("lat", 5).alias("lat"), F.bround("dnbr_median", 3).alias("dnbr"),
        F.coalesce("cls", F.lit(-1)).alias("sev"), F.coalesce(F.col("edge").cast("int"), F.lit(0)).alias("edge"),
    )
    return points_document(points, points.columns, ["id"], 16 << 20)


@query(
    "k2_geojson",
    f"""SELECT id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}},"properties":{{"id":' || id || ',"dnbr":' || coalesce(dnbr::VARCHAR, 'null') || ',"edge":' || coalesce(edge::VARCHAR, 'null') || '}}}}' AS feature
    FROM (SELECT id, {_POINT}, edge FROM sampled)""",
    "sampled",
)
def k2(spark, sf_dir):
    """Features with their samples; what wasn't sampled is null."""
    f = sampled(spark, sf_dir).select("id", F.bround("lon", 5).alias("lon"), F.bround("lat", 5).alias("lat"), F.bround("dnbr_median", 3).alias("dnbr"), "edge")
    return f.select("id", geojson_feature(F.col("lon"), F.col("lat"), F.struct("id", "dnbr", "edge")).alias("feature"))


@query(
    "k3_summary_document",
    """SELECT '{"counts":{"problems":' || count(*) || ',"sampled":' || count(dnbr_median) || ',"burned":' || coalesce(sum((dnbr_median >= 0.27)::INT), 0)::BIGINT || '},"dnbr":{"median":'
        || coalesce(round_even(median(dnbr_median), 4)::VARCHAR, 'null') || ',"max":' || coalesce(max(dnbr_median)::VARCHAR, 'null') || '},"severity":['
        || (SELECT string_agg('{"label":"' || label || '","problems":' || n || '}', ',' ORDER BY code) FROM (SELECT code, label, count(id) AS n FROM names LEFT JOIN sampled ON cls = code GROUP BY code, label)) || ']}' AS document
    FROM sampled""",
    "sampled", "names",
)
def k3(spark, sf_dir):
    """One nested document of a run."""
    s = sampled(spark, sf_dir)
    counts = F.struct(F.count(F.lit(1)).alias("problems"), F.count("dnbr_median").alias("sampled"), F.coalesce(F.sum((F.col("dnbr_median") >= R.BURNED).cast("long")), F.lit(0)).alias("burned"))
    spread = F.struct(F.bround(F.median("dnbr_median"), 4).alias("median"), F.max("dnbr_median").alias("max"))
    listed = F.array_sort(F.collect_list(F.struct("cls", "label", "n")))
    severity = sampling.class_counts(s).agg(F.transform(listed, lambda c: F.struct(c["label"].alias("label"), c["n"].alias("problems"))).alias("severity"))
    one = s.agg(counts.alias("counts"), spread.alias("dnbr")).crossJoin(severity)
    return one.select(F.to_json(F.struct("counts", "dnbr", "severity"), {"ignoreNullFields": "false"}).alias("document"))


@query("u2_set_difference", "SELECT area_id FROM (SELECT n_nationkey AS area_id FROM nation EXCEPT SELECT area_id FROM problems WHERE colour = 'BUILDING')", "problems")
def u2(spark, sf_dir):
    have = problems(spark, sf_dir).where("colour = 'BUILDING'").select("area_id")
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area_id")).join(have, "area_id", "left_anti")


@query("j16_cross", "SELECT radius, bearing FROM (SELECT unnest([25, 60]) AS radius), (SELECT unnest([0, 45, 90, 135, 180, 225, 270, 315]) AS bearing)")
def j16(spark, sf_dir):
    radii = spark.createDataFrame([(25,), (60,)], "radius int")
    return radii.crossJoin(spark.createDataFrame([(45 * k,) for k in range(8)], "bearing int"))


@query("j15_outer_stats", "SELECT n_name AS name, count(id) AS n FROM nation LEFT JOIN problems ON area_id = n_nationkey GROUP BY n_name", "problems")
def j15(spark, sf_dir):
    counts = problems(spark, sf_dir).where("area_id IS NOT NULL").groupBy("area_id").agg(F.count(F.lit(1)).alias("n"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("name"))
    return n.join(counts, "area_id", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
