"""Reading catalogues, features and series from landed JSON and XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = """id string, bbox array<double>, properties struct<datetime:timestamp,`eo:cloud_cover`:double,
    `s2:processing_baseline`:string,`earthsearch:boa_offset_applied`:boolean,platform:string>, assets map<string,struct<href:string>>"""
ELEMENT = """type string, id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>,
    geometry array<struct<lat:double,lon:double>>"""
#: The tags kept of climbing features.
CLIMBING_TAGS = (
    "name", "climbing", "sport", "climbing:grade:fb", "climbing:grade:french", "climbing:circuit:colour",
    "climbing:circuit:number", "climbing:circuit:id", "climbing:boulder", "climbing:length", "climbing:start",
    "ref:bleau.info", "climbing:url:bleauinfo", "climbing:url:boolder", "description", "note",
)


def stac_items(json_column: DataFrame, column: str = "value") -> DataFrame:
    """One row for each item of feature collections given as JSON text."""
    parsed = json_column.select(F.explode(F.from_json(column, f"struct<features:array<struct<{_fields(ITEM)}>>>")["features"]).alias("i"))
    return parsed.select("i.*")


def _fields(ddl: str) -> str:
    out, depth, piece = [], 0, ""
    for c in " ".join(ddl.split()) + ",":
        depth += c == "<"
        depth -= c == ">"
        if c == "," and not depth:
            name, kind = piece.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            piece = ""
        else:
            piece += c
    return ",".join(out)


def search(items: DataFrame, start: Column, end: Column, bbox: tuple[float, float, float, float], max_cloud: float) -> DataFrame:
    """Items that overlap the box in the time range under the cloud limit, by time."""
    w, s, e, n = bbox
    b = F.col("bbox")
    overlaps = (b[0] <= e) & (b[2] >= w) & (b[1] <= n) & (b[3] >= s)
    cloud = F.col("properties")["eo:cloud_cover"]
    when = F.col("properties")["datetime"]
    return items.where(overlaps & when.between(start, end) & (cloud < max_cloud)).orderBy(when, "id")


def missing_assets(items: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, asset) that an item lacks."""
    need = F.explode(F.array(*map(F.lit, wanted)))
    return items.select("id", "assets", need.alias("asset")).where(~F.map_contains_key("assets", F.col("asset"))).select("id", "asset")


def map_elements(json_column: DataFrame, column: str = "value") -> DataFrame:
    """One row for each element of map-data responses given as JSON text."""
    return json_column.select(F.explode(F.from_json(column, f"struct<elements:array<struct<{_fields(ELEMENT)}>>>")["elements"]).alias("e")).select("e.*")


def climbing_features(elements: DataFrame) -> DataFrame:
    """Elements with a place (their own, else their centre's; an own coordinate of 0 counts as none), kept tags and type."""
    own = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.col(f"center.{c}"))
    tags = [F.try_element_at("tags", F.lit(t)).alias(t.replace(":", "_").replace(".", "_")) for t in CLIMBING_TAGS]
    placed = elements.withColumns({"_lat": own("lat"), "_lon": own("lon")}).where("_lat IS NOT NULL AND _lon IS NOT NULL")
    kind = F.coalesce(F.try_element_at("tags", F.lit("climbing")), F.lit("unknown"))
    return placed.select("type", "id", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), *tags, kind.alias("feature_type"))


def paths(elements: DataFrame) -> DataFrame:
    """Ways of two vertices or more, as lines of (x, y)."""
    line = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return elements.where(F.size(F.coalesce("geometry", F.array())) >= 2).select("id", F.try_element_at("tags", F.lit("highway")).alias("highway"), line.alias("line"))


def hourly_series(json_column: DataFrame, variables: list[str], column: str = "value") -> DataFrame:
    """Columnar hourly payloads as rows: the arrays are zipped by place."""
    fields = ",".join(["time:array<string>", *[f"{v}:array<double>" for v in variables]])
    h = json_column.select(F.from_json(column, f"struct<hourly:struct<{fields}>>")["hourly"].alias("h"))
    zipped = F.explode(F.arrays_zip(*[F.col(f"h.{v}").alias(v) for v in ["time", *variables]]))
    return h.select(zipped.alias("z")).select(F.to_timestamp("z.time").alias("ts"), *[f"z.{v}" for v in variables])


def first_of_duplicates(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def listed_keys(xml_column: DataFrame, column: str = "value", suffix: str = ".tif") -> DataFrame:
    """Object keys of bucket listings given as XML text."""
    keys = F.explode(F.xpath(column, F.lit("//Key/text()")))
    return xml_column.select(keys.alias("key")).where(F.endswith("key", F.lit(suffix)))


def feature_collection(path_or_df: DataFrame, properties: str, column: str = "value") -> DataFrame:
    """Features of GeoJSON collections given as text: geometry type, coordinates as JSON, and the properties."""
    shape = f"struct<features:array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<{properties}>>>>"
    return path_or_df.select(F.explode(F.from_json(column, shape)["features"]).alias("f")).select("f.geometry.type", "f.geometry.coordinates", "f.properties.*")


def landed_pages(pages: DataFrame, count: int, column: str = "value") -> DataFrame:
    """(page, feature, truncated) of paged answers landed as JSON text, (page, value), ``count`` features to a full page.

    Pages after the first that is short or absent don't count.  Where none is short the service may hold more:
    ``truncated``.  An empty first page is an error.
    """
    listed = pages.select("page", F.coalesce(F.from_json(column, "struct<features:array<string>>")["features"], F.array().cast("array<string>")).alias("f"))
    sizes = listed.select("page", F.size("f").alias("n"))
    full = sizes.where(F.col("n") >= count).select((F.col("page") + 1).alias("page"))
    # pages that follow a full one, or start the run, and aren't full themselves; the first of them is the last that counts
    starts = full.unionByName(pages.sparkSession.createDataFrame([(0,)], "page int")).distinct()
    ends = starts.join(sizes.where(F.col("n") >= count), "page", "left_anti").agg(F.min("page").alias("last"))
    first = sizes.where("page = 0").agg(F.coalesce(F.max("n"), F.lit(0)).alias("first"))
    known = listed.crossJoin(F.broadcast(ends.crossJoin(first))).where("page <= last")
    cut = known.groupBy().agg(F.max("page").alias("top"), F.first("last").alias("end")).select((F.col("top") < F.col("end")).alias("truncated"))
    some = F.when(F.col("first") > 0, F.col("f")).otherwise(F.raise_error(F.lit("the service's first page is empty")).cast("array<string>"))
    rows = known.select("page", F.explode(some).alias("feature"))
    return rows.crossJoin(F.broadcast(cut)).select("page", "feature", "truncated")
