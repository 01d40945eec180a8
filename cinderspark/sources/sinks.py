"""Writing results: tables, features, documents and compact payloads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def geojson_feature(lon: Column, lat: Column, properties: Column) -> Column:
    """A GeoJSON point feature as text."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
            properties.alias("properties"),
        ),
        {"ignoreNullFields": "false"},
    )


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ("geometry",)) -> None:
    """Attributes as CSV with a header; one file for each task."""
    df.drop(*drop).write.mode("overwrite").option("header", True).csv(path)


def write_geojson(df: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> None:
    """Newline-delimited GeoJSON features."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    df.select(geojson_feature(F.col(lon), F.col(lat), F.struct(*rest)).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def payload(df: DataFrame, columns: list[str], limit_bytes: int = 60_000) -> DataFrame:
    """One document {columns, rows} with its size and whether it is over the limit: for small, final tables only."""
    rows = df.select(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])).alias("r"))
    text = rows.agg(F.concat(F.lit('{"columns":'), F.to_json(F.array(*map(F.lit, columns))), F.lit(',"rows":['), F.array_join(F.sort_array(F.collect_list("r")), ","), F.lit("]}")).alias("document"))
    return text.withColumn("bytes", F.octet_length("document")).withColumn("over", F.col("bytes") > limit_bytes)


def json_value(df: DataFrame, column: str) -> Column:
    """A column's values as JSON: text in quotes, missing values null."""
    if dict(df.dtypes)[column] == "string":
        quoted = F.to_json(F.array(column))
        return F.coalesce(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("null"))
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def points_document(df: DataFrame, columns: list[str], order: list[Column | str], limit_bytes: int) -> DataFrame:
    """One compact document, names of columns once and rows as arrays in an order, with its size and whether it is over
    the limit: for what a page loads, which is bounded by what a page can show."""
    row = F.concat(F.lit("["), F.concat_ws(",", *[json_value(df, c) for c in columns]), F.lit("]"))
    listed = df.agg(F.array_sort(F.collect_list(F.struct(*order, row.alias("_row")))).alias("rows"))
    head = '{"columns":[' + ",".join(f'"{c}"' for c in columns) + '],"rows":['
    document = F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["_row"]), ","), F.lit("]}"))
    return listed.select(document.alias("document")).select("document", F.octet_length("document").cast("long").alias("bytes"), (F.octet_length("document") > limit_bytes).alias("over"))


def write_scene(pixels: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pixels by scene, each scene's sorted by tile, so a read of one scene or tile skips the rest."""
    tiles = pixels.withColumn("tile", F.floor(F.col("y") / 512) * 100000 + F.floor(F.col("x") / 512))
    tiles.repartition("scene_id").sortWithinPartitions("scene_id", "tile", "y", "x").write.mode(mode).partitionBy("scene_id").parquet(path)


def write_scenes_once(pixels: DataFrame, path: str, scl: str, bands: list[str]) -> int:
    """Write the scenes of ``pixels`` that the folder doesn't hold yet, each with a sidecar: a JSON document of its
    pixels and its scene classes in percent.  The number of scenes written; an error if a band is missing.

    Running it again after a failure writes what is left.
    """
    spark = pixels.sparkSession
    absent = [b for b in (scl, *bands) if b not in pixels.columns]
    if absent:
        raise KeyError(f"assets are missing: {', '.join(absent)}")
    try:
        have = spark.read.schema("scene_id string, document string").json(f"{path}/sidecars").select("scene_id").distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        have = spark.createDataFrame([], "scene_id string")
    new = pixels.join(have, "scene_id", "left_anti")
    counts = new.groupBy("scene_id", F.col(scl).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy("scene_id").agg(F.sum("n").alias("px"), F.array_sort(F.collect_list(F.struct("code", "n"))).alias("c"))
    pct = F.transform("c", lambda x: F.concat(F.lit('"'), x["code"], F.lit('":'), F.bround(x["n"] * 100.0 / F.col("px"), 2)))
    sidecars = each.select("scene_id", F.concat(F.lit('{"pixels":'), F.col("px"), F.lit(',"scl_pct":{'), F.array_join(pct, ","), F.lit("}}")).alias("document"))
    found = sidecars.collect()  # one row a scene
    if found:
        write_scene(new.select("scene_id", "y", "x", scl, *bands), f"{path}/scenes", mode="append")
        spark.createDataFrame([(r.scene_id, r.document) for r in found], "scene_id string, document string").coalesce(1).write.mode("append").json(f"{path}/sidecars")
    return len(found)
