"""The runnable commands: each works out some of the registered plans and writes their results.

    python -m cinderspark dnbr --data /data/sf --out /results

A result goes to ``<out>/<command>/<plan>`` as Parquet, or as CSV or JSON with
``--format``; ``summary.json`` lists what was written, with rows and columns.
``--skip-done`` leaves out results that are already there, so that a command that
was stopped goes on where it was.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .plans import registry

#: Command -> what it does, and the plans that it works out.
COMMANDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "climbing": ("climbing features of the map", ("s9_map_features", "g28_frequencies", "k2_geojson")),
    "scenes": ("catalogue search, the pair of scenes, and the scenes with their sidecars", ("s1_catalogue_search", "s2_scene_pair", "r2_boa_offset", "s5_scene_round_trip")),
    "probe": ("usable and missing pixels of each scene", ("g1_scl_histogram", "g2_scene_probe", "r25_probe_flags", "j14_probe_default")),
    "dnbr": ("burn ratios, their difference, classes and areas", ("r4_dnbr", "r5_rdnbr", "r10_masked_class", "g3_class_areas", "g4_burned_total", "g5_scar_overlap", "g6_global_percentiles")),
    "sample": ("severity around each climbing feature", ("g7_feature_sample", "g8_class_counts", "g9_colour_rollup", "k2_geojson")),
    "problems": ("severity by problem, circuit and area", ("j1_problem_areas", "p1_bbox_clip", "g7_feature_sample", "g10_circuit_rollup", "g11_area_rollup", "k3_summary_document")),
    "quicklooks": ("frames with their missing share", ("k12_quicklook_quality", "k6_fixed_stretch", "g29_frame_counts")),
    "vectors": ("paged features and paths", ("s12_landed_pages", "s13_paths")),
    "forest": ("severity by land cover within the footprint", ("j4_wide_masks", "j7_rasterise_polygons", "a8_footprint", "g12_zonal_severity", "g13_threshold_crosstab", "g14_forest_summary")),
    "weather": ("rolling rain, the fire weather index, ranks, winds and the spread", ("s16_dedupe_keep_first", "w1_rolling_rain", "w2_fwi", "w3_top_days", "g16_summer_mean_rank", "g17_percent_below", "g18_vector_wind", "g19_max_gust", "g26_spread_vector")),
    "drivers": ("the model of severity: sample, folds, importance and partial effects", ("r13_slope_aspect", "a7_distance_to_burn", "a9_hashed_sample", "m2_cross_validation", "m3_permutation_importance", "g15_partial_effects")),
    "plume": ("orbits, baselines, anomalies and the ring", ("s20_orbit_fallback", "g20_temporal_median", "g21_anomaly_peak", "g22_field_stats", "g23_ring_deltas", "g24_ring_contrast")),
    "plume_height": ("smoke pixels and their height", ("j5_three_fields", "p9_smoke_predicate", "g25_smoke_height")),
    "export_web": ("layers and points for a page", ("k4_points_payload", "k6_fixed_stretch", "k7_colormap_alpha", "k8_class_palette", "k9_grid_bounds", "g27_histogram")),
    "page": ("a page's table, points with names by code, and sizes", ("k14_page_rows", "a12_dictionary_encode")),
    "chips": ("chips of each fuel with their document", ("a10_chip_location", "k13_fuel_chips", "k13_fuel_meta")),
    "places": ("map labels: merged by name, thinned, within the budget", ("f26_place_labels", "w4_first_by_name", "a11_thin_labels", "k5_places_document")),
}
FORMATS = ("parquet", "csv", "json")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m cinderspark", description="Work out the plans of a command and write their results.")
    out.add_argument("command", choices=[*COMMANDS, "list"], help="; ".join(f"{n}: {t}" for n, (t, _) in COMMANDS.items()))
    out.add_argument("--data", help="folder of the input tables")
    out.add_argument("--out", default="results", help="folder to write to")
    out.add_argument("--format", choices=FORMATS, default="parquet")
    out.add_argument("--only", nargs="*", default=[], help="plans of the command to work out; all by default")
    out.add_argument("--skip-done", action="store_true", help="leave out what is already written")
    return out


def write_result(df: DataFrame, path: str, kind: str) -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to a folder has ended."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def run(spark: SparkSession, command: str, data: str, out: str, kind: str = "parquet", only: Sequence[str] = (), skip_done: bool = False) -> dict:
    """Work out a command; what was written, by plan: path, rows and columns (rows are None for what was skipped)."""
    about, names = COMMANDS[command]
    unknown = set(only) - set(names)
    if unknown:
        raise ValueError(f"{command} has no {', '.join(sorted(unknown))}")
    done = {}
    for name in names:
        if only and name not in only:
            continue
        path = f"{out}/{command}/{name}"
        if skip_done and is_written(spark, path):
            done[name] = {"path": path, "rows": None, "columns": None}
            continue
        df = registry.plans[name](spark, data)
        write_result(df, path, kind)
        back = spark.read.schema(df.schema).format(kind).option("header", True).load(path)
        done[name] = {"path": path, "rows": back.count(), "columns": df.columns}
    return {"command": command, "about": about, "data": data, "results": done}


def main(args: Sequence[str] | None = None) -> int:
    chosen = parser().parse_args(args)
    if chosen.command == "list":
        for name, (about, plans) in COMMANDS.items():
            print(f"{name}: {about} ({', '.join(plans)})")
        return 0
    if not chosen.data:
        parser().error("--data is needed")
    spark = SparkSession.builder.appName(f"cinderspark {chosen.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    summary = run(spark, chosen.command, chosen.data, chosen.out, chosen.format, chosen.only, chosen.skip_done)
    spark.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.mode("overwrite").text(f"{chosen.out}/{chosen.command}/summary.json")
    print(json.dumps(summary))
    return 0
