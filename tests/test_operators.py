"""Operators on hand-worked grids, series and labels."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cinderspark.functions import geo, raster as R, text as T, weather as fw
from cinderspark.operators import fireweather, graph, labels as L, morphology as M, resample, sampling, spatial, zonal
from cinderspark.plans import plume_plans, source_plans
from cinderspark.sources import readers, sinks
from cinderspark.streaming import weather as stream


def grid(spark, rows):
    cells = [(y, x, c == "#") for y, row in enumerate(rows) for x, c in enumerate(row)]
    return spark.createDataFrame(cells, "y long, x long, m boolean")


def drawn(mask, height, width):
    true = {(r.y, r.x) for r in mask.where("m").collect()}
    return ["".join("#" if (y, x) in true else "." for x in range(width)) for y in range(height)]


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


@pytest.mark.parametrize(
    "value,code",
    [(None, -1), (-0.26, 0), (-0.25, 1), (-0.10, 2), (0.0999, 2), (0.10, 3), (0.2699, 3), (0.27, 4), (0.44, 5), (0.66, 6), (2.0, 6)],
)
def test_class_bounds(spark, value, code):
    assert one(spark, c=R.severity_class(F.lit(value).cast("double")))["c"] == code


def test_reflectance_and_ratios(spark):
    got = one(
        spark,
        dark=R.reflectance(F.lit(500), F.lit(-1000)),
        none=R.reflectance(F.lit(None).cast("int"), F.lit(0)),
        zero=R.nbr(F.lit(0.0), F.lit(0.0)),
        rel=R.rdnbr(F.lit(0.0), F.lit(0.1)),
        off=R.boa_offset(F.lit(None).cast("boolean"), F.lit("04.00")),
        odd=R.boa_offset(F.lit(False), F.lit("abc")),
        done=R.boa_offset(F.lit(True), F.lit("05.10")),
        mask=R.at_least(F.lit(None).cast("double")),
    )
    assert got == {"dark": 0.0, "none": None, "zero": None, "rel": pytest.approx(0.1 / math.sqrt(0.001)), "off": -1000, "odd": 0, "done": 0, "mask": False}


def test_closing_clears_what_it_cannot_support(spark):
    rows = ["........", ".##.##..", ".##.##..", ".##.##..", "........", "........", "........", "........"]
    closed = drawn(M.close(grid(spark, rows), 1), 8, 8)
    assert closed[1:4] == [".#####.."] * 3  # the gap closes
    edge = ["###", "###", "###"]
    assert drawn(M.close(grid(spark, edge), 1), 3, 3) == ["...", ".#.", "..."]  # outside counts as False


def test_holes_and_labels(spark):
    rows = ["######...", "#....#..#", "#.##.#.#.", "#.##.#...", "#....#..#", "######.##"]
    filled = drawn(M.fill_holes(grid(spark, rows)), 6, 9)
    assert filled == ["######...", "######..#", "######.#.", "######...", "######..#", "######.##"]
    four = {(r.y, r.x): r.label for r in M.label(grid(spark, rows)).collect()}
    assert len(set(four.values())) == 5
    eight = {(r.y, r.x): r.label for r in M.label(grid(spark, rows), diagonal=True).collect()}
    assert len(set(eight.values())) == 4
    assert drawn(M.keep_large(grid(spark, rows), 4), 6, 9)[2] == "#.##.#..."
    assert {(r.y, r.x) for r in M.largest(grid(spark, ["#.##", "..##"])).collect()} == {(0, 2), (0, 3), (1, 2), (1, 3)}
    assert M.largest(grid(spark, ["..", ".."])).count() == 0


def test_labels_across_tiles(spark, monkeypatch):
    """Components of a random mask and of a spiral, cut into tiles of 3 columns, against a flood."""
    monkeypatch.setattr(M, "TILE", 3)
    rng = np.random.default_rng(5)
    spiral = ["###########", "..........#", "#########.#", "#.......#.#", "#.#####.#.#", "#.#...#.#.#", "#.###.#.#.#", "#.....#.#.#", "#######.#.#", "........#.#", "#########.#"]
    masks = [rng.random((13, 16)) < p for p in (0.6,)] + [np.array([[c == "#" for c in r] for r in spiral])]
    for m in masks:
        cells = spark.createDataFrame([(y, x, bool(v)) for (y, x), v in np.ndenumerate(m)], "y long, x long, m boolean")
        for diagonal in (False, True):
            near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if diagonal or abs(dy) + abs(dx) == 1]
            want, label = {}, None
            for start in map(tuple, np.argwhere(m)):
                if start in want:
                    continue
                label, todo = (int(start[0]) << 31) + int(start[1]), [start]
                while todo:
                    y, x = todo.pop()
                    if (y, x) not in want and 0 <= y < m.shape[0] and 0 <= x < m.shape[1] and m[y, x]:
                        want[y, x] = label
                        todo += [(y + dy, x + dx) for dy, dx in near]
            assert {(r.y, r.x): r.label for r in M.label(cells, diagonal).collect()} == {(int(y), int(x)): v for (y, x), v in want.items()}


def test_distance(spark):
    rng = np.random.default_rng(2)
    m = rng.random((12, 17)) < 0.05
    cells = [(y, x, bool(m[y, x])) for y in range(12) for x in range(17)]
    got = M.distance(spark.createDataFrame(cells, "y long, x long, m boolean"), 10.0).collect()
    true = np.argwhere(m)
    for r in got:
        want = 10 * math.sqrt(((true - (r.y, r.x)) ** 2).sum(1).min())
        assert r.distance == pytest.approx(want)
    assert {r.distance for r in M.distance(grid(spark, ["..", ".."])).collect()} == {None}


def test_distance_of_tall_wide_and_ragged_grids(spark, capsys):
    rng = np.random.default_rng(4)
    for height, width, share, kept, y0 in ((150, 5, 0.02, 0.8, -70), (3, 150, 0.01, 1.0, 62), (140, 40, 0.0005, 0.3, 0), (130, 6, 0.01, 1.0, 64 * 10**9)):
        given = rng.random((height, width)) < kept
        m = (rng.random((height, width)) < share) & given
        m[tuple(np.argwhere(given)[0])] = True
        cells = [(int(y) + y0, 3 * int(x) if kept < 0.5 else int(x), bool(m[y, x])) for y, x in np.argwhere(given)]
        got = {(r.y, r.x): r.sq for r in M.squared_distance(spark.createDataFrame(cells, "y long, x long, m boolean")).collect()}
        true = np.array([(y, x) for y, x, some in cells if some])
        assert got == {(y, x): int(((true - (y, x)) ** 2).sum(1).min()) for y, x, _ in cells}
    odd = [(None, 0, True), (None, 0, False), (0, 0, None), (0, 2, True), (0, 2, True)]
    got = M.squared_distance(spark.createDataFrame(odd, "y long, x long, m boolean")).collect()
    assert sorted((r.x, str(r.y), r.sq) for r in got) == [(0, "0", 4), (0, "None", None), (2, "0", 0)]
    # a frame that ends below every row is read again for each of them
    M.squared_distance(grid(spark, ["#."])).explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_ring_contrast_is_exact_in_any_order(spark):
    # the mean of the sixteen is 0.0005625, a tie at six digits; a floating sum misses it in some orders
    units = [41, -3, 17, -29, 8, 33, -12, 5, 26, -7, 14, -38, 19, 2, -11, 25]
    places = [(radius, 45 * k) for radius in (25, 60) for k in range(8)]
    points = [(r, b, u / 10000) for (r, b), u in zip(places, units)] + [(0, -1, 0.5)]
    rng = random.Random(3)
    for _ in range(8):
        rng.shuffle(points)
        got = plume_plans.contrast(spark.createDataFrame(points, "radius int, bearing int, delta double").coalesce(1)).first()
        assert (got.downwind, got.upwind, got.ring_mean) == (0.0003, 0.000525, 0.000562)
    assert tuple(plume_plans.contrast(spark.createDataFrame([], "radius int, bearing int, delta double")).first()) == (None, None, None)


def test_page_rows_keep_the_sign_of_small_medians(spark, monkeypatch):
    medians = {"A": -0.0003, "B": 0.0003, "C": -0.0025, "D": 0.0}
    rows = [(10 * k + n, name, "RED", True, v, False) for k, (name, v) in enumerate(medians.items()) for n in range(5)]
    features = spark.createDataFrame(rows, "id long, area_name string, colour string, in_aoi boolean, dnbr_median double, edge boolean")
    monkeypatch.setattr(source_plans, "sampled", lambda spark, sf_dir: features)
    monkeypatch.setattr(source_plans, "problems", lambda spark, sf_dir: features)
    page = source_plans.k14(spark, "").first()
    shown = [("B", "0.0"), ("D", "0.0"), ("A", "-0.0"), ("C", "-0.002")]
    assert page.html == "<table>" + "".join(f"<tr><td>{a}</td><td>RED</td><td>5</td><td>0.0</td><td>{v}</td></tr>" for a, v in shown) + "</table>"
    assert page.html_bytes == len(page.html)
    assert "[0,0,0.0]" in page.points  # the points' zeros have no sign


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)]
    parent = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    touched = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: root(v) for v in touched}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_window_sample(spark):
    cells = [(y, x, 0.1 * y - 0.05 * x if (y, x) != (3, 3) else None, x != 4) for y in range(8) for x in range(8)]
    pixels = spark.createDataFrame(cells, "y long, x long, dnbr double, ok boolean")
    features = spark.createDataFrame([(1, 3.5, 3.4), (2, 0.0, 7.4), (3, 7.6, 1.0), (4, 2.5, 4.0)], "id long, row_f double, col_f double")
    got = {r.id: r for r in sampling.sample(features, pixels, 8, 8).collect()}
    assert not got[3].in_aoi and got[3].n_px is None  # 7.6 rounds off the grid

    def values(ry, rx):
        near = [(v, ok) for y, x, v, ok in cells if abs(y - ry) <= 2 and abs(x - rx) <= 2]
        return [v for v, ok in near if ok and v is not None]

    for i, ry, rx in ((1, 4, 3), (2, 0, 7), (4, 2, 4)):  # halves round to even
        v = values(ry, rx)
        assert got[i].n_px == len(v)
        assert got[i].dnbr_median == pytest.approx(np.median(v), abs=1e-4)
        assert got[i].dnbr_p75 == pytest.approx(np.percentile(v, 75), abs=1e-4)
    blind = pixels.withColumn("ok", F.lit(False))
    assert sampling.sample(features, blind, 8, 8).where("id = 2").first().n_px == 9  # no usable cell: all count


def test_quantile_bins(spark):
    rows = spark.createDataFrame([(float(v), float(v)) for v in [1, 1, 1, 1, 2, 3, 4, 5]], "x double, y double")
    got = {r.bin: r.size for r in zonal.quantile_bins(rows, "x", "y", 4).collect()}
    edges = np.unique(np.percentile([1, 1, 1, 1, 2, 3, 4, 5], [0, 25, 50, 75, 100]))
    cut = pd.cut([1, 1, 1, 1, 2, 3, 4, 5], edges, include_lowest=True, labels=False) + 1
    assert got == pd.Series(cut).value_counts().to_dict()


def test_fwi_known_values():
    """The worked example published with the index: 13 April, 17 degrees, 42 %, 25 km/h, no rain."""
    ffmc = fw.fine_fuel(17, 42, 25, 0, 85)
    dmc = fw.duff(17, 42, 0, 6, 4)
    dc = fw.drought(17, 0, 15, 4)
    isi, bui = fw.initial_spread(ffmc, 25), fw.buildup(dmc, dc)
    assert [round(v, 1) for v in (ffmc, dmc, dc, isi, bui, fw.fire_weather(isi, bui))] == [87.7, 8.5, 19.0, 10.9, 8.5, 10.1]
    assert fw.buildup(0.1, 0.0) >= 0 and fw.buildup(0, 0) == 0


def noon(spark):
    days = pd.date_range("2026-04-01 11:00", periods=40, freq="D")
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"station": "a", "ts": days, "temp": rng.uniform(5, 30, 40), "rh": rng.uniform(20, 105, 40), "wind": rng.uniform(0, 30, 40), "rain24": rng.choice([0, 0.5, 1.5, 2.8, 9.0], 40)})
    return pd.concat([frame, frame.assign(station="b", temp=frame["temp"] / 2)])


def test_streaming_index_equals_batch(spark, tmp_path):
    frame = noon(spark)
    source = tmp_path / "in"
    source.mkdir()
    ordered = frame.sort_values(["ts", "station"])
    for k in range(4):
        again = ordered.iloc[:2] if k == 2 else ordered.iloc[:0]  # a day that was folded before comes again
        pd.concat([again, ordered.iloc[k * 20 : (k + 1) * 20]]).astype({"ts": "datetime64[us]"}).to_parquet(source / f"{k}.parquet")
    batch = fireweather.fire_weather_index(spark.createDataFrame(frame)).toPandas()
    rows = spark.readStream.schema("station string, ts timestamp, temp double, rh double, wind double, rain24 double").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = stream.streaming_fwi(rows).writeStream.format("memory").queryName("fwi_stream").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("fwi_stream").toPandas().sort_values(["station", "ts"])
    want = batch.sort_values(["station", "date"])
    assert got["fwi"].tolist() == want["fwi"].tolist() and got["dc"].tolist() == want["dc"].tolist()
    assert got.groupby("station")["late"].max().tolist() == [1, 1] and got["late"].min() == 0


def test_streaming_windows_and_first_readings(spark, tmp_path):
    source = tmp_path / "in"
    times = pd.Series(pd.date_range("2026-07-01", periods=240, freq="10min")).astype("datetime64[us]")
    source.mkdir()
    pd.DataFrame({"station": "a", "ts": pd.concat([times, times], ignore_index=True), "value": np.arange(480.0)}).to_parquet(source / "r.parquet")
    rows = spark.readStream.schema("station string, ts timestamp, value double").parquet(str(source))
    for name, made in (("means", stream.hourly_means(rows)), ("firsts", stream.first_readings(rows))):
        made.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("firsts").count() == 240
    assert spark.table("means").where("n = 12").count() >= 35


def test_circular_mean(spark):
    winds = spark.createDataFrame([(5.0, 350.0), (5.0, 10.0)], "s double, d double")
    b, s = fw.vector_mean(F.col("s"), F.col("d"))
    row = winds.agg(b.alias("b"), s.alias("s")).first()
    assert min(row.b, 360 - row.b) < 1e-9 and row.s == pytest.approx(5 * math.cos(math.radians(10)))
    assert one(spark, c=fw.danger_class(F.lit(None).cast("double")))["c"] == "extreme"
    assert one(spark, c=fw.danger_class(F.lit(-1.0)))["c"] == "extreme"


def test_polygons(spark):
    square = [(1.2, 1.2), (4.8, 1.2), (4.8, 3.8), (1.2, 3.8)]
    tri = [(3.0, 2.0), (8.0, 2.0), (3.0, 7.0)]
    shapes = spark.createDataFrame([(0, 7, square), (1, 9, tri), (2, 5, [])], "seq int, code int, ring array<struct<x:double,y:double>>")
    got = {(r.y, r.x): r.code for r in spatial.rasterise(shapes, 10, 10).collect()}

    def inside(ring, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    want = {}
    for code, ring in ((7, square), (9, tri)):
        want.update({(y, x): code for y in range(10) for x in range(10) if inside(ring, x + 0.5, y + 0.5)})
    assert got == want
    lines = spark.createDataFrame([(0.5, 0.5, 3.5, 0.5), (2.5, 1.5, 2.5, 3.5)], "x0 double, y0 double, x1 double, y1 double")
    assert {(r.y, r.x) for r in spatial.burn_lines(lines, 10, 10).collect()} == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 2), (2, 2), (3, 2)}


def test_utm(spark):
    """Paris observatory and the zone's meridian."""
    x, y = geo.utm_forward(F.lit(3.0), F.lit(0.0), 31)
    assert one(spark, x=x, y=y) == {"x": pytest.approx(500000), "y": pytest.approx(0, abs=1e-6)}
    x, y = geo.utm_forward(F.lit(2.294694), F.lit(48.858093), 31)
    got = one(spark, x=x, y=y)
    assert got["x"] == pytest.approx(448266, abs=1.5) and got["y"] == pytest.approx(5411921, abs=3)
    assert one(spark, e=geo.utm_epsg(F.lit(2.5), F.lit(48.0)))["e"] == 32631
    assert one(spark, d=geo.angle_between(F.lit(350.0), F.lit(10.0)))["d"] == 20


def test_resampling(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, None)], "y long, x long, v double")
    at = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 1.0), (3, 1.0, 1.0), (4, 9.0, 9.0)], "id int, row_f double, col_f double")
    got = {r.id: r.v for r in resample.bilinear(at, cells, "v", ["id"]).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 3.0}
    assert {r.id: r.v for r in resample.nearest(at, cells, "v", ["id"]).collect()} == {1: 1.0, 2: 3.0, 3: None}


def test_places(spark):
    nodes = [("Ville", "town", "12 000", 48.4, 2.5), ("Petit", "village", "120", 48.41, 2.6), ("Carrefour du Roi", "locality", None, 48.3, 2.4),
             ("Mont A", "peak", None, 48.45, 2.7), ("Mont B", "peak", None, 48.4501, 2.7), ("ville!", "hamlet", "700", 48.2, 2.2), (None, "town", None, 1.0, 1.0), ("X", "shop", None, 1.0, 1.0)]
    made = L.place_labels(spark.createDataFrame(nodes, "name string, place string, population string, lat double, lon double"))
    got = {r.name: (r.kind, r.rank, r.pop, r.src) for r in made.collect()}
    assert got == {"Ville": ("town", 0, 12000, "place"), "Petit": ("village", 3, 120, "place"), "Mont A": ("sector", 5, 0, "landmark"), "Mont B": ("sector", 5, 0, "landmark"), "ville!": ("hamlet", 4, 700, "place")}
    merged = L.first_by_name(made)
    assert {r.name for r in merged.collect()} == {"Ville", "Petit", "Mont A", "Mont B"}
    one_map = merged.withColumn("map", F.lit(1))
    assert [r.name for r in L.thin(one_map, "map").collect()] in (["Ville", "Petit", "Mont A"], ["Ville", "Petit", "Mont B"])  # the peaks are 11 m apart
    only = one_map.where("src = 'landmark'")
    assert L.thin(only, "map").count() == 1
    assert [r.name for r in L.thin(one_map, "map", cap=1).collect()] == ["Ville"]
    both = one_map.unionByName(only.withColumn("map", F.lit(2)))
    assert sorted((r.map, r.name.split()[0]) for r in L.thin(both, "map").collect()) == [(1, "Mont"), (1, "Petit"), (1, "Ville"), (2, "Mont")]
    assert one(spark, s=L.sheet(F.lit(48.3), F.lit(-2.5)))["s"] == "48/-4"
    assert one(spark, p=T.population(F.lit("1234 (2019)")), q=T.population(F.lit(None).cast("string")), s=T.slug(F.lit("Forêt fermée / conifères"))) == {"p": 12342019, "q": 0, "s": "foret_fermee___coniferes"}


def test_slugs_fold_as_decomposition_does(spark):
    import unicodedata

    names = ["Forêt fermée / conifères", "Nguyễn Ái Quốc", "ﬁne ﬂow ½ ﷺ", "Łódź", "Ⅷ ① ㎏ ㍿", "ａｂｃ", "straße", "日本 x", "𝐀𝐁", "", " a  b ", "İstanbul"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", T.ascii_fold(F.col("name")).alias("folded"), T.slug(F.col("name")).alias("slug"))
    for r in rows.collect():
        want = unicodedata.normalize("NFKD", r.name).encode("ascii", "ignore").decode()
        assert r.folded == want, r.name
        assert r.slug == "_".join(want.lower().split()).replace("/", "_")


def test_readers_and_sinks(spark, tmp_path):
    item = '{"features":[{"id":"a","bbox":[2.0,48.0,2.3,48.3],"properties":{"datetime":"2026-07-10T10:00:00Z","eo:cloud_cover":12.5},"assets":{"red":{"href":"r"}}}]}'
    items = readers.stac_items(spark.createDataFrame([(item,)], "value string"))
    ts = lambda v: F.to_timestamp(F.lit(v))
    assert readers.search(items, ts("2026-07-01"), ts("2026-08-01"), (2.2, 48.2, 2.6, 48.5), 20).count() == 1
    assert readers.search(items, ts("2026-07-01"), ts("2026-08-01"), (2.2, 48.2, 2.6, 48.5), 12.5).count() == 0  # strictly below
    assert [r.asset for r in readers.missing_assets(items, ["red", "nir"]).collect()] == ["nir"]
    table = spark.createDataFrame([(1, "x,y", 2.5, 48.1)], "id long, name string, lon double, lat double")
    sinks.write_csv(table, str(tmp_path / "c"))
    sinks.write_geojson(table, str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().name == "x,y"
    assert '"coordinates":[2.5,48.1]' in spark.read.text(str(tmp_path / "g")).first().value
    row = sinks.payload(table, ["id", "name"], limit_bytes=10).first()
    assert row.over and row.document.startswith('{"columns":["id","name"]')


def test_exact_quantiles(spark, monkeypatch):
    from cinderspark.operators import quantiles as Q

    monkeypatch.setattr(Q, "PARTS", 7)  # many rounds
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"k": rng.integers(0, 3, 4000), "v": np.round(rng.normal(size=4000), 3)})
    frame.loc[frame.k == 1, "v"] = rng.choice([1.0, 2.0, 2.0, 2.0], (frame.k == 1).sum())  # a value with most rows
    frame.loc[frame.k == 2, "v"] = rng.choice([-1.7e308, 5e-324, 1e-323, 0.0, 1.7e308], (frame.k == 2).sum())  # widest and narrowest brackets
    frame["w"] = np.arange(4000.0)
    qs = [0.0, 0.02, 0.5, 0.9, 1.0]
    more = [(0, None, None), (7, None, 1.0), (None, 4.0, None), (None, 8.0, None)]
    rows = spark.createDataFrame(frame).unionByName(spark.createDataFrame(more, "k long, v double, w double"))
    for small in (10**6, 10, 0):
        got = {r.k: r for r in Q.exact_quantiles(rows, ["k"], {"v": qs, "w": [0.25]}, small).collect()}
        for k in (0, 1):
            assert got[k].v == pytest.approx(np.percentile(frame.v[frame.k == k], [100 * q for q in qs]).tolist())
            assert got[k].w == pytest.approx([np.percentile(frame.w[frame.k == k], 25)])
        assert got[2].v[0] == -1.7e308 and got[2].v[-1] == 1.7e308 and got[2].v[2] in (5e-324, 1e-323, 0.0)
        assert got[7].v == [None] * 5 and got[7].w == [1.0]
        assert got[None].v == pytest.approx([4.0, 4.08, 6.0, 7.6, 8.0]) and got[None].w == [None]
        whole = Q.exact_quantiles(rows, [], {"w": [0.5]}, small).collect()
        assert [r.w for r in whole] == [[pytest.approx(np.median([*frame.w, 1.0]))]]
