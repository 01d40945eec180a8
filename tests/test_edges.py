"""Pictures, pages and paged services."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderspark.sources import images, page
from cinderspark.sources.paged import PagedFeatures


def decoded(path):
    raw = path.read_bytes()
    width, height = struct.unpack(">II", raw[16:24])
    bands = 4 if raw[25] == 6 else 3
    size = struct.unpack(">I", raw[33:37])[0]
    rows = np.frombuffer(zlib.decompress(raw[41 : 41 + size]), np.uint8).reshape(height, 1 + width * bands)
    return rows[:, 1:].reshape(height, width, bands)


def test_pictures(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 0.15, -1), (0, 1, None, 2), (1, 0, 0.9, 3), (1, 1, 0.30, 6)], "y long, x long, v double, cls int")
    rgb = decoded(images.rgb_png(cells, str(tmp_path / "a.png"), ("v", "v", "v"), 2, 2))
    assert rgb[..., 0].tolist() == [[127, 0], [255, 255]]
    ramp = decoded(images.ramp_png(cells, str(tmp_path / "b.png"), "v", 2, 2, clear_below=0.2))
    assert ramp[..., 3].tolist() == [[0, 0], [255, 255]]
    classes = decoded(images.class_png(cells, str(tmp_path / "c.png"), "cls", 2, 2, clear_below=3))
    assert classes[..., 3].tolist() == [[0, 0], [255, 255]] and classes[1, 1, :3].tolist() == [165, 0, 38]
    with pytest.raises(ValueError):
        images.to_array(cells, ["v"], 100_000, 100_000)


def test_page(spark, tmp_path):
    table = spark.createDataFrame([("<b>", 2), ("x", None)], "name string, n int")
    picture = images.write_png(tmp_path / "p.png", np.zeros((1, 1, 3)))
    text = page.build_page("<h1>{{t}}</h1>{{points}}<img src='{{p}}'>", {"t": page.html_table(table, [F.col("name")])}, table, {"p": str(picture)})
    assert "&lt;b&gt;" in text and "data:image/png;base64," in text and '"columns":["name","n"]' in text
    assert page.write_page(tmp_path / "x.html", text) == len(text.encode())
    with pytest.raises(ValueError):
        page.build_page("none", {"t": ""})


def test_overlays_and_figures(spark, tmp_path):
    rows = ["......", ".####.", ".####.", ".####.", "......"]
    mask = spark.createDataFrame([(y, x, c == "#") for y, r in enumerate(rows) for x, c in enumerate(r)], "y long, x long, m boolean")
    edge = images.contour(mask, 5, 6)
    assert ["".join("#" if v else "." for v in r) for r in edge] == ["......", ".####.", ".#..#.", ".####.", "......"]
    points = spark.createDataFrame([(0.5, 0.2), (4.9, 5.0), (-1.0, 2.0), (9.0, 1.0)], "row_f double, col_f double")
    spots = images.marks(points, 5, 6)
    assert spots[:2, :2].all() and spots[3:, 4:].all() and spots.sum() == 8
    picture = images.overlay(np.zeros((5, 6, 3), np.uint8), edge, "#ff0080")
    assert picture.shape == (5, 6, 4) and picture[1, 1].tolist() == [255, 0, 128, 255] and picture[0, 0].tolist() == [0, 0, 0, 255]
    labels = spark.createDataFrame([("A & B", 48.5, 2.25), ("out", 50.0, 2.2)], "name string, lat double, lon double")
    uri = images.data_uri(images.write_png(tmp_path / "o.png", picture))
    figure = page.map_figure(uri, labels, (2.0, 48.0, 3.0, 49.0), [("high <severity>", "#a50026")], "scar")
    assert "left:25.00%;top:50.00%" in figure and "A &amp; B" in figure and "out" not in figure
    assert "high &lt;severity&gt;" in figure and "<figcaption>scar" in figure


def test_maps_are_fetched_over_mirrors(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    from cinderspark.sources import maps

    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            query = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append((urlparse(self.path).path, query))
            busy = self.path.startswith("/busy")
            self.send_response(503 if busy else 200)
            self.end_headers()
            self.wfile.write(b"\x89PNG rest" if query.get("FORMAT") == "image/png" else b"<ServiceException/>")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        here = f"http://127.0.0.1:{server.server_port}"
        got = maps.fetch_map([f"{here}/busy", f"{here}/fine?key=1"], "land", (2.0, 48.0, 3.0, 48.5), 400, tmp_path / "a.png", categories=True, wait=0)
        assert got.read_bytes() == b"\x89PNG rest" and [a for a, _ in asked] == ["/busy", "/fine"]
        assert asked[1][1]["BBOX"] == "48.0,2.0,48.5,3.0" and asked[1][1]["HEIGHT"] == "200" and asked[1][1]["key"] == "1"
        maps.fetch_map([f"{here}/busy"], "land", (2.0, 48.0, 3.0, 48.5), 400, tmp_path / "a.png", categories=True)  # it is there
        assert len(asked) == 2
        with pytest.raises(ValueError):
            maps.fetch_map([f"{here}/fine"], "photo", (2.0, 48.0, 3.0, 48.5), 400, tmp_path / "b.jpg", wait=0)
    finally:
        server.shutdown()


def test_paged_features(spark, tmp_path):
    for n, size in enumerate((3, 3, 1)):
        (tmp_path / f"{n}.json").write_text(json.dumps({"features": [{"id": 10 * n + k} for k in range(size)]}))
    spark.dataSource.register(PagedFeatures)
    load = lambda pages: spark.read.format("paged_features").option("url", f"file://{tmp_path}/{{page}}.json").option("count", 3).option("pages", pages).option("wait", 0).option("tries", 1).load()
    got = load(5).select("page", F.get_json_object("feature", "$.id").alias("id"), "truncated").collect()
    assert sorted((r.page, int(r.id)) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 10), (1, 11), (1, 12), (2, 20)]
    assert not any(r.truncated for r in got)
    assert load(2).where("truncated").count() == 3
    every = spark.read.format("paged_features").option("url", f"file://{tmp_path}/none/{{page}}.json file://{tmp_path}/{{page}}.json").option("count", 3).option("wait", 0)
    assert every.load().count() == 7  # a mirror that fails hands over, and the pages end where one is short
    for n in range(2, 9):
        (tmp_path / f"{n}.json").write_text(json.dumps({"features": [{"id": 10 * n + k} for k in range(3)]}))
    assert every.load().count() == 27
    (tmp_path / "0.json").write_text('{"features": []}')
    with pytest.raises(Exception, match="empty"):
        every.load().count()


def test_landed_pages(spark):
    from cinderspark.sources import readers

    doc = lambda n: json.dumps({"features": [{"id": k} for k in range(n)]})
    made = lambda *sizes: readers.landed_pages(spark.createDataFrame([(p, doc(n)) for p, n in sizes], "page int, value string"), 3)
    got = lambda rows: (rows.count(), {r.truncated for r in rows.collect()})
    assert got(made((0, 3), (1, 3), (2, 1))) == (7, {False})
    assert got(made((0, 3), (1, 2), (2, 3))) == (5, {False})  # what follows a short page doesn't count
    assert got(made((0, 3), (2, 3))) == (3, {True}) and got(made((0, 3), (1, 3))) == (6, {True})
    assert got(made((0, 1))) == (1, {False})
    with pytest.raises(Exception, match="empty"):
        made((0, 0), (1, 3)).collect()


def test_scenes_are_written_once(spark, tmp_path):
    from cinderspark.sources import sinks

    cells = spark.createDataFrame([(s, y, 0, y % 2, 0.5) for s in ("a", "b") for y in range(3)], "scene_id string, y long, x long, scl int, nir double")
    path = str(tmp_path / "scenes")
    assert [sinks.write_scenes_once(cells.where("scene_id = 'a'"), path, "scl", ["nir"]), sinks.write_scenes_once(cells, path, "scl", ["nir"]), sinks.write_scenes_once(cells, path, "scl", ["nir"])] == [1, 1, 0]
    assert spark.read.parquet(f"{path}/scenes").count() == 6
    assert {r.scene_id: r.document for r in spark.read.json(f"{path}/sidecars").collect()}["a"] == '{"pixels":3,"scl_pct":{"0":66.67,"1":33.33}}'
    with pytest.raises(KeyError):
        sinks.write_scenes_once(cells, path, "scl", ["swir"])
