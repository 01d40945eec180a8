"""One self-contained HTML page from small result tables, a points payload and pictures."""

from __future__ import annotations

from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import data_uri
from .sinks import payload

#: Rows of a table on a page, at most: pages show top lists.
MOST_ROWS = 100


def html_table(df: DataFrame, order: list, rows: int = 20) -> str:
    """The first rows in an order, escaped; missing values are empty."""
    shown = df.orderBy(*order).limit(min(rows, MOST_ROWS)).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    cell = lambda v: "" if v is None else escape(str(v))
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in shown)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def legend(entries: list[tuple[str, str]]) -> str:
    """(label, colour) pairs as a list, escaped."""
    items = "".join(f'<li><span style="background:{escape(c, True)}">&nbsp;</span> {escape(n)}</li>' for n, c in entries)
    return f'<ul class="legend">{items}</ul>'


def map_figure(picture: str, labels: DataFrame, bounds: tuple[float, float, float, float], entries: list[tuple[str, str]], caption: str) -> str:
    """A picture (data URI) with a legend and labels (name, lat, lon) at their places, in percent of the picture's box
    (west, south, east, north); labels outside it are left out."""
    w, s, e, n = bounds
    inside = labels.where(F.col("lon").between(w, e) & F.col("lat").between(s, n)).orderBy("name", "lat", "lon").limit(2 * MOST_ROWS)
    spots = "".join(
        f'<span style="position:absolute;left:{100 * (r.lon - w) / (e - w):.2f}%;top:{100 * (n - r.lat) / (n - s):.2f}%">{escape(r["name"])}</span>'
        for r in inside.select("name", "lat", "lon").collect()
    )
    return f'<figure style="position:relative"><img src="{picture}" alt="{escape(caption, True)}">{spots}{legend(entries)}<figcaption>{escape(caption)}</figcaption></figure>'


def build_page(template: str, tables: dict[str, str], points: DataFrame | None = None, pictures: dict[str, str] | None = None) -> str:
    """Fill ``{{name}}`` places of a template with tables, the points document and pictures as data URIs."""
    parts = dict(tables)
    if points is not None:
        parts["points"] = payload(points, points.columns).first().document.replace("</", "<\\/")
    parts.update({name: data_uri(path) for name, path in (pictures or {}).items()})
    for name, value in parts.items():
        place = "{{" + name + "}}"
        if place not in template:
            raise ValueError(f"the template has no place {place}")
        template = template.replace(place, value)
    return template


def write_page(path: str | Path, page: str) -> int:
    """Write the page; its size in bytes."""
    return Path(path).write_bytes(page.encode())
