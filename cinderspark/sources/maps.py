"""Pictures of map services: the address of a map, and fetching it over mirrors."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import urlencode

from .paged import fetch

#: First bytes of the formats that are asked for.
SIGNS = {"image/png": b"\x89PNG", "image/jpeg": b"\xff\xd8"}


def map_query(layer: str, bounds: tuple[float, float, float, float], width: int, height: int, categories: bool, style: str = "") -> str:
    """The query of a map in longitude and latitude (bounds: west, south, east, north).

    Categories come without loss, so that their colours stay apart; pictures come as JPEG.
    """
    w, s, e, n = bounds
    kind = "image/png" if categories else "image/jpeg"
    return urlencode(
        {
            "SERVICE": "WMS", "VERSION": "1.3.0", "REQUEST": "GetMap", "LAYERS": layer, "STYLES": style, "CRS": "EPSG:4326",
            "BBOX": f"{s},{w},{n},{e}", "WIDTH": width, "HEIGHT": height, "FORMAT": kind, "TRANSPARENT": "TRUE" if categories else "FALSE",
        }
    )


def fetch_map(
    services: list[str], layer: str, bounds: tuple[float, float, float, float], width: int, path: str | Path, categories: bool = False, wait: float = 10.0
) -> Path:
    """Fetch a map from the first of some services that answers and write it; its height follows the box.

    A file that is there is kept.  What isn't a picture of the asked kind (a service's report of an error) is an error.
    """
    target = Path(path)
    if target.exists():
        return target
    w, s, e, n = bounds
    height = max(1, round(width * (n - s) / (e - w)))
    query = map_query(layer, bounds, width, height, categories)
    body = fetch([f"{u}{'&' if '?' in u else '?'}{query}" for u in services], wait=wait)
    if not body.startswith(SIGNS["image/png" if categories else "image/jpeg"]):
        raise ValueError(f"no picture, but: {body[:200]!r}")
    part = target.with_suffix(target.suffix + ".part")
    part.write_bytes(body)
    return part.rename(target)
