"""All registered plans."""

from . import feature_plans, label_plans, plume_plans, raster_plans, shape_plans, source_plans, weather_plans  # noqa: F401
from .registry import registry

__all__ = ["registry"]
