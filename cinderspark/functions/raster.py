"""Per-pixel expressions: reflectance, burn ratios, severity classes and masks.

Missing values are NULL throughout, never NaN; every division is guarded, as
ANSI mode raises on zero divisors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity bounds on dNBR (lower bound inclusive) and their labels.
SEVERITY_BOUNDS = (-0.25, -0.10, 0.10, 0.27, 0.44, 0.66)
SEVERITY_LABELS = (
    "high regrowth",
    "low regrowth",
    "unburned",
    "low severity",
    "moderate-low severity",
    "moderate-high severity",
    "high severity",
)
BURNED, LOW = 0.27, 0.10
#: Scene classification codes, and those that make a pixel unusable.
SCL_NAMES = (
    "nodata", "saturated", "dark", "shadow", "vegetation", "bare", "water", "unclassified",
    "cloud_medium", "cloud_high", "cirrus", "snow",
)
SCL_UNUSABLE = (0, 1, 3, 8, 9, 10)


def reflectance(dn: Column, offset: Column | float) -> Column:
    """max((dn + offset) / 10000, 0); NULL stays NULL, which ``greatest`` alone would skip."""
    return F.when(dn.isNotNull(), F.greatest((dn + offset) / F.lit(10000.0), F.lit(0.0)))


def boa_offset(applied: Column, baseline: Column) -> Column:
    """0 where the offset is already applied, -1000 from baseline 04.00 on, else 0."""
    version = F.coalesce(baseline, F.lit("00.00")).try_cast("double")
    return F.when(applied.eqNullSafe(F.lit(True)), 0).when(version >= 4, -1000).otherwise(0)


def nbr(nir: Column, swir: Column) -> Column:
    total = nir + swir
    return F.when(F.abs(total) >= 1e-6, (nir - swir) / total)


def rdnbr(nbr_pre: Column, delta: Column, floor: float = 0.001) -> Column:
    return F.when(nbr_pre.isNotNull(), delta / F.sqrt(F.greatest(F.abs(nbr_pre), F.lit(floor))))


def severity_class(delta: Column) -> Column:
    """-1 for no data, else how many bounds are at or below the value (0 to 6)."""
    out = F.lit(0)
    for bound in SEVERITY_BOUNDS:
        out = out + (delta >= bound).cast("int")
    return F.when(delta.isNull(), -1).otherwise(out)


def severity_label(code: Column) -> Column:
    return F.when(code >= 0, F.get(F.array(*map(F.lit, SEVERITY_LABELS)), code))


def at_least(delta: Column, threshold: float = BURNED) -> Column:
    """A mask: no data is below any threshold."""
    return F.coalesce(delta >= threshold, F.lit(False))


def usable(scl: Column) -> Column:
    return ~scl.isin(*SCL_UNUSABLE)


def hectares(pixels: Column, resolution: float = 10.0) -> Column:
    return pixels * F.lit(resolution * resolution) / F.lit(10000.0)


def percent_where(condition: Column) -> Column:
    """Share of rows, in percent, as one exact division of counts."""
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long")) * F.lit(100.0) / F.count(F.lit(1))


def percentile(value: Column, q: float) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(value, F.lit(q))
