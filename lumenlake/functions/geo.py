"""Geography on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat_a: Column | str, lon_a: Column | str, lat_b: Column | str, lon_b: Column | str) -> Column:
    """Great-circle distance in km; null if any coordinate is."""
    la, lo, lb, lob = (F.radians(_c(x)) for x in (lat_a, lon_a, lat_b, lon_b))
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin((lob - lo) / 2), 2)
    # greatest/least skip nulls, so the null test comes first
    return F.when(h.isNotNull(), F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))))


def haversine_m(lat_a: Column | str, lon_a: Column | str, lat_b: Column | str, lon_b: Column | str) -> Column:
    return haversine_km(lat_a, lon_a, lat_b, lon_b) * 1000.0
