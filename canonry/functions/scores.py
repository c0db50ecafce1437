"""Distances and similarity scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canonry.config import DEFAULT, EARTH_KM, MatchConfig


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def decay(km: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), km / half_life)


def stars_score(a: Column, b: Column) -> Column:
    """Linear; 0 if either is missing.  Null, never NaN, stands for missing."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / 2), F.lit(0.0))


def stretch(similarity: Column, cfg: MatchConfig = DEFAULT) -> Column:
    return F.greatest(F.lit(0.0), (similarity - cfg.similarity_floor) / cfg.similarity_span)


def dice(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / F.greatest(total, F.lit(1))).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def disjoint(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
