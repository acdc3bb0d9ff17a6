"""Geography as plain expressions over latitude and longitude in degrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek.nodes import Geo
from sparkseek.semantics import EARTH_RADIUS_M


def distance(lat: Column, lon: Column, origin: Geo) -> Column:
    """Metres along the sphere (haversine)."""
    a, b = F.radians(lat), F.radians(F.lit(origin.lat))
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon) - F.radians(F.lit(origin.lon))) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_box(lat: Column, lon: Column, top_left: Geo, bottom_right: Geo) -> Column:
    """A box whose left is east of its right crosses the antimeridian."""
    rows = (lat <= top_left.lat) & (lat >= bottom_right.lat)
    if top_left.lon <= bottom_right.lon:
        return rows & lon.between(top_left.lon, bottom_right.lon)
    return rows & ((lon >= top_left.lon) | (lon <= bottom_right.lon))


def in_ring(lat: Column, lon: Column, ring: Sequence[Geo]) -> Column:
    """Even-odd rule: whether a ray to the east crosses an odd number of edges; an open ring is closed."""
    crossings = F.lit(0)
    for a, b in zip(ring, [*ring[1:], ring[0]]):
        if a.lat == b.lat:
            continue
        at = F.lit(a.lon) + (lat - a.lat) * ((b.lon - a.lon) / (b.lat - a.lat))
        crossings = crossings + F.when(((lat < a.lat) != (lat < b.lat)) & (lon < at), 1).otherwise(0)
    return crossings % 2 == 1


def in_polygon(lat: Column, lon: Column, exterior: Sequence[Geo], interiors: Sequence[Sequence[Geo]]) -> Column:
    inside = in_ring(lat, lon, exterior)
    for hole in interiors:
        inside = inside & ~in_ring(lat, lon, hole)
    return inside
