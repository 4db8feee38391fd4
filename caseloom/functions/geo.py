"""Place names to coordinates by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: (pattern over the lower-cased place, latitude, longitude); the first match counts
PLACE_RULES: list[tuple[str, float, float]] = [
    (r"kazakhstan", 48.0196, 66.9237),
    (r"papua new guinea", -6.315, 143.9555),
    (r"(?<![a-z0-9_])georgia(?![a-z0-9_])", 32.1656, -82.9001),
    (r"mexico", 23.6345, -102.5528),
    (r"middle east", 29.2985, 42.551),
    (r"united states|usa|u\.s\.", 37.0902, -95.7129),
    (r"nevada", 38.8026, -116.4194),
    (r"new mexico", 34.5199, -105.8701),
    (r"arizona", 34.0489, -111.0937),
    (r"california", 36.7783, -119.4179),
    (r"florida", 27.6648, -81.5158),
    (r"atlantic", 31.0, -45.0),
    (r"pacific", 8.7832, -124.5085),
    (r"russia|moscow", 55.7558, 37.6173),
    (r"china|beijing", 39.9042, 116.4074),
    (r"ukraine|kyiv", 50.4501, 30.5234),
    (r"united kingdom|london|uk", 51.5074, -0.1278),
    (r"germany|berlin", 52.52, 13.405),
    (r"france|paris", 48.8566, 2.3522),
    (r"iran|tehran", 35.6892, 51.389),
    (r"north korea", 39.0392, 125.7625),
    (r"south korea", 37.5665, 126.978),
    (r"japan|tokyo", 35.6762, 139.6503),
    (r"australia|sydney", -33.8688, 151.2093),
    (r"brazil", -14.235, -51.9253),
]


def geo_point(place: Column, rules: list[tuple[str, float, float]] | None = None) -> Column:
    """Struct (lat, lon) of the first rule matching ``place``; NULL without a match."""
    low = F.lower(place)
    points = [
        F.when(low.rlike(pattern), F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon")))
        for pattern, lat, lon in (rules or PLACE_RULES)
    ]
    return F.coalesce(*points)
