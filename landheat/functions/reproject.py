"""Universal transverse Mercator to latitude and longitude, in column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The WGS 84 ellipsoid and the projection's scale and false easting.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING = 0.9996, 500000.0


def utm_zone(citation: Column) -> Column:
    """The zone number after "UTM zone ", 0 if there is none."""
    return F.coalesce(F.regexp_extract(citation, r"UTM zone (\d+)", 1).try_cast("int"), F.lit(0))


def with_lat_lon(df: DataFrame, x: str, y: str, zone: str) -> DataFrame:
    """Adds lat and lon in degrees of northern coordinates x, y: the inverse series about the footprint latitude.

    Values that later ones use several times get columns of their own, so that each is computed once a row and the
    generated code stays short. Rows whose zone is 0 are in degrees already.
    """
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    waves = (3 * e1 / 2 - 27 * e1**3 / 32, 21 * e1**2 / 16 - 55 * e1**4 / 32, 151 * e1**3 / 96, 1097 * e1**4 / 512)
    out = df.withColumn("__mu", F.col(y) / (SCALE * SEMI_MAJOR * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)))
    foot = F.col("__mu")
    for k, wave in enumerate(waves):
        foot = foot + wave * F.sin(F.col("__mu") * (2 * k + 2))
    out = out.withColumn("__foot", foot)
    out = out.withColumns({"__sin": F.sin("__foot"), "__cos": F.cos("__foot"), "__tan": F.tan("__foot")})
    out = out.withColumns({"__bent": 1 - e2 * F.col("__sin") * F.col("__sin"), "__t": F.col("__tan") * F.col("__tan"), "__c": ep2 * F.col("__cos") * F.col("__cos")})
    n = SEMI_MAJOR / F.sqrt("__bent")
    out = out.withColumns({"__n": n, "__r": SEMI_MAJOR * (1 - e2) / F.pow("__bent", F.lit(1.5)), "__d": (F.col(x) - FALSE_EASTING) / (n * SCALE)})
    t, c, d = F.col("__t"), F.col("__c"), F.col("__d")
    up = d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, F.lit(4)) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, F.lit(6)) / 720
    side = d - (1 + 2 * t + c) * F.pow(d, F.lit(3)) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, F.lit(5)) / 120
    lat = F.degrees(F.col("__foot") - F.col("__n") * F.col("__tan") / F.col("__r") * up)
    lon = F.degrees(side / F.col("__cos")) + (F.col(zone) - 1) * 6 - 180 + 3
    projected = F.col(zone) > 0
    out = out.withColumns({"lat": F.when(projected, lat).otherwise(F.col(y)), "lon": F.when(projected, lon).otherwise(F.col(x))})
    return out.drop("__mu", "__foot", "__sin", "__cos", "__tan", "__bent", "__t", "__c", "__n", "__r", "__d")


def located(df: DataFrame, zone: str = "utm_zone") -> DataFrame:
    """Adds lon, lat of x, y."""
    return with_lat_lon(df, "x", "y", zone)
