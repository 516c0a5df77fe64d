"""Spectral indices, calendar fields, scaling and rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from landheat.schemas import BAND_NAMES, SCALES

TINY = 1e-10


def _ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b + 1e-10), null where the sum is zero."""
    return F.try_divide(a - b, a + b + F.lit(TINY))


def ndvi(red: str = "B4_Red", nir: str = "B5_NIR") -> Column:
    return _ratio(F.col(nir), F.col(red))


def ndbi(nir: str = "B5_NIR", swir: str = "B6_SWIR1") -> Column:
    return _ratio(F.col(swir), F.col(nir))


def doy_from_scene_id(scene_id: str | Column) -> Column:
    """Day of the year of the fourth `_`-parted token, yyyymmdd; null where it is no date."""
    token = F.try_element_at(F.split(scene_id, "_"), F.lit(4))
    return F.dayofyear(F.try_to_timestamp(token, F.lit("yyyyMMdd")))


def rounded(x: Column, places: int) -> Column:
    """Half away from zero, from floor alone, so that it agrees with other engines' floor to the last bit."""
    by = float(10**places)
    return F.signum(x) * F.floor(F.abs(x) * by + 0.5) / by


def _choose(table: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), key), F.lit(default))


def band_name(key: Column) -> Column:
    """The canonical name of a band key; unknown keys stay."""
    names = F.create_map(*(F.lit(v) for kv in BAND_NAMES.items() for v in kv))
    return F.coalesce(F.try_element_at(names, key), key)


def scaled(dn: Column, key: Column, table: dict[str, tuple[float, float]] = SCALES) -> Column:
    """A stored number in the band's unit; bands that the table lacks stay as they are."""
    scale = _choose({k: v[0] for k, v in table.items()}, key, 1.0)
    offset = _choose({k: v[1] for k, v in table.items()}, key, 0.0)
    return dn * scale + offset


def or_epoch(ts: Column) -> Column:
    """A missing time becomes 2000-01-01."""
    return F.coalesce(ts, F.to_timestamp(F.lit("2000-01-01 00:00:00")))


def season(doy: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day on a circle of 366 days."""
    angle = doy * F.lit(2 * math.pi / 366)
    return F.sin(angle), F.cos(angle)


def flexible_int(text: Column) -> Column:
    """An integer written as a number or within quotes; null for anything else."""
    return F.trim(text, F.lit('"')).try_cast("int")


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def pixel_centre(origin: Column, step: Column, index: Column) -> Column:
    return origin + (index + 0.5) * step


#: Bits of each coordinate in a Morton code: steps of 2e-5 degrees of longitude, 1e-5 of latitude.
MORTON_BITS = 24


def morton(lon: Column, lat: Column) -> Column:
    """The bits of both coordinates in turn, highest first, so that near places mostly have near codes; null if one is.

    Each four bits are parted by a table of their sixteen values.
    """
    apart = F.array(*(F.lit(sum((v >> b & 1) << 2 * b for b in range(4))).cast("long") for v in range(16)))

    def spread(share: Column) -> Column:
        x = F.floor(share * float(1 << MORTON_BITS)).cast("long")
        x = F.when(x < 0, 0).when(x >= 1 << MORTON_BITS, (1 << MORTON_BITS) - 1).otherwise(x)
        parts = [F.shiftleft(F.get(apart, F.shiftright(x, 4 * k).bitwiseAND(F.lit(15)).cast("int")), 8 * k) for k in range(MORTON_BITS // 4)]
        out = parts[0]
        for p in parts[1:]:
            out = out.bitwiseOR(p)
        return out

    return spread((lon + 180) / 360).bitwiseOR(F.shiftleft(spread((lat + 90) / 180), 1))
