"""Surface temperature from vegetation cover, emissivity and brightness temperature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landheat.config import Config

#: Wavelength in metres and h*c/k in metre kelvin, for the documented single-channel formula.
WAVELENGTH, RHO = 10.895e-6, 1.438e-2


def vegetation_share(ndvi: Column, cfg: Config = Config()) -> Column:
    """Squared place of ndvi between soil and vegetation; 0 below, 1 above, 0 for null and NaN."""
    place = (ndvi - cfg.ndvi_soil) / (cfg.ndvi_veg - cfg.ndvi_soil)
    return F.when(ndvi.isNull() | F.isnan(ndvi) | (ndvi < cfg.ndvi_soil), 0.0).when(ndvi > cfg.ndvi_veg, 1.0).otherwise(place * place)


def emissivity(pv: Column, soil: float, veg: float) -> Column:
    return F.lit(soil) * (1 - pv) + F.lit(veg) * pv


def brightness_temperature(radiance: Column, k1: Column, k2: Column) -> Column:
    """K2 / ln(K1 / L + 1); null where it isn't defined."""
    inner = F.try_divide(k1, radiance) + 1
    return F.try_divide(k2, F.when(inner > 0, F.ln(inner)))


def split_window(bt10: Column, bt11: Column, eps10: Column, eps11: Column, cfg: Config = Config()) -> Column:
    a, w = cfg.coefficients, cfg.water_vapour
    d, mean, delta = bt10 - bt11, (eps10 + eps11) / 2, eps10 - eps11
    return bt10 + a[0] + a[1] * d + a[2] * d * d + (a[3] + a[4] * w) * (1 - mean) + (a[5] + a[6] * w) * delta


def quick_single_channel(bt: Column, ndvi: Column, cfg: Config = Config()) -> Column:
    """Quick variant: cover clipped but not squared, emissivity 0.004 pv + 0.986, bt / emissivity^(1/4)."""
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ndvi - cfg.ndvi_soil) / (cfg.ndvi_veg - cfg.ndvi_soil)))
    return bt / F.pow(0.004 * place + 0.986, F.lit(0.25))


def single_channel(bt: Column, eps: Column) -> Column:
    """Documented variant: bt / (1 + (wavelength * bt / rho) * ln(emissivity))."""
    return F.try_divide(bt, 1 + (F.lit(WAVELENGTH) * bt / RHO) * F.ln(eps))
