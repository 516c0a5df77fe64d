"""Scene constants and surface temperature on wide pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landheat.config import Config
from landheat.functions import thermal

CONSTANTS = ["k1_constant_band_10", "k2_constant_band_10", "k1_constant_band_11", "k2_constant_band_11"]
#: Scenes whose constants are sent to all executors; beyond that the join is left to the planner.
MOST_SCENES = 200_000


def with_scene_constants(pixels: DataFrame, meta: DataFrame, most_scenes: int = MOST_SCENES) -> DataFrame:
    """pixels left joined with the four constants of their scene; a repeated scene has its least constants."""
    meta = meta.groupBy(F.col("scene_id").alias("tile_id")).agg(*(F.min(c).alias(c) for c in CONSTANTS))
    few = meta.limit(most_scenes + 1).count() <= most_scenes
    return pixels.join(F.broadcast(meta) if few else meta, "tile_id", "left")


def with_temperature(df: DataFrame, cfg: Config = Config(), mode: str = "column", present: list[str] | None = None) -> DataFrame:
    """Adds pv, eps10, eps11, bt10, bt11, lst, has_thermal_split and bt10_minus_bt11.

    mode "column": where both thermal bands are present (as columns, or in `present`) every row's lst comes from the
    split window, and is null where a row lacks one; else from ST_B10, else from bt10. mode "row": each row takes the
    first of the three that it has.
    """
    if mode not in ("column", "row"):
        raise ValueError(f"unknown mode {mode}")
    have = set(present if present is not None else df.columns) & set(df.columns)
    pv = thermal.vegetation_share(F.col("ndvi"), cfg)
    df = df.withColumn("pv", pv)
    df = df.withColumns({"eps10": thermal.emissivity(F.col("pv"), cfg.eps_soil10, cfg.eps_veg10), "eps11": thermal.emissivity(F.col("pv"), cfg.eps_soil11, cfg.eps_veg11)})
    null = F.lit(None).cast("double")
    bt = {}
    for n in ("10", "11"):
        band = f"B{n}_TIR"
        bt[f"bt{n}"] = thermal.brightness_temperature(F.col(band), F.col(f"k1_constant_band_{n}"), F.col(f"k2_constant_band_{n}")) if band in have else null
    df = df.withColumns(bt)
    split = {"B10_TIR", "B11_TIR"} <= have
    window = thermal.split_window(F.col("bt10"), F.col("bt11"), F.col("eps10"), F.col("eps11"), cfg) if split else null
    surface = F.col("ST_B10").cast("double") if "ST_B10" in have else null
    if mode == "row":
        lst = F.coalesce(window, surface, F.col("bt10"))
        flag = window.isNotNull()
    else:
        lst = window if split else surface if "ST_B10" in have else F.col("bt10")
        flag = F.lit(split)
    difference = F.col("bt10") - F.col("bt11") if split else null
    return df.withColumns({"lst": lst, "has_thermal_split": flag, "bt10_minus_bt11": difference})
