"""Row filters, samples and checks on pixel and matrix rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landheat.config import Config
from landheat.schemas import MATRIX_REQUIRED

#: Bits of the quality band that spoil a pixel: fill, dilated cloud, cirrus, cloud, shadow.
QA_BITS = 31
HASH_PARTS = 1_000_000

LEAKS = ("tile_id", "year", "doy", "split", "has_thermal_split", "ST_B10", "bt10", "bt11", "bt10_minus_bt11")
QUICK_EXCLUDED = ("tile_id", "timestamp", "year", "lst", "bt10")


def in_bbox(box: tuple[float, float, float, float] = Config.bbox, lon: str = "lon", lat: str = "lat") -> Column:
    """True within the box, edges included; plain ranges, so they reach the Parquet scan."""
    return F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3])


def sampled(df: DataFrame, rate: float, keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """A sample without replacement, only if 0 < rate < 1.

    With keys a row is in the sample by a hash of them, alike on any partitioning; without, by Spark's own draw.
    """
    if not 0 < rate < 1:
        return df
    if keys is None:
        return df.sample(False, rate, seed)
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(HASH_PARTS)) < int(rate * HASH_PARTS))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def valid_numbers(df: DataFrame, dn: str = "dn") -> DataFrame:
    """Without nodata (0), NaN and infinite numbers."""
    return df.filter((F.col(dn) != 0) & finite(F.col(dn)))


def valid_places(df: DataFrame, value: str = "value") -> DataFrame:
    return df.filter(finite(F.col("lat")) & finite(F.col("lon")) & finite(F.col(value)))


def qa_clear(qa: str | Column = "qa") -> Column:
    """True where no spoiling bit is set; 0 counts as clear here."""
    qa = F.col(qa) if isinstance(qa, str) else qa
    return (qa >= 0) & (qa.bitwiseAND(QA_BITS) == 0)


def qa_counts(qa: str = "qa") -> Column:
    """True for pixels that count in a cloud share: 0 is fill there."""
    return F.col(qa) != 0


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null and NaN in the columns."""
    return df.na.drop(subset=columns)


def has_target(df: DataFrame, target: str = "lst") -> DataFrame:
    """Rows with a target; NaN stays."""
    return df.filter(F.col(target).isNotNull())


def require_columns(df: DataFrame, columns: list[str] = MATRIX_REQUIRED) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def without_leaks(df: DataFrame) -> DataFrame:
    """Drops what the target was made from, and what tells rows apart."""
    return df.drop(*LEAKS)


def numeric_features(df: DataFrame, excluded: tuple[str, ...] = QUICK_EXCLUDED) -> list[str]:
    return [n for n, kind in df.dtypes if kind in ("double", "float") and n not in excluded]


def in_zone(df: DataFrame, category: str = "zoning_category") -> DataFrame:
    return df.filter(F.col(category).isNotNull())


def analysis_projection(df: DataFrame, names: dict[str, str], drop_nulls: bool = False) -> DataFrame:
    """Selects the variables that exist under their canonical names. Null handling is each variable's own by default."""
    have = {c.lower(): c for c in df.columns}
    out = df.select(*(F.col(have[old.lower()]).alias(new) for old, new in names.items() if old.lower() in have))
    return out.na.drop() if drop_nulls else out


def expectations(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(column, kind, rows, nulls, least, most, in_range) of each column, in one aggregation.

    in_range is null for columns without a range; least and most are numbers as doubles.
    """
    ranges = ranges or {}
    numbers = {n for n, k in df.dtypes if k.startswith(("double", "float", "int", "bigint", "smallint", "tinyint", "decimal"))}
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        value = c.cast("double") if name in numbers else F.lit(None).cast("double")
        low, high = ranges.get(name, (None, None))
        ok = F.count_if(~value.between(low, high)) == 0 if low is not None else F.lit(None).cast("boolean")
        parts.append(F.struct(F.lit(name).alias("column"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.min(value).alias("least"), F.max(value).alias("most"), ok.alias("in_range")))
    return df.agg(F.array(*parts).alias("found")).select(F.explode("found").alias("f")).select("f.*")
