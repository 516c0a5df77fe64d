"""Settings of the pipelines, and the checks on them that need no data."""

from __future__ import annotations

from dataclasses import dataclass, fields


class YearOverlapError(ValueError):
    """Train and test years overlap."""


@dataclass(frozen=True)
class Config:
    category_column: str = "zoning_category"
    smoothing: float = 10.0
    folds: int = 1
    sample_rate: float = 1.0
    bbox: tuple[float, float, float, float] = (79.9469, 12.8000, 80.3450, 13.2300)
    years: tuple[int, int] = (2014, 2023)
    max_cloud: float = 10.0
    max_aoi_cloud: float = 10.0
    train_start: int = 2024
    train_end: int = 2031
    test_start: int = 2032
    test_end: int = 2033
    allow_degenerate_split: bool = False
    # Vegetation limits, emissivities, split-window coefficients, water vapour, thermal constants.
    ndvi_soil: float = 0.2
    ndvi_veg: float = 0.5
    eps_soil10: float = 0.966
    eps_veg10: float = 0.986
    eps_soil11: float = 0.973
    eps_veg11: float = 0.989
    coefficients: tuple[float, ...] = (-0.410, 1.0, 0.0, 0.0, 1.1, 0.0, 0.5)
    water_vapour: float = 2.0
    k1_10: float = 774.8853
    k2_10: float = 1321.0789
    k1_11: float = 480.8883
    k2_11: float = 1201.1442

    def checked(self) -> "Config":
        """Itself, unless train and test years share a year and allow_degenerate_split is off."""
        first, last = max(self.train_start, self.test_start), min(self.train_end, self.test_end)
        if first <= last and not self.allow_degenerate_split:
            shared = f"year {first}" if first == last else f"years {first}–{last}"
            # fixed values: the message's wording, with its two spaces
            raise YearOverlapError(
                f"train and test overlap in {shared} (train range {self.train_start}–{self.train_end}, test  range {self.test_start}–{self.test_end}); "
                "pass --allow-degenerate-split to accept it"
            )
        return self

    @classmethod
    def from_args(cls, args: list[str]) -> "Config":
        """Settings from pairs `--some-name value`; --allow-degenerate-split stands alone. Years are checked."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        given: dict = {}
        rest = list(args)
        while rest:
            name = rest.pop(0).removeprefix("--").replace("-", "_")
            if name not in kinds:
                raise ValueError(f"unknown setting {name}")
            if kinds[name] is bool:
                given[name] = True
                continue
            if not rest:
                raise ValueError(f"{name} needs a value")
            value = rest.pop(0)
            given[name] = parse_bbox(value) if name == "bbox" else tuple(map(float, value.split(","))) if kinds[name] is tuple else kinds[name](value)
        return cls(**given).checked()


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """`lon0,lat0,lon1,lat1`, in order and on the globe."""
    parts = [float(p) for p in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a box has four numbers")
    x0, y0, x1, y1 = parts
    if not (-180 <= x0 < x1 <= 180 and -90 <= y0 < y1 <= 90):
        raise ValueError("the corners of the box are out of order or off the globe")
    return x0, y0, x1, y1
