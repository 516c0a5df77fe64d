"""Scene rasters: one folder of band files per scene, read strip by strip into pixel rows.

The files are a Spark data source of their own: the driver lists names and lengths only, a task reads the header and
the strips of its share of a file by their places, and conditions on scene, band, row and column reach the source.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from landheat.functions import indices, reproject
from landheat.operators import quality
from landheat.operators.filters import finite, valid_numbers
from landheat.schemas import PIXEL_LONG
from landheat.sources.pixels import write_pixels
from landheat.sources.scenes import read_scene_metadata
from landheat.sources.shared import written

PIXEL_BANDS = ("B4", "B5", "B6", "B10", "B11", "ST_B10")
QA_BAND = "QA_PIXEL"
#: Steps of the grid in files that tell none.
DEFAULT_STEP = (0.01, -0.01)
#: Rows of pixels that are handed on at once.
ROWS_AT_ONCE = 1 << 18
#: Rows up to which those of several strips and files are handed on together.
GATHERED_ROWS = 1 << 14
#: Bytes of files that a task reads: small files are gathered up to it, larger ones shared out by their strips.
PART_BYTES = 16 << 20
#: Bytes that opening a file counts for, so that many tiny files are many tasks.
OPEN_BYTES = 1 << 16
#: Bytes of a file that are read at once for its header.
HEAD_BYTES = 1 << 16

# Tags of the file format, and sizes and codes of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, CITATION = 33550, 33922, 34737
FIELD_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}

GRID = "scene string, band string, width int, height int, x0 double, y0 double, dx double, dy double, citation string, row int, col int, dn double"
#: What the data source gives: pixels, and a row with an error for each part of a file that can't be read.
SOURCE = f"{GRID}, path string, error string"
_ARROW = pa.schema(
    [("scene", pa.string()), ("band", pa.string()), ("width", pa.int32()), ("height", pa.int32()), *((n, pa.float64()) for n in ("x0", "y0", "dx", "dy")), ("citation", pa.string()),
     ("row", pa.int32()), ("col", pa.int32()), ("dn", pa.float64()), ("path", pa.string()), ("error", pa.string())]
)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that holds path, as Arrow opens it, and the path in it."""
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class Ranges:
    """Bytes of an open file by their places; the head is read once."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()
        self.head = file.read_at(min(HEAD_BYTES, self.size), 0)

    def __call__(self, at: int, size: int) -> bytes:
        if at + size > self.size:
            raise ValueError("the file ends before its data")
        return self.head[at : at + size] if at + size <= len(self.head) else self.file.read_at(size, at)


def _fields(read: Ranges) -> tuple[str, dict[int, tuple]]:
    """Byte order and fields of the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(read(0, 2))
    if order is None or struct.unpack(order + "H", read(2, 2))[0] != 42:
        raise ValueError("not a raster file of this kind")
    at = struct.unpack(order + "I", read(4, 4))[0]
    (n,) = struct.unpack(order + "H", read(at, 2))
    entries, out = read(at + 2, 12 * n), {}
    for k in range(n):
        entry = entries[12 * k : 12 * k + 12]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        code = FIELD_TYPES.get(kind)
        if code is None:
            continue
        size = count * struct.calcsize(code)
        data = entry[8 : 8 + size] if size <= 4 else read(struct.unpack(order + "I", entry[8:12])[0], size)
        out[tag] = (data.rstrip(b"\0").decode("latin-1"),) if code == "s" else struct.unpack(f"{order}{count}{code}", data)
    return order, out


@dataclass(frozen=True)
class Layout:
    """How a file's pixels lie in its strips or tiles, which are numbered row by row; of each pixel the first sample counts."""

    width: int
    height: int
    block_width: int
    block_height: int
    tiled: bool
    samples: int
    packing: int
    differences: bool
    kind: np.dtype
    places: tuple
    sizes: tuple

    @classmethod
    def of(cls, order: str, f: dict[int, tuple]) -> "Layout":
        width, height, tiled = f[WIDTH][0], f[HEIGHT][0], TILES in f
        kind = np.dtype({1: "u", 2: "i", 3: "f"}[f.get(FORMAT, (1,))[0]] + str(f.get(BITS, (8,))[0] // 8)).newbyteorder(order)
        bw, bh = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (width, min(height, f.get(STRIP_ROWS, (height,))[0]))
        places, sizes = (f[TILES], f[TILE_SIZES]) if tiled else (f[STRIPS], f[STRIP_SIZES])
        packing = f.get(COMPRESSION, (1,))[0]
        if packing not in (1, 8, 32946):
            raise ValueError(f"compression {packing} isn't read")
        return cls(width, height, bw, bh, tiled, f.get(SAMPLES, (1,))[0], packing, f.get(PREDICTOR, (1,))[0] == 2, kind, places, sizes)

    def corner(self, k: int) -> tuple[int, int]:
        across = -(-self.width // self.block_width)
        return k // across * self.block_height, k % across * self.block_width

    def block(self, read: Ranges, k: int) -> np.ndarray:
        raw = read(self.places[k], self.sizes[k])
        if self.packing != 1:
            raw = zlib.decompress(raw)
        row, col = self.corner(k)
        rows = self.block_height if self.tiled else min(self.block_height, self.height - row)
        values = np.frombuffer(raw, self.kind, rows * self.block_width * self.samples).reshape(rows, self.block_width, self.samples)
        if self.differences:
            values = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
        return values[: self.height - row, : self.width - col, 0].astype(float)


#: What a damaged file can raise.
DAMAGE = (ValueError, KeyError, IndexError, struct.error, zlib.error)


@dataclass(frozen=True)
class Share:
    """Part `part` of `parts` of a band file's strips."""

    scene: str
    band: str
    path: str
    part: int
    parts: int


@dataclass
class Shares(InputPartition):
    files: list[Share]

    def __init__(self, files: list[Share]):
        super().__init__(files)
        self.files = files


@dataclass(frozen=True)
class Window:
    """The rows and columns asked for, ends included; None where open."""

    first_row: int | None = None
    last_row: int | None = None
    first_col: int | None = None
    last_col: int | None = None

    def cut(self, name: str, first: int | None, last: int | None) -> "Window":
        low, high = getattr(self, f"first_{name}"), getattr(self, f"last_{name}")
        low = first if low is None or first is not None and first > low else low
        high = last if high is None or last is not None and last < high else high
        return Window(**{**self.__dict__, f"first_{name}": low, f"last_{name}": high})

    def meets(self, row: int, col: int, height: int, width: int) -> bool:
        apart = lambda first, last, at, size: last is not None and at > last or first is not None and at + size <= first
        return not apart(self.first_row, self.last_row, row, height) and not apart(self.first_col, self.last_col, col, width)


class RasterReader(DataSourceReader):
    def __init__(self, root: str, part_bytes: int):
        self.root, self.part_bytes = root, part_bytes
        self.scenes: set[str] | None = None
        self.bands: set[str] | None = None
        self.window = Window()
        self.pixels = self.errors = True

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Scenes, bands and whether there is an error are decided here; rows and columns only cut what is read."""
        for f in filters:
            if not self._decided(f):
                yield f

    def _decided(self, f: Filter) -> bool:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name in ("scene", "band") and isinstance(f, (EqualTo, In)):
            values, own = set(f.value if isinstance(f, In) else [f.value]), f"{name}s"
            known = getattr(self, own)
            setattr(self, own, values if known is None else known & values)
            return True
        if name == "error" and isinstance(f, (IsNull, IsNotNull)):
            if isinstance(f, IsNull):
                self.errors = False
            else:
                self.pixels = False
            return True
        if name in ("row", "col") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            first = None if isinstance(f, (LessThan, LessThanOrEqual)) else f.value + isinstance(f, GreaterThan)
            last = None if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else f.value - isinstance(f, LessThan)
            self.window = self.window.cut(name, first, last)
        return False

    def partitions(self) -> list[Shares]:
        """Names and lengths alone are looked at; a scene that is not asked for is not even listed."""
        fs, root = file_system(self.root)
        if self.scenes is None:
            folders = [i.path for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.type == pafs.FileType.Directory]
        else:
            folders = [posixpath.join(root, s) for s in self.scenes if s]
        listed = lambda folder: fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        out, held, size = [], [], 0
        with ThreadPoolExecutor(32) as pool:
            for files in pool.map(listed, sorted(folders)):
                for i in sorted(files, key=lambda i: i.base_name):
                    band, dot, kind = i.base_name.rpartition(".")
                    if i.type != pafs.FileType.File or dot + kind != ".tif" or self.bands is not None and band not in self.bands:
                        continue
                    parts = max(1, -(-i.size // self.part_bytes))
                    scene = posixpath.basename(posixpath.dirname(i.path))
                    shares = [Share(scene, band, i.path, k, parts) for k in range(parts)]
                    if parts > 1:
                        out += [Shares([s]) for s in shares]
                        continue
                    cost = i.size + OPEN_BYTES
                    if held and size + cost > self.part_bytes:
                        out.append(Shares(held))
                        held, size = [], 0
                    held, size = [*held, *shares], size + cost
        return [*out, Shares(held)] if held or not out else out

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in self._batches(partition):
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= GATHERED_ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _batches(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.root)
        for share in partition.files:
            with fs.open_input_file(share.path) as file:
                yield from self._share(share, Ranges(file) if file.size() else None)

    def _share(self, share: Share, read: Ranges | None) -> Iterator[pa.RecordBatch]:
        try:
            if read is None:
                raise ValueError("the file is empty")
            order, f = _fields(read)
            layout = Layout.of(order, f)
            scale, tie = f.get(PIXEL_SCALE), f.get(TIE_POINT)
            dx, dy = (scale[0], -scale[1]) if scale else DEFAULT_STEP
            x0, y0 = (tie[3] - tie[0] * dx, tie[4] - tie[1] * dy) if tie else (0.0, 0.0)
            head = [share.scene, share.band, layout.width, layout.height, x0, y0, dx, dy, f.get(CITATION, ("",))[0]]
        except DAMAGE as e:  # each part meets the same header; one tells
            if share.part == 0:
                yield from self._error(share, e)
            return
        n = min(len(layout.places), len(layout.sizes))
        for k in range(share.part * n // share.parts, (share.part + 1) * n // share.parts):
            row, col = layout.corner(k)
            if not self.window.meets(row, col, layout.block_height, layout.block_width):
                continue
            try:
                values = layout.block(read, k)
            except DAMAGE as e:
                yield from self._error(share, e)
                continue
            step = max(1, ROWS_AT_ONCE // max(1, values.shape[1]))
            for at in range(0, len(values), step) if self.pixels else ():
                part = values[at : at + step]
                place = np.indices(part.shape, np.int32)
                same = [pa.repeat(pa.scalar(v, t), part.size) for v, t in zip(head, _ARROW.types)]
                own = [pa.array((place[0] + np.int32(row + at)).ravel()), pa.array((place[1] + np.int32(col)).ravel()), pa.array(part.ravel())]
                yield pa.RecordBatch.from_arrays([*same, *own, pa.repeat(pa.scalar(share.path), part.size), pa.nulls(part.size, pa.string())], schema=_ARROW)

    def _error(self, share: Share, e: Exception) -> Iterator[pa.RecordBatch]:
        if self.errors:
            yield pa.RecordBatch.from_pylist([{"scene": share.scene, "band": share.band, "path": share.path, "error": f"{type(e).__name__}: {e}"}], schema=_ARROW)


class RasterWriter(DataSourceWriter):
    """Writes rows of scene, band and content as files; one that is written again replaces the other as a whole."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[T.Row]) -> WriterCommitMessage:
        fs, root = file_system(self.root)
        for r in iterator:
            folder = posixpath.join(root, r.scene)
            fs.create_dir(folder)
            part = posixpath.join(folder, f".{r.band}-{uuid.uuid4().hex}")
            with fs.open_output_stream(part) as out:
                out.write(bytes(r.content))
            fs.move(part, posixpath.join(folder, f"{r.band}.tif"))
        return WriterCommitMessage()


class RasterSource(DataSource):
    """`<path>/<scene>/<band>.tif`; read as SOURCE, written from (scene, band, content)."""

    @classmethod
    def name(cls) -> str:
        return "scene_rasters"

    def schema(self) -> str:
        return SOURCE

    def reader(self, schema: T.StructType) -> RasterReader:
        return RasterReader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options["path"])


def read_rasters(spark: SparkSession, path: str, bands: tuple[str, ...] = (*PIXEL_BANDS, QA_BAND), scenes: list[str] | DataFrame | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """SOURCE rows of the named bands of `<scene>/<band>.tif` under path; bands without a file are skipped.

    Of all scenes, those named in a list, or those in a table with a column scene, whose names come to the driver like
    the list of files itself. Further conditions on scene, band, row and column reach the source too.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    rows = spark.read.format(RasterSource.name()).option("partBytes", part_bytes).load(path)
    if isinstance(scenes, DataFrame):
        scenes = [r.scene for r in scenes.select("scene").distinct().collect()]
    rows = rows.filter(F.col("band").isin(*bands))
    return rows if scenes is None else rows.filter(F.col("scene").isin(*scenes) if scenes else F.lit(False))


def write_rasters(files: DataFrame, path: str) -> None:
    """(scene, band, content) as files that read_rasters finds."""
    files.sparkSession.dataSource.register(RasterSource)
    files.select("scene", "band", "content").write.format(RasterSource.name()).mode("append").save(path)


def encoded(values: np.ndarray, origin: tuple[float, float] = (0.0, 0.0), step: tuple[float, float] = (0.01, 0.01), citation: str = "", strip_rows: int | None = None, deflate: bool = False, order: str = "<") -> bytes:
    """A raster file of one sample a pixel, in strips, with its corner, steps and citation."""
    h, w = values.shape
    strip_rows = strip_rows or h
    values = values.astype(values.dtype.newbyteorder(order))
    strips = [values[k : k + strip_rows].tobytes() for k in range(0, h, strip_rows)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    body, at = b"", []
    for s in strips:
        at.append(8 + len(body))
        body += s + b"\0" * (len(s) % 2)
    fields = [
        (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [values.itemsize * 8]), (COMPRESSION, 3, [8 if deflate else 1]), (STRIPS, 4, at), (SAMPLES, 3, [1]), (STRIP_ROWS, 4, [strip_rows]),
        (STRIP_SIZES, 4, list(map(len, strips))), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[values.dtype.kind]]), (PIXEL_SCALE, 12, [*step, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, *origin, 0.0]),
        (CITATION, 2, citation.encode("latin-1") + b"\0"),
    ]
    entries = b""
    for tag, kind, data in fields:
        packed = data if isinstance(data, bytes) else struct.pack(f"{order}{len(data)}{FIELD_TYPES[kind]}", *data)
        place = packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack(order + "I", 8 + len(body))
        body += packed + b"\0" * (len(packed) % 2) if len(packed) > 4 else b""
        entries += struct.pack(order + "HHI", tag, kind, len(data)) + place
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(body)) + body + struct.pack(order + "H", len(fields)) + entries + bytes(4)


def read_grid(spark: SparkSession, path: str, bands: tuple[str, ...], scenes: list[str] | DataFrame | None = None) -> DataFrame:
    """Pixels (see GRID) of read_rasters; files and strips that can't be read are left out (see rejected_files)."""
    return read_rasters(spark, path, bands, scenes).filter(F.col("error").isNull()).drop("path", "error")


def rejected_files(spark: SparkSession, path: str, bands: tuple[str, ...] = (*PIXEL_BANDS, QA_BAND), scenes: list[str] | DataFrame | None = None) -> DataFrame:
    """(scene, band, path, reason) of the files that read_grid passes over, or leaves strips out of; makes no pixels."""
    found = read_rasters(spark, path, bands, scenes).filter(F.col("error").isNotNull())
    return found.select("scene", "band", "path", F.col("error").alias("reason")).distinct()


def pixel_rows(grid: DataFrame, times: DataFrame) -> DataFrame:
    """PIXEL_LONG rows of decoded pixels: finite, scaled, placed at pixel centres in degrees, rounded.

    times: (scene, acquired); scenes without a time are of 2000-01-01.
    """
    rows = valid_numbers(grid).withColumns(
        {
            "x": indices.pixel_centre(F.col("x0"), F.col("dx"), F.col("col")),
            "y": indices.pixel_centre(F.col("y0"), F.col("dy"), F.col("row")),
            "utm_zone": reproject.utm_zone(F.col("citation")),
            "value": indices.scaled(F.col("dn"), F.col("band")),
        }
    )
    # tested before they are projected: a filter above the projection would compute it twice
    rows = rows.filter(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("value")))
    rows = reproject.located(rows).join(times, "scene", "left")
    return rows.select(
        F.col("scene").alias("tile_id"),
        indices.rounded(F.col("lat"), 4).alias("lat"),
        indices.rounded(F.col("lon"), 4).alias("lon"),
        indices.band_name(F.col("band")).alias("band"),
        indices.rounded(F.col("value"), 6).alias("value"),
        indices.or_epoch(F.col("acquired")).alias("timestamp"),
        F.lit("").alias("lulc_class"),
    ).to(T.StructType.fromDDL(PIXEL_LONG))


def scene_pixels(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, most_cloud: float = 10.0, scenes: list[str] | None = None) -> DataFrame:
    """Clear pixels of all scenes under path that the cloud gate accepts.

    With a box, scenes whose cloud share in it is above most_cloud go before their bands are decoded.
    """
    qa_grid = read_grid(spark, path, (QA_BAND,), scenes)
    at = {"x": indices.pixel_centre(F.col("x0"), F.col("dx"), F.col("col")), "y": indices.pixel_centre(F.col("y0"), F.col("dy"), F.col("row")), "utm_zone": reproject.utm_zone(F.col("citation"))}
    qa = reproject.located(qa_grid.withColumns(at)).select(
        "scene", F.col("row").alias("qrow"), F.col("col").alias("qcol"), F.col("height").alias("qheight"), F.col("width").alias("qwidth"), F.col("dn").cast("int").alias("qa"), "lat", "lon"
    )
    if box is not None:
        clouds = quality.aoi_cloud(qa, box)
        judged = quality.gated(clouds.select("scene"), clouds, most_cloud)
        scenes = written(judged.filter("accepted").select("scene"), "accepted-scenes")  # a name per scene, read by each band
    grid = read_grid(spark, path, PIXEL_BANDS, scenes)
    clear = quality.clear_pixels(quality.join_qa(grid, qa.drop("lon", "lat")))
    meta = read_scene_metadata(spark, path)
    times = meta.groupBy(F.col("scene_id").alias("scene")).agg(F.max(F.to_timestamp("acquisition_datetime")).alias("acquired"))
    return pixel_rows(clear, times)


def reprocess(spark: SparkSession, path: str, out: str, scenes: list[str] | None = None) -> None:
    """Decodes all or the named scenes again and replaces just their folders of the pixel table."""
    write_pixels(scene_pixels(spark, path, scenes=scenes), out)
