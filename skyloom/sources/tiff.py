"""Georeferenced TIFF rasters as a Spark data source, and a job that writes them.

The header of a large file is read where the read is planned: size, sample
format, compression, where each strip or tile lies, the corner and step of the
grid and the nodata value.  A partition is then a run of strips or tiles of one
file and carries what it needs, so tasks read their own bytes only and a large
raster is read by many tasks.  Many small files are dealt out in packs, and the task
that reads a pack reads its headers, so neither the plan nor the number of tasks
follows the number of files.  Filters on ``row`` leave whole strips unread, and
cells without a value stay behind when a filter asks for those that have one.

Rows are (path, row, col, x, y, value) with the centre of each cell; nodata is
null.  Files are opened through Arrow's file systems, by local path or by URI.
One band, uncompressed or deflated, whole numbers or floats, with or without
horizontal differences, is what is understood; anything else is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "path string, row int, col int, x double, y double, value double"
#: Cells of a partition, about.
CELLS = 4_000_000
#: Bytes of a file that is small, files of a pack at most and at least, packs that there should be; no more files than that are not packed.
SMALL, PACK, LEAST, PACKS = 4_000_000, 256, 16, 64
#: Cells that leave a task at once, about.
AT_ONCE = 200_000

# Tag numbers of the format and of its geographic and nodata extensions; bytes and codes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT, STEP, CORNER, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
_FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_NUMBERS = {1: "u", 2: "i", 3: "f"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    dtype: str
    compression: int
    differences: bool
    #: Width and height of a strip or tile, and where each begins and how long it is.
    block: tuple[int, int]
    at: tuple[int, ...]
    size: tuple[int, ...]
    corner: tuple[float, float]
    step: tuple[float, float]
    nodata: float | None


def read_header(file) -> Header:
    """The first image's header; ``file`` can seek."""
    mark = file.read(8)
    order = {b"II": "<", b"MM": ">"}.get(mark[:2])
    if order is None or struct.unpack(order + "H", mark[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    file.seek(struct.unpack(order + "I", mark[4:])[0])
    count = struct.unpack(order + "H", file.read(2))[0]
    entries, tags = file.read(12 * count), {}
    for i in range(count):
        tag, kind, n = struct.unpack(order + "HHI", entries[12 * i : 12 * i + 8])
        if kind not in _FIELDS:
            continue
        form = order + _FIELDS[kind] * n
        length = struct.calcsize(form)
        raw = entries[12 * i + 8 : 12 * i + 8 + length]
        if length > 4:
            file.seek(struct.unpack(order + "I", entries[12 * i + 8 : 12 * i + 12])[0])
            raw = file.read(length)
        found = struct.unpack(form, raw)
        tags[tag] = b"".join(found) if kind == 2 else found

    def one(tag: int, default: int) -> int:
        return tags.get(tag, (default,))[0]

    if one(SAMPLES, 1) != 1 or one(COMPRESSION, 1) not in (1, 8, 32946) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"bands {one(SAMPLES, 1)}, compression {one(COMPRESSION, 1)}, predictor {one(PREDICTOR, 1)}: not understood")
    kind = _NUMBERS.get(one(FORMAT, 1))
    if kind is None or (one(PREDICTOR, 1) == 2 and kind == "f"):
        raise ValueError("sample format not understood")
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    tiled = TILE_AT in tags
    block = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, one(ROWS, height)))
    tie, step = tags.get(CORNER, (0.0,) * 6), tags.get(STEP, (1.0, 1.0, 0.0))
    nodata = tags.get(NODATA, b"").split(b"\0")[0].strip()
    return Header(
        width, height, f"{order}{kind}{one(BITS, 1) // 8}", one(COMPRESSION, 1), one(PREDICTOR, 1) == 2, block, tags[TILE_AT if tiled else STRIP_AT],
        tags[TILE_BYTES if tiled else STRIP_BYTES], (tie[3] - tie[0] * step[0], tie[4] + tie[1] * step[1]), (step[0], step[1]), float(nodata) if nodata else None,
    )


@dataclass
class Blocks(InputPartition):
    """A run of strips or tiles of one file: their place among all, and the header without the others' places."""

    path: str
    header: Header
    first: int

    def __post_init__(self) -> None:
        super().__init__(None)


@dataclass
class Pack(InputPartition):
    """Small files, whole."""

    paths: tuple[str, ...]

    def __post_init__(self) -> None:
        super().__init__(None)


def read_block(raw: bytes, header: Header) -> np.ndarray:
    """The cells of a strip or tile, as many rows as it has."""
    data = raw if header.compression == 1 else zlib.decompress(raw)
    cells = np.frombuffer(data, header.dtype)
    rows = len(cells) // header.block[0]
    cells = cells[: rows * header.block[0]].reshape(rows, header.block[0])
    if header.differences:
        cells = np.cumsum(cells, axis=1, dtype=cells.dtype.newbyteorder("="))
    return cells


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.low, self.high, self.present = path, 0, 2**31 - 1, False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take bounds of the row and whether there must be a value; Spark keeps applying all filters to what is read."""
        for f in filters:
            self.present |= isinstance(f, IsNotNull) and f.attribute == ("value",)
            if getattr(f, "attribute", None) == ("row",):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value)
                elif isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                elif isinstance(f, LessThan):
                    self.high = min(self.high, f.value - 1)
                elif isinstance(f, LessThanOrEqual):
                    self.high = min(self.high, f.value)
            yield f

    def wanted(self, h: Header) -> list[int]:
        """The strips or tiles that have wanted rows."""
        across = -(-h.width // h.block[0])
        return [i for i in range(len(h.at)) if i // across * h.block[1] <= self.high and (i // across + 1) * h.block[1] > self.low]

    def partitions(self) -> Sequence[InputPartition]:
        files, place = opened(self.path)
        if files.get_file_info(place).type == fs.FileType.Directory:
            infos = files.get_file_info(fs.FileSelector(place, recursive=True))
            found = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.lower().endswith((".tif", ".tiff")))
        else:
            found = [(place, files.get_file_info(place).size)]
        small = [path for path, size in found if size is not None and size <= SMALL]
        small = small if len(small) > PACKS else []
        packed = set(small)
        each = min(PACK, max(LEAST, len(small) // PACKS))
        out: list[InputPartition] = [Pack(tuple(small[a : a + each])) for a in range(0, len(small), each)]
        for path, _ in found:
            if path in packed:
                continue
            with files.open_input_file(path) as file:
                h = read_header(file)
            wanted = self.wanted(h)
            each = max(1, CELLS // (h.block[0] * h.block[1]))
            for a in range(0, len(wanted), each):
                run = wanted[a : a + each]
                own = Header(**{**h.__dict__, "at": tuple(h.at[i] for i in run), "size": tuple(h.size[i] for i in run)})
                out.append(Blocks(path, own, run[0]))
        return out or [Pack(())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        held, count = [], 0
        for part in self._parts(files, partition):
            held.append(part)
            count += len(part)
            if count >= AT_ONCE:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, count = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _parts(self, files: fs.FileSystem, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Blocks):
            with files.open_input_file(partition.path) as file:
                places = [(partition.first + k, at, size) for k, (at, size) in enumerate(zip(partition.header.at, partition.header.size))]
                yield from self._cells(file, partition.path, partition.header, places)
            return
        for path in partition.paths:
            with files.open_input_file(path) as file:
                h = read_header(file)
                yield from self._cells(file, path, h, [(i, h.at[i], h.size[i]) for i in self.wanted(h)])

    def _cells(self, file, path: str, h: Header, places: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        across = -(-h.width // h.block[0])
        for number, at, size in places:
            down, right = divmod(number, across)
            file.seek(at)
            cells = read_block(file.read(size), h)[: h.height - down * h.block[1], : h.width - right * h.block[0]]
            row, col = (c.ravel().astype(np.int32) for c in np.indices(cells.shape))
            row, col = row + np.int32(down * h.block[1]), col + np.int32(right * h.block[0])
            value = cells.ravel().astype(np.float64)
            lost = np.isnan(value) if h.nodata is None else np.isnan(value) | (value == h.nodata)
            if self.present:
                row, col, value, lost = row[~lost], col[~lost], value[~lost], lost[~lost]
            x = h.corner[0] + (col + 0.5) * h.step[0]
            y = h.corner[1] - (row + 0.5) * h.step[1]
            columns = [pa.repeat(pa.scalar(path, pa.string()), len(row)), pa.array(row), pa.array(col), pa.array(x), pa.array(y), pa.array(value, mask=lost)]
            yield pa.record_batch(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class TiffRasters(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff_rasters"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a raster file, or of all raster files in a folder."""
    spark.dataSource.register(TiffRasters)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tiff_rasters").option("path", path).load()


# --- writing ---------------------------------------------------------------------------


def encoded(cells: np.ndarray, corner: tuple[float, float], step: tuple[float, float], nodata: float | None, rows: int = 16) -> bytes:
    """A little-endian TIFF of deflated strips."""
    height, width = cells.shape
    strips = [zlib.compress(np.ascontiguousarray(cells[a : a + rows]).tobytes()) for a in range(0, height, rows)]
    kind = {"u": 1, "i": 2, "f": 3}[cells.dtype.kind]
    text = b"" if nodata is None else repr(float(nodata)).encode() + b"\0"
    fields = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * cells.dtype.itemsize]), (COMPRESSION, 3, [8]), (STRIP_AT, 4, [0] * len(strips)), (SAMPLES, 3, [1]),
        (ROWS, 4, [rows]), (STRIP_BYTES, 4, [len(s) for s in strips]), (FORMAT, 3, [kind]), (STEP, 12, [*step, 0.0]), (CORNER, 12, [0.0, 0.0, 0.0, *corner, 0.0]),
    ] + ([(NODATA, 2, text)] if text else [])
    packed = [v if t == 2 else struct.pack("<" + _FIELDS[t] * len(v), *v) for _, t, v in fields]
    after = 8 + 2 + 12 * len(fields) + 4
    begin = after + sum(len(p) for p in packed if len(p) > 4)
    places = [begin + sum(map(len, strips[:i])) for i in range(len(strips))]
    packed = [struct.pack("<" + "I" * len(places), *places) if tag == STRIP_AT else p for (tag, _, _), p in zip(fields, packed)]
    entries, rest = b"", b""
    for (tag, t, v), p in zip(fields, packed):
        entries += struct.pack("<HHI", tag, t, len(v)) + (p.ljust(4, b"\0") if len(p) <= 4 else struct.pack("<I", after + len(rest)))
        rest += p if len(p) > 4 else b""
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + rest + b"".join(strips)


def write_rasters(cells: DataFrame, scene: str, folder: str, shape: tuple[int, int], corner: tuple[float, float], step: tuple[float, float],
                  nodata: float = -9999.0) -> DataFrame:
    """One file for each scene from (scene, row, col, value), the last of equal cells by value; its name and number of cells.

    A raster is written whole by one task, which its shape bounds.  Files appear
    under their name when they are complete, so a task that runs again does no harm.
    """

    def write(rows: pa.Table) -> pa.Table:
        grid = np.full(shape, nodata, np.float64)
        row, col, value = (rows[c].to_numpy() for c in ("row", "col", "value"))
        order = np.argsort(value)
        grid[row[order], col[order]] = value[order]
        files, place = opened(folder)
        files.create_dir(place, recursive=True)
        name = f"{place}/{rows['scene'][0].as_py()}.tif"
        with files.open_output_stream(f"{name}.part") as out:
            out.write(encoded(grid, corner, step, nodata))
        files.move(f"{name}.part", name)
        return pa.table({"path": pa.array([name], pa.string()), "n": pa.array([int((grid != nodata).sum())], pa.int64())})

    named = cells.select(F.col(scene).cast("string").alias("scene"), "row", "col", F.col("value").cast("double").alias("value"))
    return named.groupBy("scene").applyInArrow(write, "path string, n long")
