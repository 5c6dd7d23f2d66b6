"""Raster files: written and read back, in strips and tiles, and what a row filter leaves unread."""

import io
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.datasource import GreaterThanOrEqual, IsNotNull, LessThan

from skyloom.sources import tiff


@pytest.mark.parametrize("dtype", ["u1", "<i2", "<f4", "<f8"])
def test_header_and_cells_come_back(dtype):
    cells = (np.arange(40 * 7) % 100).reshape(40, 7).astype(dtype)
    raw = tiff.encoded(cells, (3.5, 51.25), (0.5, 0.25), 99.0, rows=16)
    h = tiff.read_header(io.BytesIO(raw))
    assert (h.width, h.height, h.block, h.corner, h.step, h.nodata) == (7, 40, (7, 16), (3.5, 51.25), (0.5, 0.25), 99.0)
    got = np.concatenate([tiff.read_block(raw[a : a + n], h) for a, n in zip(h.at, h.size)])
    assert len(h.at) == 3 and (got == cells).all()


def tiled(cells, side, order=">"):
    """A big-endian file of tiles with horizontal differences, not compressed."""
    height, width = cells.shape
    down, across = -(-height // side), -(-width // side)
    padded = np.zeros((down * side, across * side), cells.dtype)
    padded[:height, :width] = cells
    tiles = [padded[i * side : (i + 1) * side, j * side : (j + 1) * side] for i in range(down) for j in range(across)]
    data = [np.diff(t, axis=1, prepend=0).astype(order + cells.dtype.str[1:]).tobytes() for t in tiles]
    n = len(data)
    fields = [(256, [width]), (257, [height]), (258, [8 * cells.dtype.itemsize]), (259, [1]), (277, [1]), (317, [2]), (322, [side]), (323, [side]), (324, None), (325, [len(d) for d in data]), (339, [2])]
    after = 8 + 2 + 12 * len(fields) + 4
    begin = after + 8 * n
    places = [begin + sum(map(len, data[:i])) for i in range(n)]
    out, rest = b"", b""
    for tag, v in fields:
        v = places if v is None else v
        packed = struct.pack(order + "I" * len(v), *v)
        out += struct.pack(order + "HHI", tag, 4, len(v)) + (packed if len(v) == 1 else struct.pack(order + "I", after + len(rest)))
        rest += packed if len(v) > 1 else b""
    return b"MM\0*" + struct.pack(order + "I", 8) + struct.pack(order + "H", len(fields)) + out + struct.pack(order + "I", 0) + rest + b"".join(data)


def test_tiles_with_differences(spark, tmp_path):
    cells = np.random.default_rng(0).integers(-500, 500, (21, 13)).astype(np.int16)
    (tmp_path / "a.tif").write_bytes(tiled(cells, 8))
    got = tiff.read_rasters(spark, str(tmp_path)).toPandas()
    back = np.zeros_like(cells)
    back[got["row"], got["col"]] = got["value"]
    assert len(got) == cells.size and (back == cells).all()


def test_written_and_read_back(spark, tmp_path):
    rows = [(s, r, c, float(s * 1000 + r * 10 + c)) for s in (1, 2) for r in range(0, 50, 3) for c in range(6)]
    df = spark.createDataFrame([*rows, (1, 0, 0, -5.0)], "scene long, row int, col int, value double")
    done = tiff.write_rasters(df, "scene", str(tmp_path / "out"), (50, 6), (10.0, 20.0), (1.0, 2.0)).collect()
    assert sorted(r["n"] for r in done) == [102, 102]
    got = tiff.read_rasters(spark, str(tmp_path / "out")).where("value is not null").toPandas()
    got["scene"] = got["path"].str.extract(r"(\d+)\.tif")[0].astype(int)
    assert sorted(zip(got["scene"], got["row"], got["col"], got["value"])) == rows
    assert (got["x"] == 10.0 + (got["col"] + 0.5)).all() and (got["y"] == 20.0 - (got["row"] + 0.5) * 2.0).all()
    few = tiff.read_rasters(spark, str(tmp_path / "out")).where("row >= 16 and row < 30")
    assert few.count() == 2 * 14 * 6
    (tmp_path / "none").mkdir()
    assert tiff.read_rasters(spark, str(tmp_path / "none")).count() == 0


def test_row_filters_leave_strips_unread(tmp_path, monkeypatch):
    monkeypatch.setattr(tiff, "CELLS", 64)
    (tmp_path / "a.tif").write_bytes(tiff.encoded(np.zeros((64, 4)), (0, 0), (1, 1), None, rows=8))
    whole, some = tiff._Reader(str(tmp_path)), tiff._Reader(str(tmp_path))
    assert sum(len(p.header.at) for p in whole.partitions()) == 8 and len(whole.partitions()) == 4
    assert len(list(some.pushFilters([GreaterThanOrEqual(("row",), 17), LessThan(("row",), 33)]))) == 2
    rows = pd.concat([b.to_pandas() for p in some.partitions() for b in some.read(p)])["row"]
    assert sum(len(p.header.at) for p in some.partitions()) == 3 and rows.min() == 16 and rows.max() == 39


def test_what_is_not_understood_is_an_error():
    with pytest.raises(ValueError, match="classic"):
        tiff.read_header(io.BytesIO(b"PK\x03\x04" + b"\0" * 50))
    raw = bytearray(tiff.encoded(np.zeros((4, 4)), (0, 0), (1, 1), None))
    at = raw.index(struct.pack("<HHI", 259, 3, 1))
    raw[at + 8 : at + 10] = struct.pack("<H", 5)
    with pytest.raises(ValueError, match="compression 5"):
        tiff.read_header(io.BytesIO(bytes(raw)))


def test_many_small_files_are_few_partitions(spark, tmp_path):
    """Two thousand files: a pack of many for each partition, no header read for the plan, and cells without a value left behind."""
    cells = np.full((40, 4), -9.0)
    cells[20, 1], cells[39, 3] = 5.0, 7.0
    raw = tiff.encoded(cells, (0, 0), (1, 1), -9.0)
    for i in range(2000):
        (tmp_path / f"{i}.tif").write_bytes(raw)
    reader = tiff._Reader(str(tmp_path))
    packs = reader.partitions()
    assert len(packs) < 100 and sum(len(p.paths) for p in packs) == 2000
    list(reader.pushFilters([IsNotNull(("value",)), LessThan(("row",), 30)]))
    batches = [b for p in packs[:1] for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == len(packs[0].paths) and len(batches) == 1
    got = tiff.read_rasters(spark, str(tmp_path)).where("row < 30 and value is not null")
    assert got.groupBy("row", "col", "value").count().collect() == [(20, 1, 5.0, 2000)]
    assert tiff.read_rasters(spark, str(tmp_path)).count() == 2000 * 160
