"""Rasters: round trips of all kinds, foreign byte order, several strips, and files that are none."""

import struct

import numpy as np
import pytest
from seabedflow.sources import rasters as R


@pytest.mark.parametrize("kind", ["u8", "u16", "f32"])
def test_round_trip(kind):
    z = np.array([[1.0, 2.0, 3.0], [200.0, 5.0, 0.0], [7.0, 8.0, 250.0]])
    assert (R.decode(R.encode(z, kind)) == z).all()
    if kind != "f32":
        with pytest.raises(ValueError):
            R.encode(z * -1, kind)


def test_foreign_file():
    """Big-endian, two strips whose places are beyond the table."""
    tags = [(256, 4, 1, 2), (257, 4, 1, 2), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 2, 200), (277, 3, 1, 1 << 16), (279, 4, 2, 208)]
    head = struct.pack(">2sHI", b"MM", 42, 8) + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + bytes(4)
    body = head.ljust(200, b"\0") + struct.pack(">IIII", 220, 216, 4, 4) + struct.pack(">HHHH", 3, 4, 1, 65535)
    assert R.decode(body).tolist() == [[1, 65535], [3, 4]]
    for bad in (b"", b"II*\0", body[:60], body.replace(struct.pack(">HHI", 259, 3, 1) + b"\0\1", struct.pack(">HHI", 259, 3, 1) + b"\0\5")):
        with pytest.raises(ValueError):
            R.decode(bad)


def test_tiles_and_reading(spark, tmp_path):
    cells = [(0, 0, -1.5), (3, 2, -2.0), (4, 0, -9.0), (4, 0, -8.0), (1, 1, None)]
    for r in R.encode_tiles(spark.createDataFrame(cells, "row int, col int, z double"), tile=4).collect():
        (tmp_path / f"{r.tile_row}_{r.tile_col}.tif").write_bytes(r.content)
    got = sorted((r.file[-7:], r.row, r.col, r.z) for r in R.read_rasters(spark, str(tmp_path)).collect())
    assert got == [("0_0.tif", 0, 0, -1.5), ("0_0.tif", 3, 2, -2.0), ("1_0.tif", 0, 0, -9.0)]
