"""Files of soundings and raw logs, made byte by byte here, against what went into them."""

import math
import struct
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from seabedflow.functions.projections import Mercator
from seabedflow.functions.uncertainty import DEVICES, Vessel
from seabedflow.sources import datagrams as D
from seabedflow.sources import soundings as S


def test_plain_records(spark, tmp_path):
    rows = [(3, 0, 200, -70.5, 43.25, -12.5), (3, 255, 0, 179.0, -89.0, -4000.0)]
    # 2 + 1 + 1 bytes, 4 of padding, two doubles, a float, 4 of padding
    data = b"".join(struct.pack("<HBBxxxxddfxxxx", *r) for r in rows)
    (tmp_path / "a.snd").write_bytes(data)
    (tmp_path / "empty.snd").write_bytes(b"")
    t = S.read_plain(spark, str(tmp_path), Mercator(-70.5, 43.0))
    got = t.orderBy("seq").collect()
    assert [(r.file_id, r.beam, r.backscatter, r.lon, r.lat, r.depth) for r in got] == rows and {r.flags for r in got} == {0}
    assert abs(got[0].east) < 1e-6 and got[0].north > 20_000
    files = S.plain_files(t)
    assert [bytes(r.content) for r in files.collect()] == [data]
    S.save_files(files, f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "a.snd").read_bytes() == data
    for bad in (data[:-1], struct.pack("<HBBxxxxddfxxxx", 1, 1, 1, 500.0, 0.0, 0.0)):
        with pytest.raises(ValueError):
            S.parse_plain("x", bad)


def native(pings, device=4, version=1, magic=0x4E534E44):
    vessel = struct.pack("<dIxxxx34d", 0.0, device, *(float(i) for i in range(34)))
    out = [struct.pack("<III", magic, version, device), vessel]
    for number, beams in pings:
        out.append(struct.pack("<iHi", len(beams), 9, number) + struct.pack("<ddd7fxxxx", 1000.0 + number, 43.0, -70.0, 1, 2, 3, 4, 1500, 1490, 5))
        out += [struct.pack("<HBBxxxxddffffIxxxx", 9, b, 7, -70.0 + b / 100, 43.0, -10.0 - b, 12.0, 0.5, 0.25, 3) for b in beams]
    return b"".join(out)


def test_native_files(spark, tmp_path):
    data = native([(1, [0, 1, 2]), (2, []), (3, [5])])
    assert len(native([])) == 12 + 288 and S.SOUNDING.itemsize == 48 and S.PLATFORM.itemsize == 56
    (tmp_path / "line").write_bytes(data)
    t = S.read_native(spark, str(tmp_path / "line"))
    got = t.orderBy("seq").collect()
    assert [(r.ping, r.beam, r.depth) for r in got] == [(1, 0, -10.0), (1, 1, -11.0), (1, 2, -12.0), (3, 5, -15.0)]
    r = got[3]
    assert (r.device, r.ts, r.p_lat, r.p_lon, r.roll, r.pitch, r.heading, r.heave, r.surf_sspeed, r.mean_speed, r.vessel_speed, r.range, r.dz, r.dr, r.flags, r.backscatter) == ("em3000", 1003.0, 43.0, -70.0, 1, 2, 3, 4, 1500, 1490, 5, 12, 0.5, 0.25, 3, 7)
    device, vessel, at = S.native_header("x", data)
    assert device == "em3000" and at == 300 and vessel.gps == (0, 1, 2) and vessel.gps_off_sdev == 3 and vessel.imu == (7, 8, 9) and vessel.imu_rp_align_sdev == 14 and vessel.tide_predicted_sdev == 33
    back = S.native_files(t, "em3000", Vessel(draft=0.7)).collect()[0]
    again = S.parse_native("y", bytes(back.content))
    pd.testing.assert_frame_equal(again.drop(columns=["file", "seq"]), S.parse_native("y", data).drop(columns=["file", "seq"]), check_dtype=False)
    assert S.native_header("y", bytes(back.content))[1] == Vessel(draft=0.7) and len(S.parse_native("y", native([]))) == 0
    for bad in (data[:-1], data[:310], b"", native([], version=2), native([], magic=0x444E534E), native([], magic=1), native([], device=99)):
        with pytest.raises(ValueError):
            S.parse_native("z", bad)
    assert list(DEVICES)[:4] == ["em300", "em1000", "em1002", "em3000"]


def gram(kind, body, model=1002, date=20010203, ms=3_600_500):
    size = 12 + len(body) + 3
    return struct.pack(">IBBHII", size, 2, kind, model, date, ms) + body + b"\x03\x00\x00"


def log():
    beams = [(1234, -50, 120, 0, 0, 0, 0x80, 11, -40, 1), (-5, 70, -20, 0, 0, 0, 0, 4, -31, 3)]
    depth = struct.pack(">HHHHHBBBBH", 77, 1, 9050, 14853, 250, 111, len(beams), 2, 5, 0) + b"".join(struct.pack(">hhhhHHBBbB", *b) for b in beams) + struct.pack("b", 1)
    motion = [(k * 10, 0, 100 * k, -50, 7, 35900) for k in range(20)]
    att = struct.pack(">HHH", 1, 1, len(motion)) + b"".join(struct.pack(">HHhhhH", *m) for m in motion) + b"\x00"
    fix = struct.pack(">HHiiHHHH", 1, 1, int(43.5 * 2e7), int(-70.25 * 1e7), 1, 512, 100, 200) + b"\x01\x00"
    image = struct.pack(">HHHHHHHbbHBB", 77, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2) + struct.pack(">BbHH", 0, -1, 3, 1) + struct.pack(">BbHH", 9, 1, 2, 0) + struct.pack("5b", -1, -2, -3, 4, 5)
    return gram(D.POSITION, fix, ms=1000) + b"noise\x02noise" + gram(D.DEPTH, depth) + gram(D.ATTITUDE, att) + gram(D.IMAGERY, image) + gram(0x99, b"") + gram(D.DEPTH, depth, model=300, ms=500)


def test_raw_logs(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(log())
    (tmp_path / "cut.raw").write_bytes(gram(D.POSITION, b"x" * 30)[:-5])
    t = D.read_datagrams(spark, str(tmp_path)).cache()
    assert [r.kind for r in t.orderBy("offset").collect()] == [0x50, 0x44, 0x41, 0x53, 0x99, 0x44] and t.where("file like '%cut%'").count() == 0
    second = datetime(2001, 2, 3, tzinfo=timezone.utc).timestamp() + 3600.5
    beams = D.depth_beams(t).orderBy("offset", "beam").collect()
    b = beams[0]
    assert (b.ts, b.ping, b.heading, b.surf_sspeed, b.mean_speed, b.beam, b.ahead, b.starboard, b.backscatter, b.flags) == (second, 77, 90.5, 1485.3, 1485.3, 0, 6.0, -2.5, -20.0, 1 + 22)
    assert math.isclose(b.depth, 24.68 + 2.5 + 655.36) and beams[1].flags == 8 and math.isclose(beams[1].depth, -0.1 + 2.5 + 655.36)
    assert math.isclose(beams[3].depth, 65531 * 0.02 + 2.5 + 655.36)  # depths of deep models fill 16 bits
    att = D.attitudes(t).orderBy("ts").collect()
    assert len(att) == 20 and (att[3].roll, att[3].pitch, att[3].heave, att[3].heading) == (3.0, -0.5, 0.07, 359.0) and math.isclose(att[3].ts, second + 0.03)
    f = D.fixes(t).collect()[0]
    assert (f.lat, f.lon, f.sog, f.course, f.heading) == (43.5, -70.25, 5.12, 1.0, 2.0)
    images = D.image_beams(t)
    assert [(r.beam, r.side, r.centre, r.samples) for r in images.orderBy("beam").collect()] == [(0, "port", 1, [-1, -2, -3]), (9, "starboard", 0, [4, 5])]
    placed = D.placed_images(images, D.depth_beams(t).withColumns({"east": F.col("starboard"), "north": F.col("ahead")})).orderBy("beam").collect()
    assert (placed[0].east, placed[0].north, placed[1].east) == (-2.5, 6.0, None)
    assert D.trimmed(D.depth_beams(t), D.fixes(t)).select("offset").distinct().count() == 1  # the second ping is older than the first fix
    with pytest.raises(ValueError):
        list(D.frames("x", b"\x00" * 3000))


def test_attitude_filter(spark):
    h, step = D.fir(100.0, 10.0, 21)
    assert math.isclose(sum(h), 1) and step == 10 and h == pytest.approx(h[::-1], abs=0.02) and D.fir(5.0, 10.0, 21) == ([1.0], 1)
    assert D.input_rate([0, 10, 20, 40]) == pytest.approx((100 + 100 + 50) / 3)
    x = np.sin(np.arange(50) / 5)
    got = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(D.decimated(F.col("x"), h, 7)).first()[0]
    mirrored = np.concatenate([x[10:0:-1], x, x[-2:-12:-1]])
    assert got == pytest.approx([float(mirrored[i : i + 21] @ np.array(h)) for i in range(0, 50, 7)])
    rows = [("f", 0, 1000 + i / 100, float(x[i]), 1.0, 2.0, 3.0) for i in range(50)] + [("f", 9, 1.0, 1.0, 1.0, 1.0, 1.0)]
    att = spark.createDataFrame(rows, "file string, offset long, ts double, roll double, pitch double, heave double, heading double")
    out = D.smooth_attitude(att, 10.0, 21).orderBy("ts").collect()
    step = D.fir(D.input_rate([10.0 * i for i in range(50)]), 10.0, 21)[1]
    assert [r.roll for r in out] == pytest.approx([float(mirrored[i : i + 21] @ np.array(h)) for i in range(0, 50, step)], abs=1e-6) and {round(r.heave, 9) for r in out} == {2.0}
