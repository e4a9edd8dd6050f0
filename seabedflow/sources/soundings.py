"""Files of soundings: plain records, and the native format with its platform header by ping, both read and written.

Files come through Spark's binary file source, so any path that Spark can open will do. A file is one task (a survey line is some
hundred megabytes at most; Spark refuses more than two gigabytes). Both formats are little-endian with the padding that their records have in memory.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import astuple, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uncertainty import DEVICES, Vessel


def _record(size: int, **at: tuple[str, int]) -> np.dtype:
    return np.dtype({"names": list(at), "formats": [f for f, _ in at.values()], "offsets": [o for _, o in at.values()], "itemsize": size})


#: Records of the formats.
PLAIN = _record(32, file_id=("<u2", 0), beam=("u1", 2), backscatter=("u1", 3), lon=("<f8", 8), lat=("<f8", 16), depth=("<f4", 24))
SOUNDING = _record(48, file_id=("<u2", 0), beam=("u1", 2), backscatter=("u1", 3), lon=("<f8", 8), lat=("<f8", 16), depth=("<f4", 24), range=("<f4", 28), dz=("<f4", 32), dr=("<f4", 36), flags=("<u4", 40))
PLATFORM = _record(56, ts=("<f8", 0), p_lat=("<f8", 8), p_lon=("<f8", 16), roll=("<f4", 24), pitch=("<f4", 28), heading=("<f4", 32), heave=("<f4", 36), surf_sspeed=("<f4", 40), mean_speed=("<f4", 44), vessel_speed=("<f4", 48))
PING = struct.Struct("<iHi")
HEADER = struct.Struct("<III")
MAGIC, REVERSED, VERSION = 0x4E534E44, 0x444E534E, 1
#: The numbers in the vessel block after its time stamp and device, by their place.
VESSEL_ORDER = "gps gps_off_sdev gps_latency_sdev gps_drms gps_latency imu imu_off_sdev _angles imu_rp_align_sdev imu_g_align_sdev imu_latency_sdev draft tx_latency_sdev static_roll roll_sdev pitch_sdev pitch_stab_sdev gyro_sdev svp_sdev surf_ss_sdev heave_fixed_sdev heave_var_percent draft_sdev ddraft_sdev loading_sdev sog_sdev tide_measured_sdev tide_predicted_sdev".split()
VESSEL = struct.Struct("<dIxxxx34d")
DEPTH_LIMIT = 20_000.0

_PLAIN_COLUMNS = "file string, seq long, file_id int, beam int, backscatter int, lon double, lat double, depth float, flags int"
_NATIVE_COLUMNS = "file string, seq long, device string, file_id int, ping long, ts double, p_lat double, p_lon double, roll float, pitch float, heading float, heave float, surf_sspeed float, mean_speed float, vessel_speed float, beam int, backscatter int, lon double, lat double, depth float, range float, dz float, dr float, flags long"


def read_files(spark: SparkSession, path: str | list[str], parse: Callable[[str, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """``parse(file name, bytes)`` of every file of the path, one file in memory at a time for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b.path, b.content, strict=True):
                yield parse(name, data)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def parse_plain(name: str, data: bytes) -> pd.DataFrame:
    if len(data) % PLAIN.itemsize:
        raise ValueError(f"{name}: {len(data)} bytes are no whole number of records")
    r = np.frombuffer(data, PLAIN)
    if len(r) and not (-180 <= r["lon"][0] < 180 and -90 <= r["lat"][0] < 90 and abs(r["depth"][0]) <= DEPTH_LIMIT):
        raise ValueError(f"{name}: the first record is no sounding")
    out = pd.DataFrame({n: r[n] for n in PLAIN.names})
    out.insert(0, "file", name)
    out.insert(1, "seq", np.arange(len(r)))
    return out.assign(flags=0)


def read_plain(spark: SparkSession, path: str | list[str], proj=None) -> DataFrame:
    """Plain records: one row per sounding with lon and lat, and with a projection east and north; all are amplitude detections."""
    return _placed(read_files(spark, path, parse_plain, _PLAIN_COLUMNS), proj)


def _placed(t: DataFrame, proj) -> DataFrame:
    if proj is None:
        return t
    east, north = proj.forward(F.col("lon"), F.col("lat"))
    return t.withColumns({"east": east, "north": north})


def native_header(name: str, data: bytes) -> tuple[str, Vessel, int]:
    """Device, vessel and where the first ping begins; raises on another format, byte order or version."""
    if len(data) < HEADER.size + VESSEL.size:
        raise ValueError(f"{name}: too short for a header")
    magic, version, device = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError(f"{name}: " + ("written in the other byte order" if magic == REVERSED else "no native file"))
    if version != VERSION:
        raise ValueError(f"{name}: version {version}")
    if not 1 <= device <= len(DEVICES):
        raise ValueError(f"{name}: device {device} is not known")
    numbers, values = iter(VESSEL.unpack_from(data, HEADER.size)[2:]), {}
    for field in VESSEL_ORDER:
        values[field] = tuple(next(numbers) for _ in range(3)) if field in ("gps", "imu", "_angles") else next(numbers)
    values.pop("_angles")
    return list(DEVICES)[device - 1], Vessel(**values), HEADER.size + VESSEL.size


def parse_native(name: str, data: bytes) -> pd.DataFrame:
    device, _, at = native_header(name, data)
    parts = []
    while at < len(data):
        if at + PING.size + PLATFORM.itemsize > len(data):
            raise ValueError(f"{name}: the file ends inside a ping's header")
        n, file_id, ping = PING.unpack_from(data, at)
        at += PING.size
        own = np.frombuffer(data, PLATFORM, 1, at)
        at += PLATFORM.itemsize
        if n < 0 or at + n * SOUNDING.itemsize > len(data):
            raise ValueError(f"{name}: ping {ping} is cut off")
        beams = np.frombuffer(data, SOUNDING, n, at)
        at += n * SOUNDING.itemsize
        cols = {"file_id": file_id, "ping": ping, **{k: own[k][0] for k in PLATFORM.names}, **{k: beams[k] for k in SOUNDING.names if k != "file_id"}}
        parts.append(pd.DataFrame(cols, index=range(n)))
    out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["file_id", "ping", *PLATFORM.names, *(n for n in SOUNDING.names if n != "file_id")])
    out.insert(0, "file", name)
    out.insert(1, "seq", np.arange(len(out)))
    out.insert(2, "device", device)
    return out


def read_native(spark: SparkSession, path: str | list[str], proj=None) -> DataFrame:
    """Native files: one row per sounding with its ping's platform (``p_lat``, ``p_lon``, attitude, speeds); positions are degrees, with a projection also metres."""
    return _placed(read_files(spark, path, parse_native, _NATIVE_COLUMNS), proj)


def _vessel_block(v: Vessel, device: int) -> bytes:
    own = dict(zip((f.name for f in fields(v)), astuple(v), strict=True)) | {"_angles": (0.0, 0.0, 0.0)}
    numbers = [x for n in VESSEL_ORDER for x in (own[n] if isinstance(own[n], tuple) else (own[n],))]
    return VESSEL.pack(0.0, device, *numbers)


def native_files(t: DataFrame, device: str, vessel: Vessel, file: str = "file") -> DataFrame:
    """``t`` (the columns of :func:`read_native`) as whole files: name and content. A file's soundings meet in one task; its pings come by number, its beams by theirs."""
    number = list(DEVICES).index(device) + 1
    head = HEADER.pack(MAGIC, VERSION, number) + _vessel_block(vessel, number)
    names = ["file_id", "ping", *PLATFORM.names, *(n for n in SOUNDING.names if n != "file_id")]

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [key[0]], "content": [native_bytes(head, g)]})

    return t.select(F.col(file).alias("_file"), *names).groupBy("_file").applyInPandas(pack, "name string, content binary")


def native_bytes(head: bytes, g: pd.DataFrame) -> bytes:
    """A file out of its header and its soundings."""
    out = [head]
    for ping, p in g.sort_values(["ping", "beam"], kind="stable").groupby("ping", sort=True):
        own = np.zeros(1, PLATFORM)
        for n in PLATFORM.names:
            own[n] = p[n].iloc[0]
        beams = np.zeros(len(p), SOUNDING)
        for n in SOUNDING.names:
            beams[n] = p[n].to_numpy()
        out += [PING.pack(len(p), int(p.file_id.iloc[0]), int(ping)), own.tobytes(), beams.tobytes()]
    return b"".join(out)


def plain_files(t: DataFrame, file: str = "file") -> DataFrame:
    """``t`` (file, seq and the columns of the record) as whole files of plain records."""

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros(len(g), PLAIN)
        g = g.sort_values("seq", kind="stable")
        for n in PLAIN.names:
            r[n] = g[n].to_numpy()
        return pd.DataFrame({"name": [key[0]], "content": [r.tobytes()]})

    return t.select(F.col(file).alias("_file"), "seq", *PLAIN.names).groupBy("_file").applyInPandas(pack, "name string, content binary")


def save_files(files: DataFrame, folder: str) -> None:
    """Write (name, content) as files of a folder, the last part of each name being the file's; one file at a time passes the driver."""
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in files.toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{r.name.rsplit('/', 1)[-1]}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(r.content))
        out.close()


#: Readers by the name of their format.
READERS = {"plain": read_plain, "native": read_native}


def open_soundings(spark: SparkSession, kind: str, path: str | list[str], proj=None) -> DataFrame:
    """Soundings of files of a format; ``path`` may be several, read as one."""
    if kind not in READERS:
        raise ValueError(f"format {kind!r} is not one of {sorted(READERS)}")
    return READERS[kind](spark, path, proj)


def two_heads(t: DataFrame, port_beams: int, port: str, starboard: str) -> DataFrame:
    """Soundings of a vessel with two heads under the names of two platforms: beams below ``port_beams`` are the port head's."""
    return t.withColumn("platform", F.when(F.col("beam") < port_beams, F.lit(port)).otherwise(F.lit(starboard)))
