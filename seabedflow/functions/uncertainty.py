"""The full uncertainty model of a swath sounder: device tables, beam angles, and vertical and horizontal variances as column expressions.

Attitude is in degrees, lengths in metres, speeds in metres a second; ``depth`` here is positive down. Every term is an
expression over the ping's and the sounding's own columns, so a survey of any size is attributed in one pass without a shuffle.
Null inputs give null variances.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Device:
    """``angles`` names how angles are measured, ``pattern`` how beams are spread; ``range_floor`` is (fraction of depth, least) or
    ``range_cell`` (sampling distance, pulse length in seconds)."""

    beams: int
    khz: float
    max_angle: float
    across: float
    along: float
    steered: bool
    steer: float
    angles: str
    pattern: str = "even"
    range_floor: tuple[float, float] | None = None
    range_cell: tuple[float, float] | None = None


#: Properties of the devices that have an error model.
DEVICES = {
    "em300": Device(135, 30.0, 75.0, 1.0, 1.0, True, 0.0, "narrow", range_floor=(0.003, 0.15)),
    "em1000": Device(60, 95.0, 75.0, 3.3, 3.3, True, 60.0, "curved", range_cell=(0.15, 0.2e-3)),
    "em1002": Device(111, 95.0, 75.0, 1.5, 2.0, True, 60.0, "curved", range_cell=(0.0626, 0.2e-3)),
    "em3000": Device(128, 300.0, 65.0, 1.5, 1.5, True, 0.0, "flat", "sine", range_cell=(0.05, 0.033333e-3)),
    "em3000d": Device(254, 300.0, 65.0, 1.5, 1.5, True, 0.0, "flat", "two heads", range_cell=(0.05, 0.033333e-3)),
    "sb8101": Device(101, 240.0, 75.0, 1.5, 1.5, True, 60.0, "curved", range_cell=(0.05, 0.004e-3)),
    "sb9001": Device(60, 455.0, 45.0, 1.5, 1.5, False, 361.0, "amplitude", range_cell=(0.05, 0.07e-3)),
    "sb9003": Device(40, 455.0, 60.0, 3.0, 1.5, False, 361.0, "amplitude", range_cell=(0.05, 0.07e-3)),
    "sb8125": Device(240, 455.0, 60.0, 0.5, 1.0, True, 0.0, "flat", range_cell=(0.006, 0.011e-3)),
    "sb8111": Device(101, 100.0, 75.0, 1.5, 1.5, False, 361.0, "curved", range_cell=(0.037, 0.01e-3)),
    "em120": Device(191, 12.0, 75.0, 2.0, 1.0, True, 0.0, "flat", range_floor=(0.003, 0.6)),
    "hsweepds": Device(59, 15.5, 45.0, 2.3, 2.3, True, 0.0, "amplitude", range_floor=(0.006, 0.15)),
    "en1180": Device(126, 180.0, 77.0, 1.5, 1.5, True, 0.0, "amplitude", "crossed heads", range_cell=(0.06, 0.15e-3)),
    "sb2112": Device(151, 12.0, 75.0, 2.0, 2.0, True, 0.0, "amplitude", range_floor=(0.005, 0.15)),
}


@dataclass(frozen=True)
class Vessel:
    """Offsets of the sensors and standard deviations of what they measure; the defaults are typical ones."""

    gps: tuple[float, float, float] = (0.0, 0.0, 0.0)
    gps_off_sdev: float = 0.005
    gps_latency: float = 0.0
    gps_latency_sdev: float = 0.03
    gps_drms: float = 2.0
    imu: tuple[float, float, float] = (0.0, 0.0, 0.0)
    imu_off_sdev: float = 0.005
    imu_rp_align_sdev: float = 0.05
    imu_g_align_sdev: float = 0.10
    imu_latency_sdev: float = 0.005
    draft: float = 0.0
    tx_latency_sdev: float = 0.005
    static_roll: float = 0.0
    roll_sdev: float = 0.05
    pitch_sdev: float = 0.05
    pitch_stab_sdev: float = 0.0
    gyro_sdev: float = 0.5
    svp_sdev: float = 0.52
    surf_ss_sdev: float = 0.5
    heave_fixed_sdev: float = 0.05
    heave_var_percent: float = 0.05
    draft_sdev: float = 0.02
    ddraft_sdev: float = 0.02
    loading_sdev: float = 0.01
    sog_sdev: float = 0.2
    tide_measured_sdev: float = 0.02
    tide_predicted_sdev: float = 0.02

    @classmethod
    def from_config(cls, flat: Mapping[str, str], prefix: str = "vessel.sdev") -> Vessel:
        """Standard deviations out of a configuration (:func:`~seabedflow.functions.params.parse_config`); unknown names raise."""
        names = {"gps_offset": "gps_off_sdev", "gps_drms": "gps_drms", "imu_offset": "imu_off_sdev", "heave_var": "heave_var_percent", "surf_sspeed": "surf_ss_sdev", "tide_meas": "tide_measured_sdev", "tide_pred": "tide_predicted_sdev"}
        own = {k.removeprefix(f"{prefix}."): float(v.split()[0]) for k, v in flat.items() if k.startswith(f"{prefix}.")}
        return cls(**{names.get(k, f"{k}_sdev"): v for k, v in own.items()})

    def rad2(self, *sdevs: float) -> float:
        """Sum of squares of angles in degrees, in radians."""
        return sum(s * s for s in sdevs) * math.radians(1) ** 2

    @property
    def roll_var(self) -> float:
        return self.rad2(self.roll_sdev, self.imu_rp_align_sdev)

    @property
    def pitch_var(self) -> float:
        return self.rad2(self.pitch_sdev, self.imu_rp_align_sdev, self.pitch_stab_sdev)

    @property
    def gyro_var(self) -> float:
        return self.rad2(self.gyro_sdev, self.imu_g_align_sdev)

    @property
    def latency_var(self) -> float:
        return self.gps_latency_sdev**2 + self.imu_latency_sdev**2 + self.tx_latency_sdev**2

    @property
    def level_var(self) -> float:
        """Draft, squat, loading and tide."""
        return sum(s * s for s in (self.draft_sdev, self.ddraft_sdev, self.loading_sdev, self.tide_measured_sdev, self.tide_predicted_sdev))


def sq(x: Column) -> Column:
    return x * x


def beam_angle(d: Device, beam: Column, sspeed: Column) -> Column:
    """Degrees from the device's axis; beam 0 is the outermost one of the first side. Beams beyond the device have null."""
    mid = d.beams // 2
    side = beam < mid
    if d.pattern == "sine":
        angle = F.degrees(F.asin(3.0637 * (beam - mid) * sspeed / (d.khz * 1000)))
    elif d.pattern == "two heads":
        angle = F.when(side, -55.0 + 0.9524 * beam).otherwise(-65.0 + 0.9524 * (beam - mid))
    elif d.pattern == "crossed heads":
        angle = F.when(side, 37.25 + 1.25 * (beam - (mid - 1))).otherwise(-37.25 + 1.25 * (beam - mid))
    else:
        angle = (beam - mid) * (2 * d.max_angle / (d.beams - 1))
    return F.when((beam >= 0) & (beam <= d.beams), angle)


def detection(flags: Column) -> tuple[Column, Column]:
    """Whether a beam was detected by amplitude, and the number of samples in its window, out of its flags."""
    return F.getbit(flags, F.lit(0)) == 0, F.shiftright(flags, 1).bitwiseAND(F.lit(255)).cast("double")


def angle_variance(d: Device, angle: Column, by_amplitude: Column, window: Column) -> Column:
    """Variance in square radians of a measured beam angle."""
    n = F.greatest(window, F.lit(1.0))
    if d.angles == "narrow":
        bw = math.radians(1.0)
        return sq(F.when(by_amplitude, F.lit(0.5 * math.tan(bw))).otherwise(F.tan(0.5 * bw / F.sqrt(n))))
    bw = F.lit(math.radians(d.across))
    if d.angles == "flat":
        bw = bw / F.cos(angle)
    if d.angles == "amplitude":
        return sq(bw / 12)
    return sq(F.when(by_amplitude, bw / 12).otherwise(0.2 * bw / F.sqrt(n)))


def range_variance(d: Device, depth: Column, mean_speed: Column) -> Column:
    """Variance of a measured slant range."""
    if d.range_floor:
        return sq(F.greatest(d.range_floor[0] * depth, F.lit(d.range_floor[1])))
    cell, pulse = d.range_cell
    return F.lit((cell / 2) ** 2) + sq(mean_speed * (pulse / 4))


class Swath:
    """The terms of the model for one device on one vessel, over the columns ``beam``, ``depth``, ``range``, ``flags`` of a sounding and ``roll``, ``pitch``, ``heave``,
    ``surf_sspeed``, ``mean_speed`` (of sound), ``vessel_speed`` of its ping."""

    def __init__(self, device: Device | str, vessel: Vessel):
        self.d = DEVICES[device] if isinstance(device, str) else device
        self.v = vessel
        roll, pitch = F.radians("roll"), F.radians("pitch")
        self.cp, self.sp, self.cr, self.sr = F.cos(pitch), F.sin(pitch), F.cos(roll), F.sin(roll)
        # the mounting angle is in degrees like all other angles
        self.angle = F.radians(beam_angle(self.d, F.col("beam"), F.col("surf_sspeed")) - vessel.static_roll)
        self.range_var = range_variance(self.d, F.col("depth"), F.col("mean_speed"))

    def angle_var(self) -> Column:
        """Roll: sensor and mounting, sound speed at the face of a steered array and along the profile, and the device's own angle."""
        v, a = self.v, self.angle
        out = F.lit(v.roll_var) + sq(F.tan(a)) * v.svp_sdev**2 / (4 * sq(F.col("mean_speed")))
        out = out + angle_variance(self.d, a, *detection(F.col("flags")))
        if self.d.steered and v.surf_ss_sdev > 0:
            mount, steer = math.radians(v.static_roll), math.radians(self.d.steer)
            beyond = F.when(a < -steer - mount, a + steer + mount).when(a > steer - mount, a - steer + mount).otherwise(0.0)
            out = out + sq(F.tan(beyond)) * v.surf_ss_sdev**2 / sq(F.col("surf_sspeed"))
        return out

    def heave_var(self) -> Column:
        """Measured heave (a floor, or a share of the heave) and what roll and pitch induce at the sensor's offset."""
        v, (x, y, z) = self.v, self.v.imu
        measured = F.greatest(sq(2 * v.heave_var_percent * F.col("heave")), F.lit(v.heave_fixed_sdev**2))
        by_pitch = x * self.cp - y * self.sr * self.sp - z * self.cr * self.sp
        by_roll = y * self.cr * self.cp - z * self.sr * self.cp
        by_offset = sq(self.sp) + sq(self.sr * self.cp) + sq(1 - self.cr * self.cp)
        return measured + v.pitch_var * sq(by_pitch) + v.roll_var * sq(by_roll) + 2 * v.imu_off_sdev**2 * by_offset

    def depth_var(self) -> Column:
        """Range, roll, pitch and the width of the transmit beam, as they move the depth."""
        c, s, r = F.cos(F.radians("roll") + self.angle), F.sin(F.radians("roll") + self.angle), F.col("range")
        by_range = (self.range_var + sq(r) * self.v.svp_sdev**2 / sq(F.col("mean_speed"))) * sq(self.cp * c)
        by_angle = self.angle_var() * sq(r * s * self.cp)
        by_pitch = self.v.pitch_var * sq(r * c * self.sp)
        return by_range + by_angle + by_pitch + (1 - math.cos(math.radians(self.d.along) / 2)) ** 2 * sq(F.col("depth"))

    def vertical_var(self) -> Column:
        return F.lit(self.v.level_var) + self.heave_var() + self.depth_var()

    def relative_var(self) -> Column:
        """Position of the transducer relative to the antenna: offsets, heading, roll and pitch."""
        v, (x, y, z) = self.v, self.v.gps
        cp, sp, cr, sr = self.cp, self.sp, self.cr, self.sr
        offsets = (sq(cp) + sq(cr) + sq(sr * sp) + sq(sr) + sq(cr * sp)) * (v.gps_off_sdev**2 + v.imu_off_sdev**2)
        turn = sq(x * cp) + sq(y * cr) + sq(y * sr * sp) + sq(z * sp * cr) + sq(z * sr) - x * y * cp * sp * sr - x * z * cp * sp * cr - y * z * sq(cp) * sr * cr
        lean = y * y * (sq(sr) + sq(cr * sp)) + z * z * (sq(cr) + sq(sr * sp)) + y * z * cr * sr * sq(cp)
        tip = sq(x * sp + y * sr * cp + z * cr * cp)
        return offsets + turn * v.rad2(v.gyro_sdev) + lean * v.rad2(v.roll_sdev) + tip * v.rad2(v.pitch_sdev)

    def latency_var(self) -> Column:
        """What the vessel moves during latencies, and how well that is known."""
        v, way = self.v, F.col("vessel_speed")
        late2 = v.gps_latency**2
        return sq(self.cp) * (late2 * v.sog_sdev**2 + sq(way) * (v.latency_var + late2 * v.rad2(v.gyro_sdev))) + sq(way * self.sp) * late2 * v.pitch_var

    def beam_var(self) -> Column:
        """Position of the footprint relative to the transducer: range, heading, angle and pitch."""
        v, a, depth = self.v, self.angle, F.col("depth")
        ranges = (sq(v.svp_sdev * depth / (F.col("mean_speed") * F.cos(a))) + self.range_var) * (1 - sq(self.cp * F.cos(a)))
        heading = v.gyro_var * sq(depth) * (sq(self.sp) + sq(F.tan(a)))
        angles = self.angle_var() * sq(F.col("range")) * (1 - sq(self.cp * F.sin(a)))
        return ranges + heading + angles + sq(depth * self.cp) * v.pitch_var

    def horizontal_var(self) -> Column:
        return F.lit(self.v.gps_drms**2) + self.latency_var() + self.relative_var() + self.beam_var()


def attributed(t: DataFrame, fleet: Mapping[str, tuple[Device | str, Vessel]], platform: str = "platform") -> DataFrame:
    """``t`` with ``dz`` and ``dr`` by the device and vessel of its platform; an unknown platform stops the job."""
    lost = F.raise_error(F.concat(F.lit("no device for "), F.coalesce(F.col(platform), F.lit("null")))).cast("double")
    dz = dr = None
    for name, (device, vessel) in fleet.items():
        s, here = Swath(device, vessel), F.col(platform) == name
        dz = F.when(here, s.vertical_var()) if dz is None else dz.when(here, s.vertical_var())
        dr = F.when(here, s.horizontal_var()) if dr is None else dr.when(here, s.horizontal_var())
    return t.withColumns({"dz": dz.otherwise(lost), "dr": dr.otherwise(lost)})


def beam_table(device: Device | str, vessel: Vessel, depth: float, roll: float, pitch: float, heave: float, sspeed: float, way: float, crossover: float, spark) -> DataFrame:
    """One row for each beam over a flat bottom: beam, angle_deg, depth, range, vert95 and horz95 (95 % limits). Beams within ``crossover`` degrees of the
    nadir are detected by amplitude, others by phase with a window of one sample."""
    d = DEVICES[device] if isinstance(device, str) else device
    t = spark.range(d.beams).select(F.col("id").cast("int").alias("beam"))
    env = {"roll": roll, "pitch": pitch, "heave": heave, "surf_sspeed": sspeed, "mean_speed": sspeed, "vessel_speed": way, "depth": depth}
    t = t.withColumns({k: F.lit(float(x)) for k, x in env.items()})
    angle = beam_angle(d, F.col("beam"), F.col("surf_sspeed"))
    t = t.withColumns({"angle_deg": angle, "range": F.col("depth") / F.cos(F.radians(angle)), "flags": (F.abs(angle) > crossover).cast("int") * 3})
    s = Swath(d, vessel)
    return t.select("beam", "angle_deg", "depth", "range", (1.96 * F.sqrt(s.vertical_var())).alias("vert95"), (1.96 * F.sqrt(s.horizontal_var())).alias("horz95"))
