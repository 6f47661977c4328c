"""Calibration of Meteosat Second Generation channels."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.engine.graph import Context, GraphError, Operator, need
from terrafold.model.descriptor import RasterDescriptor
from terrafold.model.rect import Rect
from terrafold.model.time import days_of

#: Property keys, radiation constants, view angle factors.
OFFSET, SLOPE, CHANNEL, SATELLITE = "msg.calibration_offset", "msg.calibration_slope", "msg.channel_number", "msg.satellite"
C1, C2 = 1.19104273e-16, 0.0143877523
VIEW_ANGLE, VIEW_ANGLE_HRV = 65536.0 / (-13_642_337.0 * 3_000.403_165_817), 65536.0 / (-40_927_014.0 * 1_000.134_348_869)
#: Solar irradiance of channels 1, 2, 3 and 12 by satellite.
ETSR = {
    1: (65.2296, 73.0127, 62.3715, 78.7599),
    2: (65.2065, 73.1869, 61.9923, 79.0113),
    3: (65.5148, 73.1807, 62.0208, 78.9416),
    4: (65.2656, 73.1692, 61.9416, 79.0035),
}
#: Central wave number, alpha and beta of channels 4 to 11 by satellite.
THERMAL = {
    1: ((2567.33, 0.9956, 3.41), (1598.103, 0.9962, 2.218), (1362.081, 0.9991, 0.478), (1149.069, 0.9996, 0.179), (1034.343, 0.9999, 0.06), (930.647, 0.9983, 0.625), (839.66, 0.9988, 0.397), (752.387, 0.9981, 0.578)),
    2: ((2568.832, 0.9954, 3.438), (1600.548, 0.9963, 2.185), (1360.33, 0.9991, 0.47), (1148.62, 0.9996, 0.179), (1035.289, 0.9999, 0.056), (931.7, 0.9983, 0.64), (836.445, 0.9988, 0.408), (751.792, 0.9981, 0.561)),
    3: ((2547.771, 0.9915, 2.9002), (1595.621, 0.996, 2.0337), (1360.337, 0.9991, 0.434), (1148.13, 0.9996, 0.1714), (1034.715, 0.9999, 0.0527), (929.842, 0.9983, 0.6084), (838.659, 0.9988, 0.3882), (750.653, 0.9982, 0.539)),
    4: ((2555.28, 0.9916, 2.9438), (1596.08, 0.9959, 2.078), (1361.748, 0.999, 0.4929), (1147.433, 0.9996, 0.1731), (1034.851, 0.9998, 0.0597), (931.122, 0.9983, 0.6256), (839.113, 0.9988, 0.4002), (748.585, 0.9981, 0.5635)),
}


def _property(desc: RasterDescriptor, key: str) -> float:
    value = desc.property(key)
    if value is None:
        raise GraphError(f"no property {key!r}")
    return value


def _satellite(desc: RasterDescriptor, forced: int | None) -> int:
    number = forced if forced is not None else _property(desc, SATELLITE)
    if number not in ETSR:
        raise GraphError(f"unknown satellite {number}")
    return int(number)


@dataclass(frozen=True)
class Radiance(Operator):
    """offset + value * slope of the dataset's calibration, as 32-bit floats."""

    TYPE: ClassVar[str] = "Radiance"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator

    def describe(self, ctx: Context) -> RasterDescriptor:
        return need("raster", self.raster, ctx).but(data_type="F32")

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        desc = need("raster", self.raster, ctx)
        offset, slope = (F.lit(float(_property(desc, k))).cast("float") for k in (OFFSET, SLOPE))
        return self.raster.query(ctx, rect).withColumn("value", offset + F.col("value").cast("float") * slope)


def sun_zenith(t_ms: Column, lat: Column, lon: Column) -> Column:
    """Zenith angle of the sun in degrees at an epoch time in ms; the published almanac series for 1999 to 2015 and near it."""
    hours = F.floor(F.pmod(t_ms, F.lit(86_400_000).cast("long")) / 1000) / 3600.0
    n = days_of(t_ms) - 10_957 - 0.5 + hours / 24.0  # days since noon of 1 January 2000
    omega, mean, anomaly = 2.1429 - 0.0010394594 * n, 4.8950630 + 0.017202791698 * n, 6.2400600 + 0.0172019699 * n
    longitude = mean + 0.03341607 * F.sin(anomaly) + 0.00034894 * F.sin(2 * anomaly) - 0.0001134 - 0.0000203 * F.sin(omega)
    obliquity = 0.4090928 - 6.2140e-9 * n + 0.0000396 * F.cos(omega)
    ascension = F.atan2(F.cos(obliquity) * F.sin(longitude), F.cos(longitude))
    declination = F.asin(F.sin(obliquity) * F.sin(longitude))
    hour_angle = F.radians((6.6974243242 + 0.0657098283 * n + hours) * 15 + lon) - ascension
    phi = F.radians(lat)
    zenith = F.acos(F.cos(phi) * F.cos(hour_angle) * F.cos(declination) + F.sin(declination) * F.sin(phi))
    return F.degrees(zenith + 6371.01 / 149_597_890.0 * F.sin(zenith))


def seen_from_space(x: Column, y: Column, factor: float) -> tuple[Column, Column]:
    """Latitude and longitude of a geostationary coordinate."""
    a, b = F.radians(x * (-factor)), F.radians(y * factor)
    cc = F.cos(a) * F.cos(b)
    flat = F.cos(b) ** 2 + 1.006803 * F.sin(b) ** 2
    distance = F.sqrt((42164.0 * cc) ** 2 - flat * 1_737_121_856.0)
    sn = (42164.0 * cc - distance) / flat
    s1, s2, s3 = 42164.0 - sn * cc, sn * F.sin(a) * F.cos(b), -sn * F.sin(b)
    return F.degrees(F.atan(1.006804 * s3 / F.sqrt(s1**2 + s2**2))), F.degrees(F.atan(s2 / s1))


@dataclass(frozen=True)
class Reflectance(Operator):
    """Radiance as a share of the sun's, by its distance on the day, and with ``solar_correction`` by its height (zenith at most 80 degrees)."""

    TYPE: ClassVar[str] = "Reflectance"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    solar_correction: bool = False
    force_hrv: bool = False
    force_satellite: int | None = None

    def describe(self, ctx: Context) -> RasterDescriptor:
        return need("raster", self.raster, ctx).but(data_type="F32")

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        desc = need("raster", self.raster, ctx)
        satellite = _satellite(desc, self.force_satellite)
        channel = 12 if self.force_hrv else int(_property(desc, CHANNEL))
        if not 1 <= channel <= 12:
            raise GraphError(f"unknown channel {channel}")
        etsr = dict(zip((1, 2, 3, 12), ETSR[satellite], strict=True)).get(channel, 0.0) / math.pi
        day = F.dayofyear(F.date_from_unix_date(days_of(F.col("t_start"))))
        esd = 1.0 - 0.0167 * F.cos(2 * math.pi * ((day - 3) / 365.0))
        height = F.lit(1.0)
        if self.solar_correction:
            t = desc.transform
            lat, lon = seen_from_space(t.x + (F.col("x") + 0.5) * t.x_size, t.y + (F.col("y") + 0.5) * t.y_size, VIEW_ANGLE_HRV if channel == 12 else VIEW_ANGLE)
            height = F.cos(F.radians(F.least(sun_zenith(F.col("t_start"), lat, lon), F.lit(80.0))))
        from terrafold.functions.expression import divide

        value = divide(F.col("value").cast("double") * esd * esd, F.lit(etsr) * height)
        return self.raster.query(ctx, rect).withColumn("value", value.cast("float"))


@dataclass(frozen=True)
class Temperature(Operator):
    """Brightness temperature of channels 4 to 11 from 10-bit counts; counts beyond 1023 are no data."""

    TYPE: ClassVar[str] = "Temperature"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    force_satellite: int | None = None

    def describe(self, ctx: Context) -> RasterDescriptor:
        return need("raster", self.raster, ctx).but(data_type="F32")

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        desc = need("raster", self.raster, ctx)
        channel = int(_property(desc, CHANNEL))
        if not 4 <= channel <= 11:
            raise GraphError(f"channel {channel} has no temperature")
        vc, alpha, beta = THERMAL[_satellite(desc, self.force_satellite)][channel - 4]
        offset, slope = float(_property(desc, OFFSET)), float(_property(desc, SLOPE))
        from terrafold.functions.expression import divide

        v = F.col("value")
        v = F.when(v >= 0, F.floor(v)).when(v < 0, F.lit(0))  # an index: cut off, and nothing below 0
        radiance = offset + v * slope
        ratio = divide(F.lit(C1 * 1.0e6 * vc**3), 1.0e-5 * radiance)
        kelvin = (divide(F.lit(C2 * 100.0 * vc), F.log1p(ratio)) - beta) / alpha
        return self.raster.query(ctx, rect).withColumn("value", F.when(v.between(0, 1023), kelvin.cast("float")))
