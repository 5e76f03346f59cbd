"""Scalar expressions of weather: moisture of fine dead fuel and the wind vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def emc(temp_c: Column, rh: Column) -> Column:
    """Equilibrium moisture content as a fraction; three branches of humidity, split below 10 and below 50 percent."""
    f = temp_c * 9.0 / 5.0 + 32.0
    percent = (F.when(rh < 10, 0.03229 + 0.281073 * rh - 0.000578 * rh * f)
               .when(rh < 50, 2.22749 + 0.160107 * rh - 0.01478 * f)
               .otherwise(21.0606 + 0.005565 * rh * rh - 0.00035 * rh * f - 0.483199 * rh))
    return clip(percent / 100.0, 0.01, 0.30)


def wind_u(speed: Column, bearing: Column) -> Column:
    """East part of a wind that pushes towards bearing (degrees, 0 north, 90 east)."""
    return speed * F.cos(F.radians(F.pmod(90.0 - bearing, F.lit(360.0))))


def wind_v(speed: Column, bearing: Column) -> Column:
    return speed * F.sin(F.radians(F.pmod(90.0 - bearing, F.lit(360.0))))
