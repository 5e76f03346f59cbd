"""Published surface-fire equations as column expressions, in DOUBLE; fractions are narrowed to FLOAT at the end.

Terms without moisture or wind are computed once for each fuel, on the dimension, and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .weather import clip

# Particle density, mineral damping, unit conversions.
PARTICLE_DENSITY = 32.0
ETA_S = 0.174 * 0.01**-0.19
M_TO_FT, MS_TO_FTMIN, FTMIN_TO_MPM = 3.28084, 196.8504, 0.3048

#: Terms of a cell whose fuel isn't in the table: nothing spreads there.
NO_FUEL = {"w0": 0.0, "mx": 0.3, "rho": 1e-9, "beta": 1e-9, "rel_beta": 1e-9, "ir0": 0.0, "xi": 0.0, "sink": 0.0, "c_w": 0.0, "b_w": 0.0, "e_w": 0.0}


def fuel_terms(fuels: DataFrame) -> DataFrame:
    """fuels with w0, mx, rho and what depends on the fuel alone: beta, rel_beta, ir0 (reaction intensity before moisture
    damping), xi, sink (heat sink before moisture), c_w, b_w, e_w. Missing attributes get defaults."""
    d = fuels.select(
        "fuel_idx", F.coalesce("fuel_load", F.lit(0.0)).alias("w0"), F.coalesce("surface_ratio", F.lit(1e-9)).alias("s"),
        F.coalesce("moisture_ext", F.lit(0.3)).alias("mx"), F.coalesce("heat_content", F.lit(8000.0)).alias("h"),
        F.coalesce("bulk_density", F.lit(0.1)).alias("rho"))
    d = d.withColumns({"s": F.when(F.col("s") > 0, F.col("s")).otherwise(1e-9), "rho": F.when(F.col("rho") > 0, F.col("rho")).otherwise(1e-9)})
    s, h = F.col("s"), F.col("h")
    d = d.withColumn("beta", F.col("rho") / PARTICLE_DENSITY)
    d = d.withColumn("rel_beta", F.col("beta") / (3.348 * F.pow(s, F.lit(-0.8189))))
    a = 1.0 / F.greatest(4.774 * F.pow(s, F.lit(0.1)) - 7.27, F.lit(1e-6))
    top = F.pow(s, F.lit(1.5)) / (495.0 + 0.0594 * F.pow(s, F.lit(1.5)))
    gamma = top * F.pow(F.col("rel_beta"), a) * F.exp(a * (1.0 - F.col("rel_beta")))
    return d.select(
        "fuel_idx", "w0", "mx", "rho", "beta", "rel_beta", (gamma * F.col("w0") * (1.0 - 0.0555) * h * ETA_S).alias("ir0"),
        (F.exp((0.792 + 0.681 * F.sqrt(s)) * (F.col("beta") + 0.1)) / (192.0 + 0.2595 * s)).alias("xi"),
        (F.col("rho") * F.exp(-138.0 / s)).alias("sink"), (7.47 * F.exp(-0.133 * F.pow(s, F.lit(0.55)))).alias("c_w"),
        (0.0252 * F.pow(s, F.lit(0.54))).alias("b_w"), (0.715 * F.exp(-3.59e-4 * s)).alias("e_w"))


def eta_m(moisture: Column, extinction: Column) -> Column:
    rm = clip(moisture / extinction, 0.0, 1.0)
    return 1.0 - 2.59 * rm + 5.11 * rm * rm - 3.52 * rm * rm * rm


def reaction(moisture: Column) -> dict[str, Column]:
    """eta_m, ir, denom of a row with fuel terms."""
    eta = eta_m(moisture, F.col("mx"))
    return {"eta_m": eta, "ir": F.col("ir0") * eta, "denom": F.col("sink") * (250.0 + 1116.0 * moisture)}


def fraction(dr: int, dc: int, here: Column, source: Column, u: Column, v: Column, cell: float, dt: float) -> Column:
    """Share of a cell that fire crosses in a time step, coming from (r - dr, c - dc); needs fuel terms, ir and denom."""
    norm = float(dr * dr + dc * dc) ** 0.5
    dist = cell * norm
    tan = F.greatest((here - source) * M_TO_FT / (dist * M_TO_FT), F.lit(0.0))
    phi_s = 5.275 * F.pow(F.greatest(F.col("beta"), F.lit(1e-9)), F.lit(-0.3)) * tan * tan
    along = F.greatest(u * (dc / norm) + v * (dr / norm), F.lit(0.0)) * MS_TO_FTMIN
    phi_w = F.col("c_w") * F.pow(along, F.col("b_w")) * F.pow(F.greatest(F.col("rel_beta"), F.lit(1e-9)), -F.col("e_w"))
    valid = (F.col("denom") > 0) & (F.col("ir") > 0) & (F.col("w0") > 0)
    safe = F.when(F.col("denom") > 0, F.col("denom")).otherwise(1e-9)
    rate = F.col("ir") * F.col("xi") * (1.0 + phi_w + phi_s) / safe * FTMIN_TO_MPM
    return F.when(valid, rate * dt / dist).otherwise(0.0).cast("float")
