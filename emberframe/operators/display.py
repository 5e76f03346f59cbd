"""Data for displays: points, colours, frames, the wind compass. Drawing them is up to the reader's tools."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fuels import COLOURS, STATE_COLOURS
from .spread import state

# Fixed values, in pixels: the compass's centre, radius and label radius.
CX, CY, RADIUS, LABELS = 80, 80, 58, 74


def points(cells: DataFrame, cols: Column | int, cell: float = 5.0) -> DataFrame:
    """cells with point_id (row-major), x, y, z."""
    return cells.withColumns({"point_id": F.col("r") * cols + F.col("c"), "x": F.col("c") * cell, "y": F.col("r") * cell, "z": F.col("elevation")})


def display_code(fuel: Column, k: Column, step: Column | int, burn_steps: int = 60) -> Column:
    """The fuel index, 6 where burning, 7 where ash."""
    s = state(k, step, burn_steps)
    return F.when(s == 1, 6).when(s == 2, 7).otherwise(fuel).cast("int")


def frame(arrival: DataFrame, step: int, burn_steps: int = 60) -> DataFrame:
    """arrival (with fuel_idx) with its display code after a step; an empty history is an error."""
    if arrival.isEmpty():
        raise ValueError("no arrivals to show")
    return arrival.withColumn("code", display_code(F.col("fuel_idx"), F.col("ignite_step"), step, burn_steps))


def colours(spark: SparkSession) -> DataFrame:
    """code, hex, red, green, blue, alpha (0 to 1)."""
    part = lambda a: F.conv(F.substring("hex", a, 2), 16, 10).cast("double") / 255.0
    return spark.createDataFrame(COLOURS, "code int, hex string").select("code", "hex", part(2).alias("red"), part(4).alias("green"), part(6).alias("blue"), F.lit(1.0).alias("alpha"))


def state_colours(spark: SparkSession) -> DataFrame:
    """state, hex: the flat display's colours."""
    return spark.createDataFrame(STATE_COLOURS, "state int, hex string")


def interval_ms(fps: float) -> int:
    return max(1, int(1000 / fps))


def compass(wind: DataFrame) -> DataFrame:
    """wind: sim_id, wind_u, wind_v. sim_id, part, seq, x, y, label: circle (closed), ticks, labels, arrow, head, dot, speed.

    The arrow's angle is the negative of the wind's, as the display has it; true_rad of angles() is the other."""
    w = angles(wind)
    ring = lambda part, n, r, closed: w.select("sim_id", F.lit(part).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(n - 1 + closed))).alias("seq"), F.lit("").alias("label")).select(
        "sim_id", "part", "seq", (CX + r * F.cos(2 * pi * (F.col("seq") % n) / n)).alias("x"), (CY + r * F.sin(2 * pi * (F.col("seq") % n) / n)).alias("y"), "label")
    ways = [("N", pi / 2), ("S", -pi / 2), ("E", 0.0), ("W", pi)]
    a = F.col("angle_rad")
    tip = [CX + RADIUS * 0.8 * F.cos(a), CY + RADIUS * 0.8 * F.sin(a)]
    side = a + pi / 2
    row = lambda part, seq, x, y, label: F.struct(F.lit(part).alias("part"), F.lit(seq).alias("seq"), x.alias("x"), y.alias("y"), label.alias("label"))
    at = lambda r, g: (F.lit(CX) + r * F.cos(F.lit(g)), F.lit(CY) + r * F.sin(F.lit(g)))
    no = F.lit("")
    rows = []
    for k, (name, g) in enumerate(ways):
        rows += [row("tick", 2 * k, *at(RADIUS - 8, g), no), row("tick", 2 * k + 1, *at(RADIUS, g), no), row("label", k, *at(LABELS, g), F.lit(name))]
    rows += [row("arrow", 0, CX - RADIUS * 0.24 * F.cos(a), CY - RADIUS * 0.24 * F.sin(a), no), row("arrow", 1, *tip, no), row("head", 0, *tip, no)]
    rows += [row("head", k, tip[0] - 12 * F.cos(a) + s * 7 * F.cos(side), tip[1] - 12 * F.sin(a) + s * 7 * F.sin(side), no) for k, s in ((1, 1), (2, -1))]
    rows += [row("speed", 0, F.lit(float(CX)), F.lit(15.0), F.format_string("%.1f m/s", F.col("speed")))]
    fixed = w.select("sim_id", F.explode(F.array(*[r.cast("struct<part:string,seq:int,x:double,y:double,label:string>") for r in rows])).alias("p")).select("sim_id", "p.*")
    return ring("circle", 64, RADIUS, 1).unionByName(ring("dot", 16, 4, 0)).unionByName(fixed)


def angles(wind: DataFrame) -> DataFrame:
    true = F.atan2("wind_v", "wind_u")
    return wind.withColumns({"speed": F.hypot("wind_u", "wind_v"), "angle_rad": -true, "true_rad": true})
