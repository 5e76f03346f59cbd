"""Live playback and live weather with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weather import emc
from ..operators.display import display_code


def ticks(spark: SparkSession, per_second: int = 10) -> DataFrame:
    """An unbounded stream of steps: ts, step."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("timestamp").alias("ts"), F.col("value").cast("int").alias("step"))


def live_frames(steps: DataFrame, arrival: DataFrame, last: int = 200, burn_steps: int = 60) -> DataFrame:
    """Every tick's changed cells (r, c, code): those that ignite or turn to ash at it. Whole frames are sums of changes, so a
    micro-batch costs what changes, not the grid."""
    k = F.col("ignite_step")
    turns = arrival.where("ignite_step IS NOT NULL").select("r", "c", "fuel_idx", "ignite_step", F.explode(F.array(F.greatest(k, F.lit(0)), k + burn_steps)).alias("step"))
    return steps.where(F.col("step") < last).join(turns, "step").select("ts", "step", "r", "c", display_code(F.col("fuel_idx"), k, F.col("step"), burn_steps).alias("code"))


def live_moisture(weather: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """weather stream (ts, temp_c, rh): mean moisture of fine fuel by window, late rows up to the watermark."""
    return weather.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.avg(emc(F.col("temp_c"), F.col("rh"))).alias("moisture"), F.count("*").alias("n"))
