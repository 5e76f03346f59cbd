"""Landscape operators: grid, terrain, fuel patches, moisture, neighbour shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.weather import clip, emc
from ..sources.fuels import OFFSETS


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """r, c, row-major; no cross join: both come from one range."""
    return spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))


def axis(k: Column, n: Column | int) -> Column:
    """Evenly spaced from 0 to 10, both included; an axis of one point is 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 1, 10.0 * k / (n - 1)).otherwise(0.0)


def elevation(x: Column, y: Column) -> Column:
    """x from the column, y from the row."""
    return F.sin(x) * F.cos(y) * 30.0 + F.sin(x / 2.0) * 20.0 + 50.0


def normalised(cells: DataFrame, col: str = "elevation", alias: str = "elev_norm") -> DataFrame:
    """Min-max over the whole table: one row of partial extremes, broadcast; null where all are equal."""
    ends = cells.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    return cells.crossJoin(F.broadcast(ends)).withColumn(alias, F.try_divide(F.col(col) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def moisture(elev_norm: Column, noise: Column, config: Config = Config()) -> Column:
    """Valleys hold two points more than peaks."""
    base = emc(F.lit(config.temperature_c), F.lit(config.rh))
    return clip(base + (1.0 - elev_norm) * 0.02 + noise, 0.01, 0.30)


def nearest_seed(cells: DataFrame, seeds: DataFrame, most: int = 1000) -> DataFrame:
    """cells with seed_id, fuel_idx and dist2 of the nearest seed (seed_id, sr, sc, fuel_idx); of equal distances the lowest seed_id.

    The seeds are one broadcast row, so each cell finds its seed in place, without a shuffle; more than `most` of them are an error."""
    all_ = seeds.agg(F.collect_list(F.struct("seed_id", "sr", "sc", "fuel_idx")).alias("__all"))
    all_ = all_.select(F.when(F.size("__all") <= most, F.col("__all")).otherwise(F.raise_error(F.lit(f"more than {most} seeds"))).alias("__all"))
    away = lambda x, at: (F.col(x) - at) * (F.col(x) - at)
    best = F.array_min(F.transform("__all", lambda s: F.struct((away("r", s["sr"]) + away("c", s["sc"])).alias("dist2"), s["seed_id"].alias("seed_id"), s["fuel_idx"].alias("fuel_idx"))))
    return cells.crossJoin(F.broadcast(all_)).select(*cells.columns, best.alias("__s")).select(*cells.columns, "__s.seed_id", "__s.fuel_idx", "__s.dist2")


def shifted(cells: DataFrame, col: str, keys: list[str] | None = None, prefix: str = "s") -> DataFrame:
    """cells with {prefix}0 .. {prefix}7: col at each neighbour's source (r - dr, c - dc), 0 off the grid.

    Windows by row, column and the two diagonals, all in one projection: four sorts for eight neighbours, and no self join."""
    keys = keys or []
    part = {(1, 0): ["c"], (0, 1): ["r"], (1, 1): [F.col("r") - F.col("c")], (1, -1): [F.col("r") + F.col("c")]}
    new = {}
    for d, (dr, dc) in enumerate(OFFSETS):
        line = (1, 0) if dc == 0 else (0, 1) if dr == 0 else (1, 1) if dr == dc else (1, -1)
        w = Window.partitionBy(*keys, *part[line]).orderBy("c" if dr == 0 else "r")
        before = dr > 0 or dr == 0 and dc > 0
        new[f"{prefix}{d}"] = (F.lag if before else F.lead)(col, 1, 0.0).over(w)
    return cells.withColumns(new)


def random_terrain(spark: SparkSession, config: Config = Config(), patches: int = 8, seed: int = 0) -> DataFrame:
    """r, c, elevation, fuel_idx, moisture: hills, patches of fuel around random seeds, weather-driven moisture. Deterministic by seed."""
    import random

    rng = random.Random(seed)
    seeds = spark.createDataFrame([(k, rng.random() * config.rows, rng.random() * config.cols, rng.randrange(6)) for k in range(patches)], "seed_id int, sr double, sc double, fuel_idx int")
    cells = grid(spark, config.rows, config.cols)
    cells = cells.withColumn("elevation", elevation(axis(F.col("c"), config.cols), axis(F.col("r"), config.rows)))
    cells = normalised(nearest_seed(cells, seeds))
    noise = F.pmod(F.xxhash64(F.lit(seed), "r", "c"), F.lit(1_000_000)) / 1e8 - 0.005
    return cells.select("r", "c", "elevation", "fuel_idx", moisture(F.coalesce("elev_norm", F.lit(0.0)), noise, config).alias("moisture"))
