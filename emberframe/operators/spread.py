"""Rates of spread, and when every cell ignites.

A cell's whole history is one number, the step k at which it ignites (-1: before the first step, null: never): it
burns from k to k + B - 1, is ash from k + B, and heats its neighbours in steps k + 1 .. k + B - 1. So arrivals are stored and
states are projected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship
from ..config import Config
from ..functions import rothermel
from ..functions.weather import clip, wind_u, wind_v
from ..sources.fuels import OFFSETS
from .landscape import shifted

P = [f"p{d}" for d in range(8)]
#: Cells of a grid that one task solves, at most: its fractions take 32 bytes a cell, the rows that bring them some 100.
ONE_TASK = 1_000_000


def scenarios(cells: DataFrame, params: DataFrame, config: Config = Config()) -> DataFrame:
    """cells for every row of params (sim_id, wind_mult, dir_offset, moisture_offset), with the scenario's moisture and wind.

    params is broadcast: a search's scenarios are planned on the driver, hundreds of them."""
    speed, bearing = config.wind_speed * F.col("wind_mult"), F.pmod(config.wind_dir + F.col("dir_offset"), F.lit(360.0))
    both = cells.crossJoin(F.broadcast(params.select("sim_id", "moisture_offset", wind_u(speed, bearing).alias("wind_u"), wind_v(speed, bearing).alias("wind_v"))))
    return both.withColumn("moisture", clip(F.col("moisture") + F.col("moisture_offset"), 0.01, 0.30)).drop("moisture_offset")


def directional(cells: DataFrame, fuels: DataFrame, config: Config = Config()) -> DataFrame:
    """cells (r, c, elevation, fuel_idx, moisture, wind_u, wind_v) with p0 .. p7.

    Shifts come before scenarios: pass cells that have s0 .. s7 already to share them among scenarios."""
    if "s0" not in cells.columns:
        cells = shifted(cells, "elevation")
    known = cells.join(F.broadcast(rothermel.fuel_terms(fuels)), "fuel_idx", "left").na.fill(rothermel.NO_FUEL)
    known = known.withColumns(rothermel.reaction(F.col("moisture")))
    return known.withColumns({f"p{d}": rothermel.fraction(dr, dc, F.col("elevation"), F.col(f"s{d}"), F.col("wind_u"), F.col("wind_v"), config.cell_size_m, config.dt)
                              for d, (dr, dc) in enumerate(OFFSETS)})


def burn(p: np.ndarray, k: np.ndarray, steps: int, burn_steps: int, fixed: np.ndarray | None = None) -> np.ndarray:
    """Arrival steps on one grid. p: (8, R, C); k: start, -1 for seeds, steps + 1 for none; fixed: cells that keep their k.

    A cell heats in steps k + 1 .. k + burn_steps - 1; heat adds up in FLOAT in order of direction and never decays."""
    k = k.copy()
    p = p.astype(np.float32, copy=False)
    heat = np.zeros(k.shape, np.float32)
    free = (k > steps) if fixed is None else (k > steps) & ~fixed
    pad = np.zeros((k.shape[0] + 2, k.shape[1] + 2), bool)
    last = 0 if fixed is None else int(k[fixed & (k <= steps)].max(initial=0))
    for t in range(steps):
        pad[1:-1, 1:-1] = (k < t) & (t < k + burn_steps)
        if not pad.any():
            if t > last:
                break
            continue
        for d, (dr, dc) in enumerate(OFFSETS):
            heat += p[d] * pad[1 - dr:pad.shape[0] - 1 - dr, 1 - dc:pad.shape[1] - 1 - dc]
        new = free & (heat >= 1.0)
        k[new] = t
        free &= ~new
    return k


def seeded(r: Column, c: Column, rows: int, cols: int) -> Column:
    """The 3 x 3 block in the middle."""
    return (F.abs(r - rows // 2) <= 1) & (F.abs(c - cols // 2) <= 1)


def reachable(r: Column, c: Column, rows: Column | int, cols: int, steps: int) -> Column:
    """Whether fire from the block in the middle can have come to a cell within so many steps, in any scenario: heat goes
    one cell a step, so whatever lies further away is unburned, and heats nothing."""
    rows = F.lit(rows) if isinstance(rows, int) else rows
    return (F.abs(r - F.floor(rows / 2)) <= 1 + steps) & (F.abs(c - cols // 2) <= 1 + steps)


def _solved(rows: pd.DataFrame, steps: int, burn_steps: int) -> np.ndarray:
    """Arrival of each row of one scenario."""
    r, c = (rows["r"] - rows["r"].min()).to_numpy(), (rows["c"] - rows["c"].min()).to_numpy()
    p = np.zeros((8, r.max() + 1, c.max() + 1), np.float32)
    k = np.full(p.shape[1:], steps + 1)
    for d, name in enumerate(P):
        p[d, r, c] = rows[name]
    k[r, c] = np.where(rows["seed"], -1, steps + 1)
    return burn(p, k, steps, burn_steps)[r, c]


def _one_sim(steps: int, burn_steps: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = _solved(rows, steps, burn_steps)
        out = rows[["sim_id", "r", "c"]].copy()
        out["ignite_step"] = pd.array(np.where(found > steps, 0, found), "Int32")
        out.loc[found > steps, "ignite_step"] = pd.NA
        return out

    return run


def _one_score(steps: int, burn_steps: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        burned, seen = _solved(rows, steps, burn_steps) <= steps, rows["seen"].fillna(False).to_numpy(bool)
        return pd.DataFrame({"sim_id": rows["sim_id"].iloc[:1], "i": [int((burned & seen).sum())], "u": [int((burned | seen).sum())]})

    return run


def overlaps(ros: DataFrame, cells: int, steps: int, burn_steps: int = 60, stage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """ros with seen (whether a cell has been observed to burn): sim_id, i and u, cells of the intersection and union with it after `steps`.

    A scenario on a grid of at most ONE_TASK cells is scored where it's simulated, and only its two counts leave the task."""
    if cells <= ONE_TASK:
        ship(ros.sparkSession)
        return ros.select("sim_id", "r", "c", "seed", "seen", *P).groupBy("sim_id").applyInPandas(_one_score(steps, burn_steps), "sim_id bigint, i bigint, u bigint")
    seen = ros.select("sim_id", "r", "c", F.coalesce("seen", F.lit(False)).alias("seen"))
    burned = F.coalesce(F.col("ignite_step") <= steps, F.lit(False))
    return arrivals_tiled(ros, steps, burn_steps, stage=stage).join(seen, ["sim_id", "r", "c"]).groupBy("sim_id").agg(
        F.count_if(burned & F.col("seen")).alias("i"), F.count_if(burned | F.col("seen")).alias("u"))


def simulate(ros: DataFrame, cells: int, steps: int, burn_steps: int = 60, stage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Arrivals (sim_id, r, c, ignite_step) on a grid of so many cells: one task a scenario, or tiles beyond ONE_TASK cells."""
    return arrivals(ros, steps, burn_steps) if cells <= ONE_TASK else arrivals_tiled(ros, steps, burn_steps, stage=stage)


def arrivals(ros: DataFrame, steps: int, burn_steps: int = 60) -> DataFrame:
    """ros: sim_id, r, c, seed, p0 .. p7. Returns sim_id, r, c, ignite_step. One task a scenario: grids that fit a worker."""
    ship(ros.sparkSession)
    return ros.select("sim_id", "r", "c", "seed", *P).groupBy("sim_id").applyInPandas(_one_sim(steps, burn_steps), "sim_id bigint, r int, c int, ignite_step int")


def arrivals_tiled(ros: DataFrame, steps: int, burn_steps: int = 60, tile: int = 256, rounds: int = 1000, stage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The same for grids of any size: tiles with a rim of their neighbours' cells, each solved on its own, until no arrival
    changes. Arrivals only ever fall from never, so rounds are about as many as tiles that the fire crosses in a row.

    stage: writes and rereads a round's table; checkpoint() by default."""
    ship(ros.sparkSession)
    stage = stage or (lambda df: df.checkpoint())
    none = steps + 1
    now = stage(ros.select("sim_id", "r", "c", *P, F.when(F.col("seed"), -1).otherwise(none).alias("k")))
    schema = now.schema
    tr, tc = F.floor(F.col("r") / tile).cast("int"), F.floor(F.col("c") / tile).cast("int")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["rim"].all():  # a tile beyond the grid's edge has nothing to solve
            return rows.iloc[:0][["sim_id", "r", "c", *P, "k"]]
        r0, c0 = rows["r"].min(), rows["c"].min()
        r, c = (rows["r"] - r0).to_numpy(), (rows["c"] - c0).to_numpy()
        shape = (r.max() + 1, c.max() + 1)
        p, k, fixed = np.zeros((8, *shape), np.float32), np.full(shape, none), np.ones(shape, bool)
        for d, name in enumerate(P):
            p[d, r, c] = rows[name]
        rim = rows["rim"].to_numpy()
        old = rows["k"].to_numpy()
        k[r, c] = np.where(rim | (old < 0), old, none)  # solved anew from the seeds and the rim
        fixed[r, c] = rim
        found = burn(p, k, steps, burn_steps, fixed)[r, c]
        out = rows.assign(k=np.minimum(found, old).astype("int32"))
        return out[~rim][["sim_id", "r", "c", *P, "k"]]

    for _ in range(rounds):
        around = F.array_distinct(F.array(*[F.struct(F.floor((F.col("r") + i) / tile).cast("int").alias("i"), F.floor((F.col("c") + j) / tile).cast("int").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        dealt = now.withColumn("t", F.explode(around)).withColumn("rim", (F.col("t.i") != tr) | (F.col("t.j") != tc))
        dealt = dealt.select("sim_id", F.col("t.i").alias("ti"), F.col("t.j").alias("tj"), "r", "c", *P, "k", "rim").where("NOT rim OR k <= " + str(steps))
        new = stage(dealt.groupBy("sim_id", "ti", "tj").applyInPandas(solve, schema))
        if new.agg(F.sum("k")).first()[0] == now.agg(F.sum("k")).first()[0]:
            break
        now = new
    else:
        raise RuntimeError(f"arrivals didn't settle in {rounds} rounds")
    return now.select("sim_id", "r", "c", F.when(F.col("k") <= steps, F.col("k")).cast("int").alias("ignite_step"))


def state(k: Column, step: Column | int, burn_steps: int = 60) -> Column:
    """0 unburned, 1 burning, 2 ash after a step."""
    step = F.lit(step) if isinstance(step, int) else step
    return F.when(k.isNull() | (k > step), 0).when(step < k + burn_steps, 1).otherwise(2).cast("tinyint")


def frames(arrival: DataFrame, steps: list[int] | range, burn_steps: int = 60) -> DataFrame:
    """arrival at each of the steps, with its state: the history as a projection, never stored."""
    every = F.sequence(F.lit(steps[0]), F.lit(steps[-1])) if isinstance(steps, range) and steps.step == 1 and len(steps) else F.array(*[F.lit(s) for s in steps])
    return arrival.withColumn("step", F.explode(every)).withColumn("state", state(F.col("ignite_step"), F.col("step"), burn_steps))


def active_per_step(arrival: DataFrame, last: int, burn_steps: int = 60) -> DataFrame:
    """step, active: a cell counts in from its ignition and out after its burn; running sums over steps, not over cells."""
    k = F.greatest(F.col("ignite_step"), F.lit(0))
    lit = arrival.where(f"ignite_step <= {last}")
    events = lit.select(F.explode(F.array(F.struct(k.alias("step"), F.lit(1).alias("n")), F.struct((F.col("ignite_step") + burn_steps).alias("step"), F.lit(-1).alias("n")))).alias("e"))
    sums = events.select("e.*").groupBy("step").agg(F.sum("n").alias("n"))
    every = arrival.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("step"))
    return every.join(F.broadcast(sums.where(f"step <= {last}")), "step", "left").select(
        "step", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)).alias("active"))
