"""Scoring against an observed burn, calibration, ensembles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Of a forward difference.
STEP = 1e-8
BOUNDS = ((0.5, 3.0), (-45.0, 45.0), (-0.1, 0.1))


def burned(arrival: DataFrame, step: int) -> DataFrame:
    """arrival with burned: burning or ash after a step."""
    return arrival.withColumn("burned", F.coalesce(F.col("ignite_step") <= step, F.lit(False)))


def iou(burned_by_sim: DataFrame, truth: DataFrame) -> DataFrame:
    """sim_id, iou. truth: r, c, burned; a cell on one side only counts as unburned on the other. 0 where nothing burned.

    Sums only, so partial aggregation leaves one row a scenario and task; truth joins by cell."""
    t = truth.select("r", "c", F.col("burned").alias("t"))
    both = burned_by_sim.join(t, ["r", "c"], "left").groupBy("sim_id").agg(
        F.count_if(F.col("burned") & F.coalesce("t", F.lit(False))).alias("i"), F.count_if("burned").alias("b"))
    n = t.where("t").agg(F.count("*").alias("n"))
    union = F.col("b") + F.col("n") - F.col("i")
    return both.crossJoin(F.broadcast(n)).select("sim_id", F.when(union > 0, F.col("i") / union).otherwise(0.0).alias("iou"))


def top(scores: DataFrame, k: int = 50, key: str = "sim_id") -> DataFrame:
    """The k best, of equal scores the earliest evaluation first."""
    return scores.orderBy(F.desc("iou"), key).limit(k)


def confidence(burned_by_sim: DataFrame, sims: DataFrame) -> DataFrame:
    """r, c, probability: the share of the chosen scenarios (as many as there are) in which a cell burned."""
    n = F.broadcast(sims.agg(F.count("*").alias("n")))
    return burned_by_sim.join(F.broadcast(sims.select("sim_id")), "sim_id").groupBy("r", "c").agg(F.count_if("burned").alias("b")).crossJoin(n).select(
        "r", "c", (F.col("b") / F.col("n")).alias("probability"))


def start(rng: np.random.Generator, bounds: tuple, n: int) -> np.ndarray:
    """A Latin hypercube of n points."""
    low, high = np.array(bounds).T
    cells = np.stack([rng.permutation(n) for _ in bounds], 1)
    return low + (high - low) * (cells + rng.random((n, len(bounds)))) / n


def ratio(overlaps: DataFrame) -> DataFrame:
    """sim_id, iou of counts i and u; 0 where nothing burned."""
    return overlaps.select("sim_id", F.when(F.col("u") > 0, F.col("i") / F.col("u")).otherwise(0.0).alias("iou"))


def calibrate(spark: SparkSession, objective: Callable[[DataFrame], DataFrame], bounds: tuple = BOUNDS, generations: int = 15, popsize: int = 10,
              mutation: float = 0.7, crossover: float = 0.5, seed: int = 0, polish: int = 3) -> DataFrame:
    """Differential evolution (best/1/bin). objective scores params (sim_id, wind_mult, dir_offset, moisture_offset) as
    (sim_id, iou); a whole generation is one Spark job. Only popsize * len(bounds) scores a generation come to the driver.
    It ends when the losses (1 - iou) differ by a hundredth of their mean; then `polish` steps of descent at most start from the best.

    Returns the log of all evaluations: sim_id (their order), wind_mult, dir_offset, moisture_offset, iou, generation."""
    rng = np.random.default_rng(seed)
    low, high = np.array(bounds).T
    n = popsize * len(bounds)
    log: list[tuple] = []
    pop = start(rng, bounds, n)

    def score(x: np.ndarray, generation: int) -> np.ndarray:
        first = len(log)
        rows = [(first + k, *map(float, v)) for k, v in enumerate(x)]
        params = spark.createDataFrame(rows, "sim_id bigint, wind_mult double, dir_offset double, moisture_offset double")
        got = {r["sim_id"]: r["iou"] for r in objective(params).select("sim_id", "iou").collect()}
        log.extend((*r, got[r[0]], generation) for r in rows)
        return np.array([got[r[0]] for r in rows])

    fit = score(pop, 0)
    for g in range(1, generations + 1):
        best = pop[fit.argmax()]
        a, b = (np.array([rng.choice(np.delete(np.arange(n), k), 2, replace=False) for k in range(n)])).T
        trial = best + mutation * (pop[a] - pop[b])
        out = (trial < low) | (trial > high)
        trial[out] = (low + (high - low) * rng.random(trial.shape))[out]
        keep = rng.random(trial.shape) >= crossover
        keep[np.arange(n), rng.integers(0, len(bounds), n)] = False
        trial = np.where(keep, pop, trial)
        got = score(trial, g)
        better = got >= fit
        pop[better], fit[better] = trial[better], got[better]
        loss = 1 - fit
        if loss.std() <= 0.01 * abs(loss.mean()):
            break
    if polish:
        g, at, value = g + 1, pop[fit.argmax()].copy(), fit.max()
        for _ in range(polish):  # descent by forward differences, a line of steps scored at once
            slope = (score(np.clip(at + np.eye(len(low)) * STEP, low, high), g) - value) / STEP
            if not slope.any():  # the score counts cells: it's flat nearly everywhere
                break
            line = np.clip(at + slope * (0.5 ** np.arange(20))[:, None], low, high)
            got = score(line, g)
            if got.max() <= value:
                break
            at, value = line[got.argmax()], got.max()
    return spark.createDataFrame(log, "sim_id bigint, wind_mult double, dir_offset double, moisture_offset double, iou double, generation int")
