"""Scalar vectors, arrivals, scoring and calibration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.config import Config
from emberframe.functions.rothermel import fraction, fuel_terms, reaction
from emberframe.functions.weather import emc, wind_u, wind_v
from emberframe.operators import assimilation, display, landscape, spread
from emberframe.sources.fuels import OFFSETS, fuels


@pytest.mark.parametrize(("temp", "rh", "want"), [
    (38, 0, 0.01), (38, 5, 0.01147499), (38, 9.999, 0.02262484958), (38, 10, 0.02344648), (25, 40, 0.0749371),
    (25, 49.999, 0.09094619893), (25, 50, 0.0946565), (20, 90, 0.2050719), (20, 100, 0.260107)])
def test_emc(spark, temp, rh, want):
    got = spark.range(1).select(emc(F.lit(float(temp)), F.lit(float(rh)))).first()[0]
    assert got == pytest.approx(want, rel=1e-7)


@pytest.mark.parametrize(("bearing", "u", "v"), [(0, 0, 1), (90, 1, 0), (180, 0, -1), (270, -1, 0), (45, 0.70710678, 0.70710678), (405, 0.70710678, 0.70710678)])
def test_wind(spark, bearing, u, v):
    got = spark.range(1).select(wind_u(F.lit(1.0), F.lit(float(bearing))), wind_v(F.lit(1.0), F.lit(float(bearing)))).first()
    assert tuple(got) == pytest.approx((u, v), abs=1e-8)


def test_spread_equations(spark):
    d = fuel_terms(fuels(spark)).withColumns(reaction(F.lit(0.02344648)))
    flat = F.lit(0.0)
    half = F.lit(0.5**0.5)
    got = d.select("fuel_idx", "rel_beta", "eta_m", fraction(1, 0, flat, flat, flat, flat, 5.0, 0.1).alias("card"), fraction(1, 1, flat, flat, half, half, 5.0, 0.1).alias("diag")).orderBy("fuel_idx").collect()
    want = [(0.7447246, 0.799137273, 0.0682319744, 0.291158573), (0.565767043, 0.706565748, 0.050975393, 0.188920736), (0.47555408, 0.799137273, 0.119949719, 0.550665013),
            (0.525495686, 0.662771039, 0.0376387684, 0.128259597), (2.17122152, 0.827111195, 0.0149265149, 0.0458249532), (0.879769354, 0.760925701, 0.0258978727, 0.106566502)]
    for row, w in zip(got, want, strict=True):
        assert tuple(row)[1:] == pytest.approx(w, rel=1e-5)


def test_shift_fills_with_zero(spark):
    cells = landscape.grid(spark, 3, 4).withColumn("e", (F.col("r") * 10 + F.col("c") + 1).cast("double"))
    a = np.zeros((3, 4))
    rows = landscape.shifted(cells, "e").collect()
    for x in rows:
        a[x["r"], x["c"]] = x["e"]
    for x in rows:
        for d, (dr, dc) in enumerate(OFFSETS):
            r, c = x["r"] - dr, x["c"] - dc
            assert x[f"s{d}"] == (a[r, c] if 0 <= r < 3 and 0 <= c < 4 else 0)


def slow_burn(p, k, steps, b):
    """Cell by cell, with the step order written out."""
    rows, cols = k.shape
    state, timer, heat, k = (k < 0).astype(int), np.where(k < 0, b, 0), np.zeros(k.shape, np.float32), k.copy()
    for t in range(steps):
        timer[state == 1] -= 1
        state[(state == 1) & (timer <= 0)] = 2
        for r in range(rows):
            for c in range(cols):
                for d, (dr, dc) in enumerate(OFFSETS):
                    if 0 <= r - dr < rows and 0 <= c - dc < cols and state[r, c] == 0 and state[r - dr, c - dc] == 1:
                        heat[r, c] += p[d, r, c]
        new = (state == 0) & (heat >= 1)
        state[new], timer[new], k[new] = 1, b, t
    return k, state


def test_heat_adds_up_in_float():
    """80 times 0.0125 is below 1 in FLOAT: a cell with one burning neighbour needs 81 steps."""
    k = np.array([[-1, 300]])
    p = np.full((8, 1, 2), 0.0125, np.float32)
    assert spread.burn(p, k, 200, 150)[0, 1] == 80
    assert slow_burn(p, k, 200, 150)[0][0, 1] == 80


def some_ros(spark, rows=14, cols=17):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 0.12, (8, rows, cols)).astype(np.float32)
    data = [(s, r, c, abs(r - rows // 2) <= 1 and abs(c - cols // 2) <= 1, *(float(p[d, r, c]) / (s + 1) for d in range(8))) for s in range(2) for r in range(rows) for c in range(cols)]
    return p, spark.createDataFrame(data, "sim_id bigint, r int, c int, seed boolean, " + ", ".join(f"p{d} float" for d in range(8)))


def test_arrivals_agree(spark):
    p, ros = some_ros(spark)
    steps = 50
    k0 = np.full(p.shape[1:], steps + 1)
    k0[6:9, 7:10] = -1
    want, state = slow_burn(p, k0, steps, 20)
    got = {(x["r"], x["c"]): x["ignite_step"] for x in spread.arrivals(ros, steps, 20).where("sim_id = 0").collect()}
    assert got == {(r, c): (int(want[r, c]) if want[r, c] <= steps else None) for r in range(14) for c in range(17)}
    tiled = {(x["sim_id"], x["r"], x["c"]): x["ignite_step"] for x in spread.arrivals_tiled(ros, steps, 20, tile=5).collect()}
    assert tiled == {(x["sim_id"], x["r"], x["c"]): x["ignite_step"] for x in spread.arrivals(ros, steps, 20).collect()}
    shown = spread.frames(spread.arrivals(ros, steps, 20).where("sim_id = 0"), [steps - 1], 20).collect()
    assert all(x["state"] == state[x["r"], x["c"]] for x in shown)


def test_symmetric_when_calm_and_flat(spark):
    cells = landscape.grid(spark, 9, 9).select("r", "c", F.lit(10.0).alias("elevation"), F.lit(0).alias("fuel_idx"), F.lit(0.05).alias("moisture"), F.lit(0.0).alias("wind_u"), F.lit(0.0).alias("wind_v"))
    # Cells beyond the edge count as height 0, which never matters: they never burn.
    ros = spread.directional(cells, fuels(spark)).withColumns({"sim_id": F.lit(1).cast("bigint"), "seed": spread.seeded(F.col("r"), F.col("c"), 9, 9)})
    k = np.zeros((9, 9))
    for x in spread.arrivals(ros, 200).collect():
        k[x["r"], x["c"]] = -2 if x["ignite_step"] is None else x["ignite_step"]
    assert (k == k[::-1]).all() and (k == k[:, ::-1]).all() and k.max() > 0


def test_wet_fuel_only_seeds_burn(spark):
    cells = landscape.grid(spark, 7, 7).select("r", "c", F.lit(10.0).alias("elevation"), F.lit(3).alias("fuel_idx"), F.lit(0.3).alias("moisture"), F.lit(0.0).alias("wind_u"), F.lit(0.0).alias("wind_v"))
    ros = spread.directional(cells, fuels(spark)).withColumns({"sim_id": F.lit(1).cast("bigint"), "seed": spread.seeded(F.col("r"), F.col("c"), 7, 7)})
    assert spread.arrivals(ros, 100).where("ignite_step IS NOT NULL").count() == 9


def test_iou_and_top(spark):
    cell = "sim_id bigint, r int, c int, burned boolean"
    b = spark.createDataFrame([(1, 0, 0, True), (1, 0, 1, True), (1, 0, 2, False), (2, 0, 0, False), (2, 0, 1, False), (2, 0, 2, False), (3, 0, 0, False), (3, 0, 1, True), (3, 0, 2, True)], cell)
    t = spark.createDataFrame([(0, 0, False), (0, 1, True), (0, 2, True)], "r int, c int, burned boolean")
    got = {x["sim_id"]: x["iou"] for x in assimilation.iou(b, t).collect()}
    assert got == {1: pytest.approx(1 / 3), 2: 0.0, 3: 1.0}
    none = t.withColumn("burned", F.lit(False))
    assert {x["iou"] for x in assimilation.iou(b.where("sim_id = 2"), none).collect()} == {0.0}
    scores = spark.createDataFrame([(5, 0.5), (2, 0.5), (9, 0.7)], "sim_id bigint, iou double")
    assert [x["sim_id"] for x in assimilation.top(scores, 2).collect()] == [9, 2]
    few = assimilation.confidence(b, assimilation.top(scores.where("sim_id = 2").union(spark.createDataFrame([(1, 0.9)], scores.schema)), 50))
    assert {(x["c"], x["probability"]) for x in few.collect()} == {(0, 0.5), (1, 0.5), (2, 0.0)}


def test_calibration_finds_optimum(spark):
    def objective(p):
        return p.select("sim_id", (1.0 / (1.0 + F.abs(F.col("wind_mult") - 2.0) + F.abs(F.col("dir_offset") - 20.0) / 45.0 + F.abs(F.col("moisture_offset") + 0.03) * 5)).alias("iou"))

    log = assimilation.calibrate(spark, objective, generations=12, popsize=4, seed=2)
    best = log.orderBy(F.desc("iou")).first()
    first = log.where("generation = 0").agg(F.max("iou")).first()[0]
    assert best["iou"] >= first and best["iou"] > 0.7
    assert log.where("wind_mult < 0.5 OR wind_mult > 3 OR abs(dir_offset) > 45 OR abs(moisture_offset) > 0.1").count() == 0


def test_calibration_ends_on_equal_losses_and_polishes(spark):
    """Scores close to 1 have losses that differ much beside their mean; equal scores end the search at once."""
    flat = assimilation.calibrate(spark, lambda p: p.select("sim_id", F.lit(0.5).alias("iou")), generations=9, popsize=2)
    assert flat.agg(F.max("generation")).first()[0] == 2  # one generation, and a look around its best
    near = assimilation.calibrate(spark, lambda p: p.select("sim_id", (1 - F.abs("moisture_offset") / 10).alias("iou")), generations=3, popsize=2, polish=0)
    assert near.agg(F.max("generation")).first()[0] == 3
    steep = assimilation.calibrate(spark, lambda p: p.select("sim_id", (1 - F.abs(F.col("wind_mult") - 2.0) / 4).alias("iou")), generations=1, popsize=2, polish=3)
    best = steep.groupBy("generation").agg(F.max("iou").alias("iou")).orderBy("generation").collect()
    assert best[-1]["generation"] == 2 and best[-1]["iou"] >= max(b["iou"] for b in best[:-1])


def test_terrain_is_deterministic(spark):
    small = Config(rows=12, cols=9)
    a, b = (sorted(map(tuple, landscape.random_terrain(spark, small, seed=4).collect())) for _ in range(2))
    assert a == b and len(a) == 108 and all(0.01 <= x[4] <= 0.30 for x in a)


def test_display(spark):
    assert display.interval_ms(30) == 33 and display.interval_ms(5000) == 1
    a = spark.createDataFrame([(0, 0, -1, 2), (0, 1, None, 3), (0, 2, 70, 4)], "r int, c int, ignite_step int, fuel_idx int")
    assert [x["code"] for x in display.frame(a, 60).orderBy("c").collect()] == [7, 3, 4]
    with pytest.raises(ValueError):
        display.frame(a.limit(0), 1)
    with pytest.raises(ValueError):
        Config(rows=2)


def test_live_frames(spark, tmp_path):
    from emberframe.streaming import live

    steps = spark.createDataFrame([(k,) for k in range(5)], "step int").withColumn("ts", F.lit("2020-01-01").cast("timestamp"))
    steps.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(steps.schema).parquet(str(tmp_path / "s"))
    a = spark.createDataFrame([(0, 0, -1, 2), (0, 1, 3, 3)], "r int, c int, ignite_step int, fuel_idx int")
    q = live.live_frames(stream, a, last=200, burn_steps=4).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(x["step"], x["c"], x["code"]) for x in spark.sql("SELECT * FROM live").collect()} == {(0, 0, 6), (3, 0, 7), (3, 1, 6)}


def test_live_moisture_and_ticks(spark, tmp_path):
    from emberframe.streaming import live

    rows = spark.createDataFrame([("2020-01-01 00:10:00", 25.0, 40.0), ("2020-01-01 00:50:00", 25.0, 50.0), ("2020-01-01 05:00:00", 38.0, 0.0), ("2020-01-01 09:00:00", 38.0, 0.0)], "ts string, temp_c double, rh double")
    rows.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema("ts timestamp, temp_c double, rh double").parquet(str(tmp_path / "w"))
    q = live.live_moisture(stream).writeStream.format("memory").queryName("moist").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = [(x["n"], x["moisture"]) for x in spark.sql("SELECT * FROM moist ORDER BY window").collect()]
    assert got == [(2, pytest.approx((0.0749371 + 0.0946565) / 2, rel=1e-6)), (1, 0.01), (1, 0.01)]
    assert live.ticks(spark).isStreaming and live.ticks(spark).columns == ["ts", "step"]
