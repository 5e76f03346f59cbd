"""The spread queries on the whole grid: one task a scenario and tiles agree with the recursion in SQL."""

import os

import duckdb
import pytest

from emberframe import catalog
from emberframe.operators import spread
from emberframe.plans import oracle, survey

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def sql_arrivals(sims, steps):
    c = duckdb.connect()
    for t in ("part", "nation"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return set(c.sql(f"{oracle.spread(sims, steps)} SELECT sim_id, r, c, ignite_step FROM arrival").fetchall())


@pytest.mark.parametrize("one_task", [spread.ONE_TASK, 0])
def test_arrivals_of_all_cells(spark, monkeypatch, one_task):
    monkeypatch.setattr(spread, "ONE_TASK", one_task)
    got = {tuple(x) for x in survey.arrival(spark, SF, survey.blind_params(spark), survey.STEPS).select("sim_id", "r", "c", "ignite_step").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/part.parquet").count()
    assert got == sql_arrivals("-2", survey.STEPS)


def test_scores_of_tiles(spark, monkeypatch):
    want = {tuple(x) for x in catalog.QUERIES["twin_recovery"](spark, SF).collect()}
    monkeypatch.setattr(spread, "ONE_TASK", 0)
    assert {tuple(x) for x in catalog.QUERIES["twin_recovery"](spark, SF).collect()} == want


def test_scores_on_reachable_cells_are_those_of_the_whole_grid(spark, monkeypatch):
    """A grid of more than ONE_TASK cells is scored in one task a scenario where fire can't come to so many, with the whole grid's scores."""
    grid, steps = SF.replace("0.001", "0.01"), 15
    whole = survey.ground(spark, grid).join(survey.arrival(spark, grid, survey.truth_params(spark), steps).selectExpr("r", "c", "ignite_step IS NOT NULL AS seen"), ["r", "c"])
    want = spread.overlaps(survey.ros(spark, grid, survey.params(spark, grid), whole), survey.size(spark, grid), steps)
    want = {x["sim_id"]: x["i"] / x["u"] for x in want.collect()}
    monkeypatch.setattr(survey, "STEPS", steps)
    monkeypatch.setattr(spread, "ONE_TASK", 1500)
    monkeypatch.setattr(spread, "arrivals_tiled", None)
    base = survey.observed(spark, grid)
    assert base.count() == (2 * (steps + 1) + 1) ** 2 < 1500 < survey.size(spark, grid)
    assert {tuple(x) for x in survey.scored(spark, grid, None, base).collect()} == set(want.items())
    assert len(set(want.values())) > 5


def test_scores_without_a_middle(spark, tmp_path):
    for name, kept in (("part", "p_partkey < 40 OR p_partkey >= 39960"), ("nation", "true")):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "part":
            rows = rows.unionByName(rows.selectExpr("p_partkey + 39800 AS p_partkey", *rows.columns[1:]))
        rows.where(kept).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {tuple(x) for x in catalog.QUERIES["twin_recovery"](spark, str(tmp_path)).collect()} == {(-1, 0.0), (-2, 0.0)}


def test_forward_run_reaches_the_end(spark):
    found, last = survey.forward(spark, SF)
    rows = found.select("sim_id", "r", "c", "ignite_step").collect()
    assert {tuple(x) for x in rows} == sql_arrivals("-2", None)
    active = {x["step"]: x["active"] for x in catalog.QUERIES["active_per_step"](spark, SF).collect()}
    assert max(active) == last and active[last] == 0 and active[last - 1] > 0
    assert survey.STEPS == 80 > survey.CONFIG.burn_steps
    assert {x["code"] for x in catalog.QUERIES["display_frame"](spark, SF).collect()} >= {7}
    assert {x["state"] for x in catalog.QUERIES["state_history"](spark, SF).collect()} == {0, 1, 2}
    told = {x["step"]: x["extinguished"] for x in catalog.QUERIES["playback_progress"](spark, SF).collect()}
    assert told == {s: False for s in range(0, last, survey.EVERY)} | {last: True}


def test_too_many_seeds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(survey, "SEEDS", 24)
    with pytest.raises(Exception, match="more than 24"):
        survey.voronoi_fuel_map(spark, SF).collect()
    monkeypatch.setattr(survey, "SEEDS", 25)
    assert survey.voronoi_fuel_map(spark, SF).count() == 200


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    shifts = plan(catalog.QUERIES["neighbor_shift"](spark, SF))
    assert shifts.count("Exchange hashpartitioning") == 4 and "Join" not in shifts.replace("BroadcastNestedLoopJoin", "")
    base = survey.observed(spark, SF)
    scores = plan(survey.scored(spark, SF, None, base))
    assert scores.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in scores and "SortMergeJoin" not in scores
