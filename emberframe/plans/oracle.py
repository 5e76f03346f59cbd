"""The catalogue's queries in SQL (DuckDB), written apart from the engine: the correctness gate."""

from __future__ import annotations

import numpy as np

from ..operators.assimilation import BOUNDS, start
from ..sources.fuels import COLOURS, FUELS, OFFSETS, STATE_COLOURS

STEPS, TOP, COLS, B, LONGEST, EVERY = 80, 10, 40, 60, 5000, 50


def values(rows: list[tuple]) -> str:
    lit = lambda x: f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


FUEL = f"""fuel AS (SELECT * FROM (VALUES {values(FUELS)}) AS v(fuel_idx, fuel_name, heat_content, surface_ratio, fuel_load, fuel_depth, moisture_ext, bulk_density))"""
OFFSET = f"offs AS (SELECT * FROM (VALUES {values([(d, *o) for d, o in enumerate(OFFSETS)])}) AS v(d, dr, dc))"

LAND = f"""
cells AS (SELECT CAST(p_partkey // {COLS} AS INT) AS r, CAST(p_partkey % {COLS} AS INT) AS c, ((p_partkey * 7919) % 1000) / 100000.0::DOUBLE - 0.005::DOUBLE AS noise,
          CAST(p_size % 6 AS INT) AS fuel_idx, (SELECT max(p_partkey) // {COLS} + 1 FROM part) AS nr FROM part),
axes AS (SELECT *, 10.0::DOUBLE * c / {COLS - 1} AS x, CASE WHEN nr > 1 THEN 10.0::DOUBLE * r / (nr - 1) ELSE 0 END AS y FROM cells),
terrain AS (SELECT *, sin(x) * cos(y) * 30.0::DOUBLE + sin(x / 2) * 20.0::DOUBLE + 50.0::DOUBLE AS elevation FROM axes),
normed AS (SELECT *, (elevation - (SELECT min(elevation) FROM terrain)) / (SELECT max(elevation) - min(elevation) FROM terrain) AS elev_norm FROM terrain),
weather AS (SELECT least(greatest((2.22749::DOUBLE + 0.160107::DOUBLE * 10 - 0.01478::DOUBLE * (38.0::DOUBLE * 9 / 5 + 32)) / 100, 0.01), 0.30) AS base),
land AS (SELECT r, c, nr, elevation, elev_norm, fuel_idx, least(greatest((SELECT base FROM weather) + (1 - elev_norm) * 0.02::DOUBLE + noise, 0.01::DOUBLE), 0.30::DOUBLE) AS moisture FROM normed)"""

NATIONS = """SELECT CAST(n_nationkey AS BIGINT) AS sim_id, 0.5::DOUBLE + 2.5::DOUBLE * n_nationkey / 24 AS wind_mult, -45::DOUBLE + 90::DOUBLE * ((n_nationkey * 7) % 25) / 24 AS dir_offset,
         -0.1::DOUBLE + 0.2::DOUBLE * ((n_nationkey * 11) % 25) / 24 AS moisture_offset FROM nation"""
SCENARIO = f"""
scen AS ({NATIONS}
         UNION ALL SELECT -1, 2.0::DOUBLE, 20.0::DOUBLE, -0.03::DOUBLE UNION ALL SELECT -2, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE),
winds AS (SELECT *, 1.0::DOUBLE * wind_mult AS wind_speed, ((45 + dir_offset) % 360 + 360) % 360 AS wind_dir FROM scen),
wind AS (SELECT *, wind_speed * cos(radians(((90 - wind_dir) % 360 + 360) % 360)) AS u, wind_speed * sin(radians(((90 - wind_dir) % 360 + 360) % 360)) AS v FROM winds)"""

#: Per fuel and moisture; over `base` (sim_id, r, c, elevation, moisture, fuel_idx, u, v).
PHYSICS = """
terms AS (SELECT b.*, f.fuel_load AS w0, f.bulk_density / 32.0::DOUBLE AS beta, f.bulk_density / 32.0::DOUBLE / (3.348::DOUBLE * pow(f.surface_ratio, -0.8189::DOUBLE)) AS rel_beta,
          f.surface_ratio AS s, f.heat_content AS h, f.bulk_density AS rho, least(greatest(b.moisture / f.moisture_ext, 0), 1) AS rm FROM base b JOIN fuel f USING (fuel_idx)),
react AS (SELECT *, 1 - 2.59::DOUBLE * rm + 5.11::DOUBLE * rm * rm - 3.52::DOUBLE * rm * rm * rm AS eta_m, 1 / greatest(4.774::DOUBLE * pow(s, 0.1::DOUBLE) - 7.27::DOUBLE, 1e-6) AS a FROM terms),
heat AS (SELECT *, pow(s, 1.5::DOUBLE) / (495 + 0.0594::DOUBLE * pow(s, 1.5::DOUBLE)) * pow(rel_beta, a) * exp(a * (1 - rel_beta)) * w0 * (1 - 0.0555::DOUBLE) * h * eta_m * (0.174::DOUBLE * pow(0.01::DOUBLE, -0.19::DOUBLE)) AS ir,
         exp((0.792::DOUBLE + 0.681::DOUBLE * sqrt(s)) * (beta + 0.1::DOUBLE)) / (192 + 0.2595::DOUBLE * s) AS xi, rho * exp(-138.0::DOUBLE / s) * (250 + 1116.0::DOUBLE * moisture) AS denom FROM react)"""


def edges(dt: float, inner: bool) -> str:
    """p of every cell and direction; inner: only from cells of the grid, with their place."""
    return f"""
edge AS (SELECT t.sim_id, t.r, t.c, o.d, t.r - o.dr AS sr, t.c - o.dc AS sc,
         CAST(CASE WHEN t.denom > 0 AND t.ir > 0 AND t.w0 > 0 THEN
           t.ir * t.xi * (1 + 7.47::DOUBLE * exp(-0.133::DOUBLE * pow(t.s, 0.55::DOUBLE)) * pow(greatest((t.u * o.dc + t.v * o.dr) / sqrt(o.dr * o.dr + o.dc * o.dc), 0) * 196.8504::DOUBLE, 0.0252::DOUBLE * pow(t.s, 0.54::DOUBLE))
                * pow(greatest(t.rel_beta, 1e-9), -0.715::DOUBLE * exp(-3.59e-4::DOUBLE * t.s))
             + 5.275::DOUBLE * pow(greatest(t.beta, 1e-9), -0.3::DOUBLE) * pow(greatest((t.elevation - coalesce(n.elevation, 0)) / (5.0::DOUBLE * sqrt(o.dr * o.dr + o.dc * o.dc)), 0), 2))
           / t.denom * 0.3048::DOUBLE * {dt}::DOUBLE / (5.0::DOUBLE * sqrt(o.dr * o.dr + o.dc * o.dc)) ELSE 0 END AS FLOAT) AS p
         FROM heat t CROSS JOIN offs o {"" if inner else "LEFT "}JOIN heat n ON n.sim_id = t.sim_id AND n.r = t.r - o.dr AND n.c = t.c - o.dc)"""


def spread(sims: str, steps: int | None = STEPS, scenario: str = SCENARIO) -> str:
    """arrival: sim_id, r, c, k by recursion over steps on the whole grid; steps: how many, or None for as long as anything burns (LONGEST at most).

    Heat adds up in FLOAT, direction by direction."""
    heat = " + ".join(f"coalesce(max(CASE WHEN e.d = {d} AND s.lit THEN e.p END), 0::FLOAT)" for d in range(8))
    go = f"s.t < {steps}" if steps else f"s.t < least({LONGEST}, s.newest + {B})"
    return f"""WITH RECURSIVE {FUEL}, {OFFSET}, {LAND}, {scenario},
base AS (SELECT w.sim_id, l.r, l.c, l.elevation, l.fuel_idx, w.u, w.v, least(greatest(l.moisture + w.moisture_offset, 0.01::DOUBLE), 0.30::DOUBLE) AS moisture
         FROM land l CROSS JOIN wind w WHERE w.sim_id IN ({sims})),
{PHYSICS}, {edges(0.1, True)},
step_edge AS MATERIALIZED (SELECT sim_id, r, c, d, sr, sc, p FROM edge UNION ALL SELECT sim_id, r, c, -1, r, c, 0::FLOAT FROM base),
mid AS (SELECT max(nr) // 2 AS r FROM land),
run AS (SELECT 0 AS t, sim_id, r, c, CASE WHEN abs(r - (SELECT r FROM mid)) <= 1 AND abs(c - {COLS // 2}) <= 1 THEN -1 END AS k, 0::FLOAT AS heat FROM base
        UNION ALL
        SELECT t + 1, sim_id, r, c, CASE WHEN k IS NOT NULL THEN k WHEN heat >= 1 THEN t END, heat FROM (
            SELECT s.t, e.sim_id, e.r, e.c, max(CASE WHEN e.d = -1 THEN s.k END) AS k, max(CASE WHEN e.d = -1 THEN s.heat END) + {heat} AS heat
            FROM (SELECT *, coalesce(k < t AND t < k + {B}, false) AS lit, max(k) OVER () AS newest FROM run) s JOIN step_edge e ON s.sim_id = e.sim_id AND s.r = e.sr AND s.c = e.sc
            WHERE {go} GROUP BY s.t, e.sim_id, e.r, e.c)),
arrival AS (SELECT sim_id, r, c, k AS ignite_step, k IS NOT NULL AS burned FROM run WHERE t = (SELECT max(t) FROM run))"""


ALL, TRUTH, BLIND = "SELECT sim_id FROM scen", "-1", "-2"
SCORES = """
scores AS (SELECT a.sim_id, CASE WHEN count_if(a.burned OR t.burned) > 0 THEN count_if(a.burned AND t.burned) / count_if(a.burned OR t.burned) ELSE 0 END AS iou
           FROM arrival a JOIN arrival t ON t.sim_id = -1 AND t.r = a.r AND t.c = a.c WHERE a.sim_id >= 0 GROUP BY a.sim_id),
best AS (SELECT row_number() OVER (ORDER BY iou DESC, sim_id) AS rank, * FROM scores)"""
CONFIDENCE = f"""{spread(ALL)}, {SCORES},
conf AS (SELECT r, c, count_if(burned) / (SELECT count(*) FROM best WHERE rank <= {TOP}) AS probability FROM arrival WHERE sim_id IN (SELECT sim_id FROM best WHERE rank <= {TOP}) GROUP BY r, c)"""
#: The forward run, and every step of it: a run ends behind step 10 when nothing burns.
FORWARD = f"""{spread(BLIND, None)}, steps AS (SELECT CAST(unnest(range(least({LONGEST}, greatest(max(ignite_step) + {B}, 11) + 1))) AS INT) AS step FROM arrival)"""
ACTIVE = f"""{FORWARD}, act AS (SELECT s.step, count_if(a.ignite_step <= s.step AND s.step < a.ignite_step + {B}) AS active FROM steps s CROSS JOIN arrival a GROUP BY s.step)"""
STATE = f"CASE WHEN ignite_step IS NULL OR ignite_step > step THEN 0 WHEN step < ignite_step + {B} THEN 1 ELSE 2 END"


def _search() -> tuple[str, str]:
    """Scenarios and scores of the search's first generation."""
    rows = [(k, *map(float, v)) for k, v in enumerate(start(np.random.default_rng(1), BOUNDS, 10 * len(BOUNDS)))]
    own = SCENARIO.replace(NATIONS, f"SELECT * FROM (VALUES {values(rows)}) AS v(sim_id, wind_mult, dir_offset, moisture_offset)")
    return spread(ALL, STEPS, own), SCORES


def six(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0::DOUBLE AS {n}" for n in names)


def _compass() -> str:
    circle = "SELECT sim_id, '{0}' AS part, CAST(i AS INT) AS seq, 80 + {2} * cos(2 * pi() * (i % {1}) / {1}) AS x, 80 + {2} * sin(2 * pi() * (i % {1}) / {1}) AS y, '' AS label FROM w CROSS JOIN range({3}) t(i)"
    ways = [("N", "pi() / 2"), ("S", "-pi() / 2"), ("E", "0.0"), ("W", "pi()")]
    at = lambda r, g: f"80 + {r} * cos({g}), 80 + {r} * sin({g})"
    rows = [circle.format("circle", 64, 58, 65), circle.format("dot", 16, 4, 16)]
    for k, (name, g) in enumerate(ways):
        rows += [f"SELECT sim_id, 'tick', {2 * k}, {at(50, g)}, '' FROM w", f"SELECT sim_id, 'tick', {2 * k + 1}, {at(58, g)}, '' FROM w", f"SELECT sim_id, 'label', {k}, {at(74, g)}, '{name}' FROM w"]
    tip = "80 + 58 * 0.8::DOUBLE * cos(a)", "80 + 58 * 0.8::DOUBLE * sin(a)"
    rows += ["SELECT sim_id, 'arrow', 0, 80 - 58 * 0.24::DOUBLE * cos(a), 80 - 58 * 0.24::DOUBLE * sin(a), '' FROM w", f"SELECT sim_id, 'arrow', 1, {tip[0]}, {tip[1]}, '' FROM w", f"SELECT sim_id, 'head', 0, {tip[0]}, {tip[1]}, '' FROM w"]
    rows += [f"SELECT sim_id, 'head', {k}, {tip[0]} - 12 * cos(a) {s} 7 * cos(a + pi() / 2), {tip[1]} - 12 * sin(a) {s} 7 * sin(a + pi() / 2), '' FROM w" for k, s in ((1, "+"), (2, "-"))]
    rows += ["SELECT sim_id, 'speed', 0, 80, 15, format('{:.1f} m/s', sqrt(u * u + v * v)) FROM w"]
    return f"WITH {SCENARIO.strip()}, w AS (SELECT sim_id, u, v, -atan2(v, u) AS a FROM wind WHERE sim_id >= 0) SELECT sim_id, part, seq, round(x, 4) AS x, round(y, 4) AS y, label FROM ({' UNION ALL '.join(rows)})"


ORACLE_SQL = {
    "fuel_dimension": f"WITH {FUEL} SELECT * FROM fuel",
    "grid_coords": f"WITH {LAND.strip()} SELECT r, c, r * {COLS} + c AS point_id, c * 5.0::DOUBLE AS x, r * 5.0::DOUBLE AS y, round(elevation, 6) AS z FROM terrain",
    "terrain_elevation": f"WITH {LAND.strip()} SELECT r, c, {six('elevation')} FROM terrain",
    "elevation_minmax_norm": f"WITH {LAND.strip()} SELECT r, c, {six('elev_norm')} FROM normed",
    "emc_by_event": """WITH e AS (SELECT event_id, CAST(user_id % 100 AS DOUBLE) AS rh, (10 + ((value % 30) + 30) % 30) * 9 / 5 + 32 AS f FROM events)
        SELECT event_id, round(least(greatest(CASE WHEN rh < 10 THEN 0.03229::DOUBLE + 0.281073::DOUBLE * rh - 0.000578::DOUBLE * rh * f WHEN rh < 50 THEN 2.22749::DOUBLE + 0.160107::DOUBLE * rh - 0.01478::DOUBLE * f
               ELSE 21.0606::DOUBLE + 0.005565::DOUBLE * rh * rh - 0.00035::DOUBLE * rh * f - 0.483199::DOUBLE * rh END / 100, 0.01), 0.30), 6) AS moisture FROM e""",
    "moisture_field": f"WITH {LAND.strip()} SELECT r, c, {six('moisture')} FROM land",
    "wind_vector": f"WITH {SCENARIO.strip()} SELECT sim_id, {six('wind_speed', 'wind_dir')}, round(u, 6) + 0.0::DOUBLE AS wind_u, round(v, 6) + 0.0::DOUBLE AS wind_v FROM wind WHERE sim_id >= 0",
    "voronoi_fuel_map": f"""WITH {LAND.strip()}, seeds AS (SELECT n_nationkey AS k, (n_nationkey * 37) % (SELECT max(nr) FROM cells) AS sr, (n_nationkey * 11) % {COLS} AS sc FROM nation),
        d AS (SELECT r, c, k, CAST((r - sr) * (r - sr) + (c - sc) * (c - sc) AS BIGINT) AS dist2 FROM cells CROSS JOIN seeds)
        SELECT r, c, CAST(k AS INT) AS seed_id, CAST(k % 6 AS INT) AS fuel_idx, dist2 FROM d QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY dist2, k) = 1""",
    "cell_fuel_join": f"WITH {FUEL}, {LAND} SELECT r, c, c2.fuel_idx, fuel_name, fuel_load, moisture_ext, fuel_load > 0 AS valid FROM cells c2 LEFT JOIN fuel USING (fuel_idx)",
    "neighbor_shift": f"WITH {OFFSET}, {LAND}, n AS (SELECT t.r, t.c, o.d, coalesce(s.elevation, 0) AS e FROM terrain t CROSS JOIN offs o LEFT JOIN terrain s ON s.r = t.r - o.dr AND s.c = t.c - o.dc) SELECT r, c, "
        + ", ".join(f"round(max(CASE WHEN d = {d} THEN e END), 6) + 0.0::DOUBLE AS s{d}" for d in range(8)) + " FROM n GROUP BY r, c",
    "reaction_intensity": f"WITH {FUEL}, {LAND}, base AS (SELECT 0 AS sim_id, r, c, elevation, moisture, fuel_idx, 0.0 AS u, 0.0 AS v FROM land), {PHYSICS} SELECT r, c, {six('rel_beta', 'eta_m', 'ir', 'xi', 'denom')} FROM heat",
    "directional_ros": f"WITH {FUEL}, {OFFSET}, {LAND}, base AS (SELECT 0 AS sim_id, r, c, elevation, moisture, fuel_idx, cos(radians(45)) AS u, sin(radians(45)) AS v FROM land), {PHYSICS}, {edges(0.1, False)} SELECT r, c, "
        + ", ".join(f"round(max(CASE WHEN d = {d} THEN CAST(p AS DOUBLE) END), 5) + 0.0::DOUBLE AS p{d}" for d in range(8)) + " FROM edge GROUP BY r, c",
    "ca_arrival": f"{spread(BLIND, None)} SELECT r, c, ignite_step FROM arrival",
    "active_per_step": f"{ACTIVE} SELECT step, active FROM act",
    "state_history": f"{FORWARD} SELECT step, r, c, {STATE} AS state FROM arrival CROSS JOIN steps",
    "iou_by_scenario": f"{spread(ALL)}, {SCORES} SELECT sim_id, {six('iou')} FROM scores",
    "loss_best_params": f"{spread(ALL)}, {SCORES} SELECT sim_id, round(1 - iou, 6) AS loss, round(iou * 100, 4) AS accuracy, {six('wind_mult', 'dir_offset', 'moisture_offset')} FROM best JOIN scen USING (sim_id) WHERE rank = 1",
    "ensemble_top_k": f"{spread(ALL)}, {SCORES} SELECT CAST(rank AS INT) AS rank, sim_id, {six('iou')} FROM best WHERE rank <= {TOP}",
    "confidence_map": f"{CONFIDENCE} SELECT r, c, {six('probability')} FROM conf",
    "confidence_masked": f"{CONFIDENCE} SELECT r, c, nullif(round(probability, 6), 0) AS probability FROM conf",
    "blind_vs_truth": f"""{spread("-1, -2")} SELECT count_if(b.burned) AS blind, count_if(t.burned) AS observed, count_if(b.burned AND t.burned) AS "both", count_if(b.burned OR t.burned) AS either, count_if(b.burned AND NOT t.burned) AS blind_only
        FROM arrival b JOIN arrival t USING (r, c) WHERE b.sim_id = -2 AND t.sim_id = -1""",
    "display_frame": f"{FORWARD}, last AS (SELECT *, (SELECT max(step) FROM steps) AS step FROM arrival) SELECT a.r, a.c, CASE {STATE} WHEN 1 THEN 6 WHEN 2 THEN 7 ELSE fuel_idx END AS code FROM last a JOIN land l ON l.r = a.r AND l.c = a.c",
    "color_lut": f"SELECT code, hex, {', '.join(f'round(CAST(concat(chr(48), chr(120), substr(hex, {k}, 2)) AS INT) / 255.0::DOUBLE, 6) AS {n}' for n, k in (('red', 2), ('green', 4), ('blue', 6)))}, 1.0::DOUBLE AS alpha FROM (VALUES {values(COLOURS)}) AS v(code, hex)",
    "compass_polyline": _compass(),
    "overlay_terrain_prob": f"{CONFIDENCE} SELECT r, c, {six('elevation')}, nullif(round(probability, 6), 0) AS probability FROM land LEFT JOIN conf USING (r, c)",
    "burned_set_ops": f"""{spread("-1, -2")}, a AS (SELECT r, c FROM arrival WHERE sim_id = -2 AND burned), b AS (SELECT r, c FROM arrival WHERE sim_id = -1 AND burned)
        SELECT 'intersect' AS op, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'union', * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "playback_progress": f"{ACTIVE}, told AS (SELECT *, active = 0 AND step = (SELECT max(step) FROM steps) AS extinguished FROM act) SELECT step, active, extinguished, 33 AS interval_ms FROM told WHERE step % {EVERY} = 0 OR extinguished",
    "state_color_map": f"SELECT * FROM (VALUES {values(STATE_COLOURS)}) AS v(state, hex)",
    "twin_recovery": f"{spread('-1, -2')} SELECT a.sim_id, round(count_if(a.burned AND t.burned) / count_if(a.burned OR t.burned), 6) AS iou FROM arrival a JOIN arrival t ON t.sim_id = -1 AND t.r = a.r AND t.c = a.c GROUP BY a.sim_id",
    "calibration_start": f"{', '.join(_search())} SELECT sim_id, {six('wind_mult', 'dir_offset', 'moisture_offset', 'iou')} FROM scores JOIN scen USING (sim_id)",
    "fuel_burn_summary": f"{spread(BLIND, None)} SELECT fuel_idx, fuel_name, count(*) AS cells, count_if(burned) AS burned FROM arrival JOIN land USING (r, c) JOIN fuel USING (fuel_idx) GROUP BY fuel_idx, fuel_name",
}
