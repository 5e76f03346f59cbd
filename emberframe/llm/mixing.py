"""Mixing sources to target weights by the cube method (balanced sampling).

Targets come from the sources' sizes. A source that is to be taken r times gives every document floor(r)
times, and the fraction that is left is an inclusion probability, the same for all its documents. The cube
method then makes these probabilities 0 or 1: the flight moves them along the null space of the balancing
constraints (documents and words of the source), so both totals stay as they are, until no more than two
documents are undecided; the landing gives up one constraint after the other, words last, and one exchange of two documents then closes most
of the gap in words that it left.

Work is spread over blocks of a source (at most about BLOCK rows, by hash of doc_id and size; rows whose doc_id is null or
repeated often by their own number too); each block flies on its
own and hands on what it couldn't decide, at most two rows; these meet in the next round's blocks, until one block
of a source is left, which also lands. A hot source is many blocks, never one task; many small sources share a task. Draws are seeded by source,
round and block, and a block is sorted first, so reruns agree.

Any number of sources will do: their sizes, ranks and targets are a table, and only a few sums of it come to the driver.

Edge cases: a null or empty text has size 0: it's drawn like any document and takes 0 words; a null source is
a source of its own, last in order; repeated rows are documents of their own; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import ship
from .common import WORD, attach, stage, table

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
BLOCK = 20_000
EPS = 1e-9


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Target words of each source: `share` of all words by weight, no source above cap times its own size;
    what is over is dealt again by weight among those below, until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))  # Python compares by code point
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size, left = dict(order), share * sum(n for _, n in order)
    out: dict[str | None, float] = {}
    free = list(size)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > cap * size[s]]
        if not full:
            out |= {s: weight[s] * unit for s in free}
            break
        for s in full:
            out[s] = cap * size[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def flight(p: np.ndarray, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The fast flight phase: p (n) moves in the null space of a (n, q) until at most q entries are undecided.

    Only q + 1 undecided units are in play at a time, so a step costs O(q^2) and the whole O(n)."""
    p, q = p.copy(), a.shape[1]
    n = len(p)
    live = [i for i in range(min(n, q + 1)) if EPS < p[i] < 1 - EPS]
    at = min(n, q + 1)
    draws = rng.random(n + q + 1)
    used = 0
    while True:
        while len(live) < q + 1 and at < n:
            if EPS < p[at] < 1 - EPS:
                live.append(at)
            at += 1
        if len(live) < q + 1:
            return p
        if q == 2:  # the cross product is the null space of two rows
            (x0, y0), (x1, y1), (x2, y2) = a[live[0]], a[live[1]], a[live[2]]
            u = [x1 * y2 - x2 * y1, x2 * y0 - x0 * y2, x0 * y1 - x1 * y0]
            if max(map(abs, u)) < 1e-12:
                u = [y1, -y0, 0.0] if abs(y0) + abs(y1) > 1e-12 else [x1, -x0, 0.0]
                if max(map(abs, u)) < 1e-12:
                    u = [1.0, 0.0, 0.0]
        else:
            u = np.linalg.svd(a[live].T)[2][-1].tolist()
        up = down = np.inf
        for i, d in zip(live, u, strict=True):
            if d > 1e-14:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < -1e-14:
                up, down = min(up, -p[i] / d), min(down, (p[i] - 1) / d)
        move = up if draws[used] * (up + down) < down else -down
        used += 1
        for i, d in zip(live, u, strict=True):
            p[i] += move * d
            if p[i] < EPS:
                p[i] = 0.0
            elif p[i] > 1 - EPS:
                p[i] = 1.0
        live = [i for i in live if 0 < p[i] < 1]


def landing(p: np.ndarray, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide what the flight left: drop constraints from the first to the last and fly again, then draw."""
    for k in range(1, a.shape[1]):
        open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
        if len(open_):
            p[open_] = flight(p[open_], a[open_][:, k:], rng)
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    p[open_] = rng.random(len(open_)) < p[open_]
    return p


def exchange(p: np.ndarray, words: np.ndarray, goal: float) -> np.ndarray:
    """One chosen and one other document change places if that brings the chosen words nearer to goal."""
    gap = goal - words[p > 0.5].sum()
    inside, outside = np.flatnonzero(p > 0.5), np.flatnonzero(p <= 0.5)
    if not len(inside) or not len(outside):
        return p
    outside = outside[np.argsort(words[outside], kind="stable")]
    at = np.searchsorted(words[outside], words[inside] + gap)
    best = min(((abs(gap - (words[outside[j]] - words[i])), i, outside[j]) for i, k in zip(inside, at, strict=True)
                for j in (k - 1, k) if 0 <= j < len(outside)), default=(np.inf, 0, 0))
    if best[0] < abs(gap):
        p[best[1]], p[best[2]] = 0.0, 1.0
    return p


def decided(seed: str, g: int, b: int, last: bool, uid: np.ndarray, doc_id: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities of one block after its flight and, if it's its source's only block, landing."""
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{seed}|{g}|{b}".encode(), digest_size=8).digest(), "big"))
    order = np.argsort(uid, kind="stable")
    for key in (size, doc_id):
        order = order[np.argsort(key[order], kind="stable")]
    # In random order, then the largest first: what stays undecided is mostly small, and so is the landing's error.
    order = order[rng.permutation(len(order))]
    order = order[np.argsort(-size[order], kind="stable")]
    # Both constraints hold totals: documents (a one for each), then words.
    a = np.column_stack([np.ones(len(order)), size[order] / max(1.0, size.mean())])
    start = p[order]
    q = flight(start, a, rng)
    if last:
        q = exchange(landing(q, a, rng), a[:, 1], float(start @ a[:, 1]))
    out = np.empty(len(order))
    out[order] = q
    return out


def _round(seed: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows uid, doc_id, g, b, blocks, size, p in order of g and b: each block decided. Holds one block and one batch."""

    def done(t: pa.Table) -> pa.RecordBatch:
        uid, g, b, blocks, size, p = (t.column(c).to_numpy() for c in ("uid", "g", "b", "blocks", "size", "p"))
        names = np.array([x or "" for x in t.column("doc_id").to_pylist()], object)
        new = p.copy()
        edge = np.flatnonzero((np.diff(g) != 0) | (np.diff(b) != 0)) + 1
        for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(g)], strict=True):
            new[s:e] = decided(seed, int(g[s]), int(b[s]), int(blocks[s]) == 1, uid[s:e], names[s:e], size[s:e].astype(float), p[s:e])
        return pa.RecordBatch.from_arrays([t.column("uid").combine_chunks(), t.column("doc_id").combine_chunks(), pa.array(g), pa.array(size), pa.array(new)], schema=SCHEMA)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = lambda batch, k: (batch.column(2)[k].as_py(), batch.column(3)[k].as_py())
        for batch in batches:
            if not batch.num_rows:
                continue
            key = at(batch, batch.num_rows - 1)
            g, b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            tail = int(np.argmax((g == key[0]) & (b == key[1])))
            if tail or held and at(held[0], 0) != key:
                yield done(pa.Table.from_batches([*held, batch.slice(0, tail)]))
                held = []
            held.append(batch.slice(tail))
        if held:
            yield done(pa.Table.from_batches(held))

    return decide


SCHEMA = pa.schema([("uid", pa.int64()), ("doc_id", pa.string()), ("g", pa.int64()), ("size", pa.int64()), ("p", pa.float64())])


def sizes_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cube(rows: DataFrame, seed: str = "mix", block: int = BLOCK) -> DataFrame:
    """rows: uid, doc_id, g (group), size, p (inclusion probability). Returns them with p 0 or 1 for every row."""
    spark = rows.sparkSession
    ship(spark)
    undecided = f"p > {EPS} AND p < 1 - {EPS}"
    rows = rows.select("uid", F.col("doc_id").cast("string"), "g", "size", "p")
    open_, done, step, n = rows.where(undecided), [rows.where(f"NOT ({undecided})")], 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        sums = stage(open_.groupBy("g").agg(F.count("*").alias("n")), f"cube-groups-{step}")
        total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
        if not total[0]:
            break
        # A doc_id and size that fill a good part of a block would all be in one: they're dealt by row number.
        often = open_.groupBy("g", "doc_id", "size").agg(F.count("*").alias("often")).where(F.col("often") * 8 > block)
        tagged = attach(open_, often, ["g", "doc_id", "size"], "often", total[0], "left") if total[1] > block else open_.withColumn("often", F.lit(None).cast("long"))
        salt = F.when(F.col("often").isNotNull() | F.col("doc_id").isNull(), F.col("uid")).otherwise(F.lit(0))
        dealt = attach(tagged, sums.select("g", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")), ["g"], "n", total[0])
        dealt = dealt.select("uid", "doc_id", "g", F.pmod(F.xxhash64(F.lit(step), "doc_id", "size", salt), F.col("blocks")).cast("int").alias("b"), "blocks", "size", "p")
        out = dealt.repartition(n, "g", "b").sortWithinPartitions("g", "b").mapInArrow(_round(f"{seed}|{step}"), "uid long, doc_id string, g long, size long, p double")
        out = stage(out, f"cube-{step}")
        done.append(out.where(f"NOT ({undecided})"))
        open_ = out.where(undecided)
        step += 1
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def planned(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """rows: source, size. source, n (rows), source_size, target, g (rank): targets() as a table, for any number of sources."""
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # Ranks by code point, null last: ranges of sources, each numbered from the number of sources before it.
    spread = stage(found.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = sorted((r["part"], r["c"]) for r in spread.groupBy("part").agg(F.count("*").alias("c")).collect())
    before = dict(zip((p for p, _ in counts), accumulate((c for _, c in counts), initial=0)))
    offset = F.element_at(F.create_map(*[F.lit(x) for p, o in before.items() for x in (p, o)]), F.col("part")) if before else F.lit(0)
    ranked = spread.withColumn("g", (offset + F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("g") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.select("source", "n", "source_size", "g", weight.alias("w")), "mix-ranks")
    # What is over the caps is dealt again until no source is above its own: a level that only rises, found from sums.
    total, unit = ranked.agg(F.sum("source_size")).first()[0] or 0, -1.0
    while True:
        full = F.col("w") * F.lit(unit) > cap * F.col("source_size")
        s = ranked.agg(F.sum(F.when(full, F.col("source_size"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        level = (share * total - cap * (s["full"] or 0)) / s["w"] if s["w"] else inf
        if level <= unit or not s["w"]:
            break
        unit = level
    unit = max(unit, level)
    return ranked.select("source", "n", "source_size", "g", F.least(F.col("w") * F.lit(unit), cap * F.col("source_size")).cast("double").alias("target"))


def mix(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, uid; one row for each row of docs.

    A row's number (uid) is fixed by staging doc_id, source and size first."""
    rows = stage(docs.select(F.monotonically_increasing_id().alias("uid") if uid is None else F.col(uid).alias("uid"), "doc_id", "source", sizes_of().alias("size")), "mix-sizes")
    per = stage(planned(rows), "mix-plan").withColumn("ratio", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    # Null is a source: it's joined by a name that no other source has.
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    per = per.select(named.alias("name"), "n", "g", "source_size", "target", F.floor(F.col("ratio") + EPS).cast("int").alias("whole"), F.greatest(F.lit(0.0), F.col("ratio") - F.floor(F.col("ratio") + EPS)).alias("p"))
    keyed = stage(attach(rows.withColumn("name", named), per, ["name"], "n", rows.count()).drop("name", "n"), "mix-rows")
    chosen = cube(keyed, block=BLOCK)
    return keyed.drop("p").join(chosen.select("uid", (F.col("p") > 0.5).cast("int").alias("more")), "uid").select(
        "doc_id", "source", "size", "source_size", "target", ((F.col("whole") + F.col("more")) * F.col("size")).cast("long").alias("taken"),
        (F.col("whole") + F.col("more")).alias("copies"), "uid")


def take(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with docs' columns; rows are told apart by a number of their own."""
    numbered = stage(docs.withColumn("__uid", F.monotonically_increasing_id()), "mix-numbered")
    found = mix(numbered, "__uid").where("copies > 0").select(F.col("uid").alias("__uid"), F.col("copies").alias("__copies"))
    return numbered.join(found, "__uid").withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("uid", "source")
