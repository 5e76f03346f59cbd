"""Connected components of a link table: forests of blocks of links, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from .common import attach, release, stage

#: Links that a worker holds at once.
LINKS = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node that it's linked with) that connect what the links (a, b) connect; one a node, none of a smallest one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(ids))
    while (root[x] != root[y]).any():
        p, q = root[x], root[y]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != root[root]).any():
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(ids)))
    return ids[child], ids[root[child]]


def _forests(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Every `most` links replaced by their forest."""
    held, n = [], 0

    def send() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in forest(*(np.concatenate(c) for c in zip(*held, strict=True)))], ["a", "b"])

    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= most:
            yield send()
            held, n = [], 0
    if n:
        yield send()


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or smaller and larger ones: then every link leads to its root."""
    seen = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = seen.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not each.agg(F.max(F.expr("up > 1 or up * down > 0"))).first()[0]


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(pairs: DataFrame, total: int) -> DataFrame:
    """pairs (u, v) with each u's smallest neighbour m, itself included. Hot nodes are broadcast, see attach()."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return attach(pairs, least.select("u", F.least("u", "m").alias("m"), "n"), ["u"], "n", total).drop("n")


def components(edges: DataFrame, rounds: int = 60, held: int = LINKS) -> DataFrame:
    """edges (a, b): two longs. Returns node, root: the smallest node that it's linked with; nodes without a link are absent.

    Every round is written to the shared folder; the links only shrink, and converge to stars."""
    ship(edges.sparkSession)
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(links.mapInArrow(lambda batches: _forests(batches, held), "a long, b long").distinct(), "links")
    if now.count() <= held:  # few enough for one worker, which needs no rounds
        now = stage(now.coalesce(1).mapInArrow(lambda batches: _forests(batches, 2 * held), "a long, b long"), "forest")
    for _ in range(rounds):
        if _stars(now):
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = stage(_canonical(_star(both, 2 * now.count()).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))), "large-star")
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), large.count())
        last, now = now, stage(_canonical(small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))), "small-star")
        release(last)
        release(large)
    else:
        raise RuntimeError(f"links didn't converge in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
