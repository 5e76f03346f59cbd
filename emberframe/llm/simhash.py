"""SimHash near-dedup with pivot distance tables.

Texts become 64-bit fingerprints; equal fingerprints are one node from then on. For every distinct fingerprint
the Hamming distances to many fixed reference fingerprints are computed once: its row of the pivot table. By
the triangle inequality two fingerprints that differ in at most REACH bits have rows that differ by at most
REACH in every coordinate; pairs with a larger difference in any coordinate are discarded, and only survivors are
verified bit by bit. No set of pairs is ever a table: pairs are looked at inside blocks, coordinate by coordinate,
and a block gives the links of a spanning forest.

Blocks come from the table as well. Its first references are zero and 32 fingerprints that have two bits each, no bit twice. The distance to such a
reference and that to zero tell how many of the two bits are set, so 33 distances give 32 counts (0 to 2) that can differ for near fingerprints in two places at most. They
are read in four groups of eight: two groups at least are equal, so each of the six pairs of groups
is a key (six rows a fingerprint; unlike fingerprints share a key once in six million). The other PIVOTS references are random; differences in them discard what a block has in
common by chance. A key with more than BLOCK distinct fingerprints (a dense cloud of near copies)
isn't compared pair by pair: its fingerprints go the exact way around, by meeting points: two fingerprints differ
in at most two bits exactly if some fingerprint is within one bit of both, so each is listed under the 65
fingerprints within one bit of it, and all that meet at one point (65 at most) are linked.

Edge cases: a null or blank text has fingerprint zero and is linked like any other; fewer words than a shingle: the
whole sequence is the only one; rows with one doc_id are nodes by their fingerprints; a null doc_id is never a
component_id unless all of the component are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import HOT, attach, small_batches, stage, table
from .graph import components

SEED, REACH = 42, 2
SHINGLE = 3
#: Random reference fingerprints, and distinct fingerprints of a block that are compared pair by pair, at most.
PIVOTS, BLOCK = 16, 1024
#: Reference fingerprints of two bits each, as signed longs.
TWOS = [3 << 2 * j if j < 31 else -(1 << 62) for j in range(32)]
GROUPS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def pivots(n: int = PIVOTS) -> list[int]:
    """The random reference fingerprints, as signed longs."""
    return [int(x) for x in np.random.default_rng(64).integers(-2**63, 2**63 - 1, n)]


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """As an unsigned integer."""
    words = text.lower().split() if text else []  # of bytes both are ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1:].tolist(), strict=True)), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        bits += np.unpackbits(h[k:k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long), staged."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return stage(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long"), "fingerprints")


def links_in(fp: np.ndarray, table_: np.ndarray, reach: int = REACH, words: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of one block: (fingerprint, the smallest index it's linked with, over any number of links), links only.

    fp may have rows of several words, the first `words` of which are compared. Pairs start as those near in the first coordinate, in order of it; each further coordinate discards more."""
    order = np.argsort(table_[:, 0], kind="stable")
    d, x = table_[order].astype(np.int16), fp[order]
    last = np.searchsorted(d[:, 0], d[:, 0] + reach, side="right")
    count = last - np.arange(len(x)) - 1
    i = np.repeat(np.arange(len(x)), count)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    for k in range(1, d.shape[1]):
        near = np.abs(d[i, k] - d[j, k]) <= reach
        i, j = i[near], j[near]
    if x.ndim == 1:
        true = np.bitwise_count(x[i] ^ x[j]) <= reach
    else:  # wide fingerprints, a part of the pairs at a time
        true = np.concatenate([np.empty(0, bool), *[np.bitwise_count(x[i[k:k + 200_000], :words] ^ x[j[k:k + 200_000], :words]).sum(1, dtype=np.int64) <= reach for k in range(0, len(i), 200_000)]])
    i, j = i[true], j[true]
    root = np.arange(len(x))
    while len(i):
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(x)))
    return x[moved], x[root[moved]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, fp, pivots in order of key: links (a, b), or the fingerprint itself twice if its block is too large.

    Holds one block of at most BLOCK rows and one batch."""
    key, fp, tab, large = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty((0, PIVOTS), np.uint8), None

    def out(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        x, y = (np.concatenate(v or [np.empty(0, np.uint64)]).view(np.int64) for v in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    def finish(key: np.ndarray, fp: np.ndarray, tab: np.ndarray, a: list, b: list) -> None:
        nonlocal large
        edge = np.flatnonzero(np.diff(key)) + 1
        for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
            if e - s > BLOCK or key[s] == large:
                large = key[s]
                a.append(fp[s:e])
                b.append(fp[s:e])
            elif e - s > 1:
                x, y = links_in(fp[s:e], tab[s:e])
                a.append(x)
                b.append(y)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        tab = np.concatenate([tab, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, PIVOTS)])
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        tail = int(np.searchsorted(key, key[-1]))
        if len(key) - tail > BLOCK or key[-1] == large:
            tail = len(key)  # this block is too large: its rows pass through
        if tail:
            finish(key[:tail], fp[:tail], tab[:tail], a, b)
            key, fp, tab = key[tail:], fp[tail:], tab[tail:]
        yield out(a, b)
    if len(key):
        a, b = [], []
        finish(key, fp, tab, a, b)
        yield out(a, b)


def distance(reference: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(reference)))


def group(k: int) -> Column:
    """Eight of the counts as one number: each from the distance to zero and the distance to a reference of two bits."""
    counts = [F.shiftright(distance(0) + 2 - distance(TWOS[j]), 1) for j in range(8 * k, 8 * k + 8)]
    return sum((c * 3**i for i, c in enumerate(counts)), F.lit(0))


def meeting_links(fps: DataFrame) -> DataFrame:
    """fps: fp, distinct. Links a, b among all that differ in two bits at most, by meeting points of 65 members at most."""
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)])
    met = fps.select("fp", F.explode(flips).alias("z")).groupBy("z").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where("size(all) > 1")
    return met.select(F.explode("all").alias("a"), "b").where("a <> b")


def links(distinct: DataFrame, total: int) -> DataFrame:
    """distinct: fp, one row each, `total` of them. Links (a, b) that connect all within REACH bits, and only those."""
    refs = pivots()
    pivot_row = F.unhex(F.concat(*[F.lpad(F.hex(distance(p)), 2, "0") for p in refs]))
    tabled = stage(distinct.select("fp", pivot_row.alias("pivots"), *[group(k).alias(f"group{k}") for k in range(4)]), "pivot-table")
    keys = F.array(*[F.lit(k << 32) + F.col(f"group{i}") * 3**8 + F.col(f"group{j}") for k, (i, j) in enumerate(GROUPS)])
    keyed = tabled.select(F.explode(keys).alias("key"), "fp", "pivots")
    # Blocks with a hundredth of a percent of all rows or more, HOT at most: known before rows are dealt, so that none meets in a task.
    hot = F.broadcast(keyed.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") > BLOCK) & (F.col("n") * HOT >= 6 * total)).select("key"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.join(hot, "key", "left_anti").repartition(n, "key").sortWithinPartitions("key")
    found = stage(dealt.mapInArrow(_blocks, "a long, b long"), "block-links")
    dense = found.where("a = b").select(F.col("a").alias("fp")).unionByName(keyed.join(hot, "key", "left_semi").select("fp")).distinct()
    return found.where("a <> b").unionByName(meeting_links(dense))


def near_dedup(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id; one row for each row of docs."""
    rows = fingerprints(docs, width)
    distinct = stage(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "distinct-fp")
    roots = stage(components(links(distinct.select("fp"), distinct.count())), "fp-roots")
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("m"))
    of_linked = attach(roots, smallest, ["root"], "m", roots.count()).select(F.col("node").alias("fp"), "component_id")
    named = stage(distinct.join(of_linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id")), "fp-components")
    return attach(rows, named, ["fp"], "n", rows.count()).select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of().alias("fingerprint"), "component_id")
