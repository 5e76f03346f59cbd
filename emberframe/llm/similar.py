"""Near copies by similarity: wide SimHash with pivot distance tables drawn from the data.

For similarity of word shingles (SIMILAR and more of all different shingles shared), 64 bits say too little: a
text gets BITS bits. Two bits agree with a probability that follows from the similarity, so the share of equal bits
of a SKETCH_WORDS * 64 bit sketch estimates it (candidates have SLACK), and copies agree in all bits of some band with
high probability: the number of bands is set so that a pair at SIMILAR is met with probability FOUND. Bands are wider
the more fingerprints there are, so that a band's key stays rare among texts that have nothing in common.

Fingerprints with a key in common are a block. Reference fingerprints are drawn from the block itself; distances to them
are its pivot table; pairs that differ by more than the reach in any coordinate are discarded, and survivors near on the
sketch are candidates. A block of more than BLOCK members (a cloud of near copies) is a star: all its members are candidates.
Candidates only say which texts are compared: within a component of candidates, texts are linked if their sets of shingles
share SIMILAR of all. A component goes to one group of rows; one of more than PART members is dealt in parts, and each two
parts are such a group, so no pair of it is left out, at a cost that grows with the square of its size.

Edge cases: a null or blank text has fingerprint zero and is like any other such text; fewer words than a shingle: the
whole sequence is the only one; repeated rows are one node; different texts with one doc_id are rows of their own; a null
doc_id comes last in a group; an empty table gives no rows; columns of other names pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from .common import HOT, attach, small_batches, stage
from .graph import components, forest
from .pieces import mix
from .simhash import SEED, links_in

SHINGLE, SIMILAR, FOUND = 5, 0.8, 0.98
BITS, SKETCH_WORDS = 1024, 4
#: Standard deviations of slack of candidates; texts of fewer shingles than FEW don't follow the bit model and are always compared by their sets.
SLACK, FEW = 4.5, 64
#: Members of a block that are compared pair by pair, reference fingerprints of a block, and members of a part of a component of candidates.
BLOCK, REFERENCES, PART = 1024, 8, 1024
#: Blocks of so many members are done all at once, and rows that a worker takes at once.
SMALL, ROWS = 32, 1 << 13
STEPS = (np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]


def differing(similar: float) -> float:
    """Share of bits that differ between texts that share so much of their shingles (of about equal number)."""
    return acos(2 * similar / (1 + similar)) / pi


def reach(bits: int) -> int:
    """Bits that a pair at SIMILAR differs in, with SLACK."""
    return round(bits * differing(SIMILAR) + SLACK * (bits * differing(SIMILAR) * (1 - differing(SIMILAR))) ** 0.5)


#: Of a sketch, and of all bits.
REACH, WIDE_REACH = reach(64 * SKETCH_WORDS), reach(BITS)


def bands(nodes: int) -> list[np.ndarray]:
    """Bit numbers of each band, for so many fingerprints."""
    width = min(32, max(16, ceil(log2(max(nodes, 1))) - 4))
    n = ceil(log(1 - FOUND) / log(1 - (1 - differing(SIMILAR)) ** width))
    rng = np.random.default_rng(SEED)
    bits = np.concatenate([rng.permutation(BITS) for _ in range(ceil(n * width / BITS))])
    return [bits[k * width:(k + 1) * width] for k in range(n)]


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles, sorted."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1:].tolist(), strict=True)), np.uint64, n)
    return np.unique(h)  # similarity is of different shingles


def wide_of(h: np.ndarray) -> np.ndarray:
    """BITS bits of a set of shingles, as uint64 words."""
    if not len(h):
        return np.zeros(BITS // 64, np.uint64)
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1024):
        wide = mix(h[k:k + 1024, None] + STEPS)
        total += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)


def wide_fingerprint(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    return wide_of(shingles(text, width))


def same(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles share SIMILAR of all."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both) - 1e-9


def exact_links(sets: list[np.ndarray], wide: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all similar ones of some texts, each verified on the sets. Pairs that are connected already aren't looked at."""
    order = np.array(sorted(range(len(sets)), key=lambda k: len(sets[k])))
    size, wide = np.array([len(sets[k]) for k in order]), wide[order]
    root, out = np.arange(len(order)), []
    for i in range(1, len(order)):
        low = int(np.searchsorted(size, SIMILAR * size[i] - 1e-9))  # a much smaller set can't be similar
        d = np.bitwise_count(wide[low:i] ^ wide[i]).sum(1, dtype=np.int64)
        near = np.flatnonzero((d <= WIDE_REACH) | (size[low:i] < FEW))
        left = low + near[np.argsort(d[near], kind="stable")]
        while len(left):
            j, left = left[0], left[1:]
            if same(sets[order[i]], sets[order[j]]):
                out.append((int(order[i]), int(order[j])))
                root[root == root[j]] = root[i]
                left = left[root[left] != root[i]]
    return out


def verified(texts: DataFrame, nodes: DataFrame, roots: DataFrame, width: int) -> DataFrame:
    """Links (a, b) of similar nodes within the components that candidates make (node, root); texts: __rid, text. Only candidates' sets of shingles
    are made here. Components of more than PART members are dealt in parts, and each two parts meet in a group of their own."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("m"))
    placed = attach(roots, sizes, ["root"], "m", roots.count()).withColumn("parts", F.ceil(F.col("m") / PART).cast("int"))
    own = F.pmod(F.xxhash64("node"), "parts").cast("int")
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != own), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    found = texts.select(F.col("__rid").alias("rid"), F.col("text").cast("binary").alias("text")).join(placed.join(nodes.select("node", "rid", "wide"), "node"), "rid")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([shingles(t, width).tobytes() for t in b.column(0).to_pylist()], pa.binary())], [*b.schema.names[1:], "shingles"])

    members = found.select("text", "root", "node", "parts", "wide").mapInArrow(sets, "root long, node long, parts int, wide binary, shingles binary")
    met = members.withColumn("at", F.explode(F.when(F.col("parts") == 1, alone).otherwise(others))).select("root", "at.i", "at.j", "node", "wide", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def send() -> pa.RecordBatch:
            links = exact_links([np.frombuffer(x[2], np.uint64) for x in group], np.frombuffer(b"".join(x[1] for x in group), np.uint64).reshape(len(group), -1))
            return pa.RecordBatch.from_arrays([pa.array([group[k[side]][0] for k in links], pa.int64()) for side in (0, 1)], ["a", "b"])

        for b in batches:
            for root, i, j, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (root, i, j) != key:
                    if len(group) > 1:
                        yield send()
                    key, group = (root, i, j), []
                group.append(rest)
        if len(group) > 1:
            yield send()

    return stage(met.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long"), "similar-links")


def _small(key: np.ndarray, sk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of candidate pairs of small blocks, all blocks at once. The pivot table has the distances to a block's first and last members."""
    first, last = np.searchsorted(key, key), np.searchsorted(key, key, side="right") - 1
    tab = np.stack([np.bitwise_count(sk ^ sk[r]).sum(1, dtype=np.int64) for r in (first, last)], 1)
    found, step, left = [], 1, np.flatnonzero(np.arange(len(key)) < last)
    while len(left):  # each member with the next one, then with the second next, and so on
        i = left[(np.abs(tab[left] - tab[left + step]) <= REACH).all(1)]
        found.append(np.stack([i, i + step])[:, np.bitwise_count(sk[i] ^ sk[i + step]).sum(1, dtype=np.int64) <= REACH])
        step += 1
        left = left[left + step <= last[left]]
    return tuple(np.concatenate([np.empty((2, 0), np.int64), *found], 1))


def _members(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows key, node, sketch in order of key: links (a, b) of candidates, as forests. Members of a block of more than `block` are all linked to its first.

    Holds ROWS rows and one block of at most `block`."""
    key, node, sk = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, SKETCH_WORDS), np.uint64)
    large, head, held, n = None, 0, [], 0

    def finish(key: np.ndarray, node: np.ndarray, sk: np.ndarray) -> pa.RecordBatch:
        nonlocal large, head
        start = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        size = np.diff(np.append(start, len(key)))
        small = np.repeat((size <= min(SMALL, block)) & (key[start] != large), size)
        i, j = _small(key[small], sk[small])
        out = [(node[small][i], node[small][j])]
        for s, m in zip(start.tolist(), size.tolist(), strict=True):
            e = s + m
            if m > block or key[s] == large:
                if key[s] != large:
                    large, head = int(key[s]), int(node[s])
                out.append((node[s:e], np.full(m, head)))
            elif m > SMALL:
                refs = sk[np.linspace(s, e - 1, min(REFERENCES, m)).astype(int)]
                tab = np.stack([np.bitwise_count(sk[s:e] ^ r).sum(1, dtype=np.int64) for r in refs], 1)
                a, b = _links(sk[s:e], tab)
                out.append((node[s:e][a], node[s:e][b]))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in forest(*(np.concatenate(c) for c in zip(*out, strict=True)))], ["a", "b"])

    def gather() -> None:
        nonlocal key, node, sk, held, n
        key, node, sk = (np.concatenate(c) for c in zip(*[(key, node, sk), *held], strict=True))
        held, n = [], 0

    for batch in batches:
        keys, nodes, sketches = batch.columns
        held.append((keys.to_numpy(zero_copy_only=False), nodes.to_numpy(zero_copy_only=False), np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)))
        n += batch.num_rows
        if n < ROWS:
            continue
        gather()
        tail = int(np.searchsorted(key, key[-1]))
        if len(key) - tail > block or key[-1] == large:
            tail = len(key)
        if tail:
            yield finish(key[:tail], node[:tail], sk[:tail])
            key, node, sk = key[tail:], node[tail:], sk[tail:]
    if held:
        gather()
    if len(key):
        yield finish(key, node, sk)


def _links(sk: np.ndarray, tab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (member, the smallest it's linked with) of one block."""
    tagged = np.column_stack([sk, np.arange(len(sk), dtype=np.uint64)])
    a, b = links_in(tagged, tab, REACH, SKETCH_WORDS)
    return a[:, -1].astype(np.int64), b[:, -1].astype(np.int64)


def linked(nodes: DataFrame, total: int) -> DataFrame:
    """nodes: node, wide (binary), one row each. Links (a, b) of candidates, enough to connect them."""
    keyed_by = bands(total)
    bits = np.concatenate(keyed_by)
    weights = (1 << np.arange(len(keyed_by[0]))).astype(np.int64)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            on = np.unpackbits(raw, axis=1, bitorder="little")[:, bits].reshape(b.num_rows, len(keyed_by), -1)
            keys = on.astype(np.int64) @ weights + (np.arange(len(keyed_by), dtype=np.int64) << 32)
            sketch = pa.array([r[:8 * SKETCH_WORDS].tobytes() for r in raw], pa.binary())
            at = pa.array(np.repeat(np.arange(b.num_rows), len(keyed_by)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column(0).take(at), sketch.take(at)], ["key", "node", "sketch"])

    # Made twice, for the counts and for the blocks: cheaper than tens of rows a text on disk.
    keyed = nodes.select("node", "wide").mapInArrow(explode, "key long, node long, sketch binary")
    # Keys with a hundredth of a percent of all rows or more (HOT at most for a band): every member is linked to the smallest, and no task gets them all.
    hot = F.broadcast(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).where((F.col("n") > BLOCK) & (F.col("n") * HOT >= total)).select("key", "head"))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.join(hot, "key", "left_anti").repartition(n, "key").sortWithinPartitions("key")
    found = stage(dealt.mapInArrow(_members, "a long, b long"), "band-links").unionByName(keyed.join(hot, "key").select(F.col("node").alias("a"), F.col("head").alias("b")))
    return found.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def numbered_rows(docs: DataFrame) -> DataFrame:
    """docs with __rid, a row's number; staged, so that the numbers hold."""
    return stage(docs.withColumn("__rid", F.monotonically_increasing_id()), "near-rows")


def fingerprinted(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """docs: numbered. rid, doc_id, node (hash of the wide fingerprint), wide; staged."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = [wide_fingerprint(t, width).tobytes() for t in b.column(2).to_pylist()]
            node = np.array([int.from_bytes(xxh64_digest(w), "big", signed=True) for w in wide], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(wide, pa.binary())], ["rid", "doc_id", "node", "wide"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("__rid"), "doc_id", F.col("text").cast("binary").alias("text"))
    return stage(rows.mapInArrow(run, f"rid long, doc_id {kind}, node long, wide binary"), "wide-fingerprints")


def rooted(docs: DataFrame, width: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of numbered rows: (rows: rid, doc_id, node), (nodes: node, n, first (the smallest of its rows: no doc_id last, doc_id, rid), rid, wide), (roots: node, root of similar nodes)."""
    rows = fingerprinted(docs, width)
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    nodes = rows.groupBy("node").agg(F.count("*").alias("n"), order.alias("first"), F.first("wide").alias("wide"))
    nodes = stage(nodes.withColumn("rid", F.col("first.rid")), "wide-nodes")
    near = stage(components(linked(nodes, nodes.count())), "candidate-roots")
    return rows.select("rid", "doc_id", "node"), nodes, stage(components(verified(docs, nodes, near, width)), "similar-roots")


def groups(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, node, group_id (smallest doc_id that similar texts lead to, itself included; null if none has one)."""
    rows, nodes, roots = rooted(numbered_rows(docs), width)
    known = nodes.select("node", "n", F.col("first.doc_id").alias("first_id"))
    smallest = known.join(roots, "node").groupBy("root").agg(F.min("first_id").alias("group_id"), F.count("*").alias("m"))
    of_linked = attach(roots, smallest, ["root"], "m", roots.count()).select("node", "group_id")
    named = stage(known.join(of_linked, "node", "left").select("node", "n", F.coalesce("group_id", "first_id").alias("group_id")), "similar-groups")
    return attach(rows.select("doc_id", "node"), named, ["node"], "n", rows.count()).select("doc_id", "node", "group_id")


def keep_one(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One row of docs for each group of near copies, that with the smallest doc_id, with docs' columns.

    Rows are told apart by a number of their own, so different texts with one doc_id are judged one by one; a row without a
    doc_id stays only if none of its group has one; of equal doc_ids one row stays."""
    numbered = numbered_rows(docs)
    _, nodes, roots = rooted(numbered, width)
    of_linked = nodes.select("node", "first").join(roots, "node").groupBy("root").agg(F.min("first").alias("first")).select("first.rid")
    alone = nodes.select("node", "rid").join(roots.select("node"), "node", "left_anti").select("rid")
    kept = of_linked.unionByName(alone).withColumnRenamed("rid", "__rid")
    return numbered.join(kept, "__rid", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
