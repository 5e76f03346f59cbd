"""SentencePiece encoding, sampling without replacement, and decoding.

`ids` are the model's own encoding, exactly what the sentencepiece library gives. Samples come from the lattice that the
vocabulary's pieces span over a text; a segmentation's weight is the product of its pieces' (a piece of
rank r weighs 1 / (r + SHIFT): merge order stands in for frequency, as the model has no probabilities). `sample` draws the k segmentations with the largest
Gumbel-perturbed log probabilities, which is sampling k without replacement, by A-star: the agenda holds sets of
segmentations (all that share a beginning and then take none of some edges), each with the exact perturbed maximum of
the set as its bound. Popping a set gives the segmentation that attains it, drawn edge by edge from the lattice, and splits
the others by where they first leave it; the maxima of the parts are Gumbels cut off at the popped value. A
segmentation's inclusion score is the chance that it's among the k, given the (k+1)th perturbed value.

No piece holds a space behind another character or a line end, so no merge crosses these: a text falls into units there,
its encoding is its units' encodings in a row, and its lattice is
the chain of its units' lattices. Both are made once for each distinct unit that a partition has met lately; what is remembered
is bounded in bytes and dropped when the partition ends. A round pops one set
for each text of a batch and draws all their paths together by array operations. Every draw is a hash of row key,
round and place, so results depend on neither batches nor workers.

Decoding joins pieces, bytes and spaces. Samples decode to the text exactly, also those with a literal lower block
character, which they write in bytes; the library reads that character as a space, so there `decoded` is false.

Edge cases: a null text counts as empty: no piece, and one segmentation, the space that goes before every text; a text with
fewer than k segmentations gives all of them, with inclusion 1; rows with
one doc_id and one text get the same samples; a null doc_id is a key of its own; texts of any length are encoded
whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import accumulate, islice
from math import inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K, SEED, SHIFT = 2, 3, 10.0
SPACE = "▁"
#: Stands for a literal SPACE character while a text is cut into units.
LITERAL = "\ud800"
#: Ends a unit where units are joined. Neither is in any valid text.
STOP = "\ud801"
#: Bytes of lattices that a worker remembers, characters of the texts that are drawn together (one text at least), and of units that are built together.
MOST_BYTES, MOST_CHARS, MOST_NEW = 120_000_000, 400_000, 60_000
#: Units that the library encodes in one text.
MOST_UNITS = 100
UNIT = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class Vocabulary:
    """Pieces with their log weights, from a model file's bytes, and a trie of them in sorted arrays."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.byte = {}
        self.ids: dict[str, int] = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[p] = i
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes across a space or a line end")
        rank = {i: -sp.get_score(i) for i in self.ids.values()}
        least = log(1 / (max(rank.values()) + SHIFT))
        self.logp = {i: log(1 / (r + SHIFT)) for i, r in rank.items()} | dict.fromkeys(self.byte.values(), least)
        n = len(self.pieces)
        self.length = np.array([len(p) if p in self.ids else 1 for p in self.pieces], np.int64)
        self.weight = np.array([self.logp.get(i, 0.0) for i in range(n)])
        byte_of = {i: bytes([b]) for b, i in self.byte.items()}
        raw = [byte_of.get(i) or p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.line = self.byte[10]
        self._trie()

    def _trie(self) -> None:
        letters = sorted({c for p in self.ids for c in p})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.n_letters = len(letters) + 1
        nodes: dict[str, int] = {"": 0}
        for p in self.ids:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        edges = sorted((nodes[x[:-1]] * self.n_letters + int(self.letter[ord(x[-1])]), k) for x, k in nodes.items() if x)
        self.edge = np.array([e for e, _ in edges], np.int64)
        self.child = np.array([k for _, k in edges], np.int64)
        self.ends = np.array([self.ids.get(x, -1) for x in nodes], np.int64)
        self.root = np.zeros(self.n_letters, np.int64)  # children of the root by letter; 0: none
        n = int(np.searchsorted(self.edge, self.n_letters))
        self.root[self.edge[:n]] = self.child[:n]

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every piece at every place: all places go down the trie together, a letter at a time."""
        letter = self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        letter = np.append(letter, 0)
        node = self.root[letter]
        at = np.flatnonzero(node)
        node = node[at]
        starts, found, depth = [], [], 0
        while len(at):
            if depth:
                key = node * self.n_letters + letter[at + depth]
                e = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                ok = np.flatnonzero(self.edge[e] == key)
                at, node = at[ok], self.child[e[ok]]
            piece = self.ends[node]
            whole = piece >= 0
            starts.append(at[whole])
            found.append(piece[whole])
            depth += 1
        none = np.empty(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *found])

    def bytes_of(self, ids: np.ndarray) -> bytes:
        size = self.raw_size[ids]
        start = self.raw_start[ids] - (np.cumsum(size) - size)
        return self.raw[np.repeat(start, size) + np.arange(size.sum())].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of a whole sequence; the space put before it is taken off."""
        return self.bytes_of(np.asarray(ids, np.int64)).decode("utf-8", "replace")[1:]


class Index(dict):
    """Numbers keys as they turn up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Grow:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.all, self.n = np.empty(1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.all):
            more = np.empty(max(len(self.all) * 5 // 4, self.n + len(x)), self.all.dtype)
            more[:self.n] = self.all[:self.n]
            self.all = more
        self.all[self.n:self.n + len(x)] = x
        self.n += len(x)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """In (0, 1): SplitMix64, from a stream's (mixed) seed and a place in it."""
    x = mix(seed + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


class Lattice:
    """Nodes and edges of many units. Node base[u] + a is place a of unit u, the last node its end. Edges of a node are
    in a row, from first on: cum (running probability, the last 1), lp (log probability given the node) and piece; an edge goes
    as many nodes on as its piece has characters. The model's own encoding of unit u is own[own_start[u]:own_start[u + 1]]."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.index = Index()
        self.base, self.end, self.first = Grow(np.int64), Grow(np.int64), Grow(np.int32)
        kind = np.uint16 if len(self.vocab.pieces) < 1 << 16 else np.int32
        self.cum, self.lp, self.piece = Grow(np.float32), Grow(np.float32), Grow(kind)
        self.more = {}  # ids of edges that are several byte pieces
        self.own, self.own_start = Grow(kind), Grow(np.int64)
        self.own_start.add(np.zeros(1, np.int64))

    def held(self) -> int:
        """Bytes, about: arrays, and a unit's key."""
        return sum(g.all.nbytes for g in (self.base, self.end, self.first, self.cum, self.lp, self.piece, self.own, self.own_start)) + 150 * len(self.index)

    def units(self, texts: list[str]) -> list[np.ndarray]:
        """Unit numbers of each text, with the space that goes before it; new units are built together, MOST_NEW characters at a time."""
        if self.held() > MOST_BYTES:
            self.clear()
        index, out = self.index, []
        number, known = index.__getitem__, len(index)
        for t in texts:
            found = UNIT.findall(SPACE + (t.replace(SPACE, LITERAL) if SPACE in t else t).replace(" ", SPACE))
            out.append(np.fromiter(map(number, found), np.int64, len(found)))
        part, size = [], 0
        for u in islice(index, known, None):
            part.append(u)
            size += len(u)
            if size > MOST_NEW:
                self.build(part)
                part, size = [], 0
        if part:
            self.build(part)
        return out

    def build(self, new: list[str]) -> None:
        """Edges of a node are in order of length, longest first. `text` has all new units, a stop after each: its places are the nodes."""
        v = self.vocab
        # Units are encoded together, a line end before each, behind which a unit is encoded as it stands. The first piece is the space before all.
        # The library takes less time a character the shorter a text is: a few hundred units go at a time.
        lines = [("\n" + u).replace(LITERAL, SPACE).replace(SPACE, " ") for u in new if u != "\n"]
        parts = [v.sp.encode("".join(lines[k:k + MOST_UNITS])) for k in range(0, len(lines), MOST_UNITS)]
        own = np.concatenate([np.empty(0, np.int32), *(np.array(x[1:], np.int32) for x in parts)])
        line = own == v.line
        size = np.ones(len(new), np.int64)
        size[[k for k, u in enumerate(new) if u != "\n"]] = np.diff(np.append(np.flatnonzero(line), len(own))) - 1
        if len(size) > line.sum():  # a line end is a unit too, its encoding its own piece
            at = int(np.cumsum(size)[new.index("\n")]) - 1
            own = np.insert(own[~line], at, v.line)
        else:
            own = own[~line]
        self.own.add(own)
        self.own_start.add(int(self.own_start.all[self.own_start.n - 1]) + np.cumsum(size))
        text = "".join([u + STOP for u in new])
        size = np.fromiter(map(len, new), np.int64, len(new)) + 1
        start, n = self.first.n, len(text)
        stops = np.cumsum(size) - 1
        left = np.repeat(stops, size) - np.arange(n)  # of each node, characters to the end of its unit
        src, piece = v.matches(text)
        length, w = v.length[piece], v.weight[piece]
        single = np.zeros(n, bool)
        single[src[length == 1]] = True
        several = {}
        extra = np.flatnonzero(~single & (left > 0))
        if len(extra):  # characters without a piece are written in bytes
            raw = [[v.byte[x] for x in (SPACE if text[k] == LITERAL else text[k]).encode("utf-8", "replace")] for k in extra.tolist()]
            w = np.concatenate([w, [sum(v.logp[i] for i in o) for o in raw]])
            several = {len(piece) + k: o for k, o in enumerate(raw) if len(o) > 1}
            piece = np.concatenate([piece, [o[0] for o in raw]])
            src, length = np.concatenate([src, extra]), np.concatenate([length, np.ones(len(extra), np.int64)])
        order = np.argsort(left[src] * ((n + 1) * 32) + src * 32 + 31 - length)  # ends of units first, then by node and length
        src, w, piece, length = src[order], w[order], piece[order], length[order]
        to = src + length
        after = np.zeros(n)
        heads = np.concatenate([[0], np.flatnonzero(np.diff(src)) + 1])
        sizes = np.diff(np.append(heads, len(src)))
        levels = np.flatnonzero(np.diff(left[src[heads]], prepend=-1))
        for k, l in zip(levels.tolist(), np.append(levels[1:], len(heads)).tolist(), strict=True):
            lo, hi = heads[k], heads[l] if l < len(heads) else len(src)
            h, s = heads[k:l] - lo, src[heads[k:l]]
            x = w[lo:hi] + after[to[lo:hi]]
            m = np.maximum.reduceat(x, h)
            after[s] = m + np.log(np.add.reduceat(np.exp(x - np.repeat(m, sizes[k:l])), h))
        lp = np.minimum(0.0, w + after[to] - after[src])
        p = np.exp(lp)
        lp = np.where(np.repeat(sizes, sizes) == 1, 0.0, np.minimum(lp, -1e-16))  # 0 only where there's no other way
        run = np.cumsum(p)
        cum = run - np.repeat(run[heads] - p[heads], sizes)
        cum = np.minimum(cum.astype(np.float32), np.float32(1 - 2.0**-24))  # 1 marks the last edge
        cum[heads + sizes - 1] = 1.0
        e0 = self.cum.n
        first = np.full(n, -1)
        first[src[heads]] = heads + e0
        if several:
            place = np.argsort(order)
            self.more |= {int(place[k]) + e0: o for k, o in several.items()}
        for g, x in ((self.cum, cum), (self.lp, lp), (self.piece, piece), (self.first, first)):
            g.add(x)
        self.base.add(stops - size + 1 + start)
        self.end.add(stops + start)

    def paths(self, node: np.ndarray, end: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each node to its end, one path behind the other, and the edges that each has; drawn by
        probability. place: of the node in its text."""
        n = len(node)
        live = np.flatnonzero(node != end)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        node, place = node[live], place[live]
        cum, piece, length = self.cum.all, self.piece.all, self.vocab.length
        while len(live):
            e = self.first.all[node]
            u = uniform(seed[live], place)
            go = np.flatnonzero(u >= cum[e])
            while len(go):
                e[go] += 1
                go = go[u[go] >= cum[e[go]]]
            steps.append((live, e))
            size = length[piece[e]]
            then = node + size
            place = place + size
            on = np.flatnonzero(then != end[live])
            live, node, place = live[on], then[on], place[on]
        count = np.zeros(n, np.int64)
        for live, _ in steps:
            count[live] += 1
        offset = np.cumsum(count) - count
        out = np.empty(count.sum(), np.int64)
        for k, (live, e) in enumerate(steps):
            out[offset[live] + k] = e
        return out, count

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path."""
        p = self.piece.all[edges].astype(np.int32)
        if self.more:
            found = [k for k, e in enumerate(edges.tolist()) if e in self.more]
            if found:
                parts, last = [], 0
                for k in found:
                    parts += [p[last:k], np.array(self.more[int(edges[k])], np.int32)]
                    last = k + 1
                return np.concatenate([*parts, p[last:]], dtype=np.int32)
        return p

    def encode(self, texts: list[str], units: list[np.ndarray]) -> list[np.ndarray]:
        """The model's own encoding of each text, given its units."""
        first, out = self.own_start.all, []
        for t, u in zip(texts, units, strict=True):
            if not t:
                out.append(np.empty(0, np.int32))  # the library puts no space before nothing
            elif SPACE in t:
                out.append(np.array(self.vocab.sp.encode(t), np.int32))
            else:
                size = first[u + 1] - first[u]
                out.append(self.own.all[np.repeat(first[u] - (np.cumsum(size) - size), size) + np.arange(size.sum())].astype(np.int32))
        return out

    def sample(self, units: list[np.ndarray], k: int, seeds: np.ndarray) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """Of each text, given its units, at most k segmentations, largest perturbed value first: (ids, log probability, perturbed value, inclusion)."""
        base, end, length = self.base.all, self.end.all, self.vocab.length
        sizes = [end[u] - base[u] for u in units]
        starts = [np.cumsum(s) - s for s in sizes]  # of units in their text
        seeds = mix(np.asarray(seeds, np.uint64))
        found: list[list] = [[] for _ in units]
        # A set: (-bound, tie, its parent's path (edges, their units, log probabilities), edge that it leaves it at, edges excluded there, log probability before).
        agenda: list[list[tuple]] = []
        for x in uniform(seeds, np.zeros(len(seeds))).tolist():
            agenda.append([(log(-log(x)), 0, None, 0, frozenset(), 0.0)])
        ties = 0
        for turn in range(k):
            jobs = []  # (text, bound, beginning with its units and log probabilities, edge that it leaves at, excluded there, log probability before, first unit to draw, node in it or -1, mass of the edges not taken)
            stream = mix(seeds + np.uint64(2 * turn + 1))
            splits, picks = mix(stream + np.uint64(7)), uniform(stream, np.full(len(stream), 1 << 40))
            for d, heap in enumerate(agenda):
                if not heap:
                    continue
                bound, _, parent, j, excluded, before = heapq.heappop(heap)
                if parent is None:
                    jobs.append((d, -bound, parent, 0, frozenset(), before, 0, -1, 0.0))
                    continue
                edges, of, lps = parent
                back = j
                while back and of[back - 1] == of[j]:
                    back -= 1
                node = int(base[units[d][of[j]]] + length[self.piece.all[edges[back:j]]].sum())
                e = a = int(self.first.all[node])
                p = []
                while True:
                    p.append(0.0 if e in excluded else float(np.exp(np.float64(self.lp.all[e]))))
                    if self.cum.all[e] >= 1.0:
                        break
                    e += 1
                run = list(accumulate(p))
                u = float(picks[d]) * run[-1]
                pick = a + next(x for x, c in enumerate(run) if c > u)
                others = sum(q for x, q in enumerate(p) if a + x != pick)
                kept = (np.append(edges[:j], pick), of[:j + 1], np.append(lps[:j], self.lp.all[pick]))
                jobs.append((d, -bound, kept, j, excluded, before, int(of[j]) + 1, node + int(length[self.piece.all[pick]]), others))
            if not jobs:
                break
            nodes, ends, owner, place, of_all, lens = [], [], [], [], [], []
            for d, _, _, _, _, _, first, node, _ in jobs:
                u = units[d][first:]
                b, n, s, o = base[u], end[u], starts[d][first:], np.arange(first, first + len(u))
                if node >= 0:  # what is left of the unit that was left at an edge
                    back = units[d][first - 1]
                    b, n, s, o = np.append(node, b), np.append(end[back], n), np.append(starts[d][first - 1] + node - base[back], s), np.append(first - 1, o)
                nodes.append(b)
                ends.append(n)
                place.append(s)
                of_all.append(o)
                owner.append(np.full(len(b), stream[d]))
                lens.append(len(b))
            drawn, count = self.paths(np.concatenate(nodes), np.concatenate(ends), np.concatenate(owner), np.concatenate(place))
            of_drawn = np.repeat(np.concatenate(of_all), count)
            lp_drawn = self.lp.all[drawn]
            bounds = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(lens)])]
            for (d, g, kept, j, excluded, before, _, _, others), lo, hi in zip(jobs, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                edges, of, lps = drawn[lo:hi], of_drawn[lo:hi], lp_drawn[lo:hi]
                if kept is not None:
                    edges, of, lps = np.concatenate([kept[0], edges]), np.concatenate([kept[1], of]), np.concatenate([kept[2], lps])
                ahead = np.cumsum(lps, dtype=np.float64)
                found[d].append((self.ids(edges), float(ahead[-1]), g))
                if not len(lps):
                    continue
                # The others of the popped set, by the first edge that differs. No more of these parts than are wanted yet can be popped.
                rest = -np.expm1(lps[j:].astype(np.float64))
                start = ahead[j:] - lps[j:]
                taken = excluded | {int(edges[j])}
                if excluded:
                    rest[0] = others
                open_ = np.flatnonzero(rest > 0)
                if not len(open_):
                    continue
                mass = start[open_] + np.log(rest[open_])
                e = -np.log(uniform(splits[d:d + 1], open_ + j))
                values = -np.logaddexp(-g, np.log(e) - mass)
                want = min(len(values), k - turn)
                for x in np.argpartition(-values, want - 1)[:want].tolist() if want > 1 else [int(values.argmax())]:
                    at = int(open_[x])
                    ties += 1
                    heapq.heappush(agenda[d], (-float(values[x]), ties, (edges, of, lps), j + at, taken if at == 0 else frozenset({int(edges[j + at])}), float(start[at])))
        out = []
        for rows, heap in zip(found, agenda, strict=True):
            limit = -heap[0][0] if heap else -inf
            out.append([(ids, lp, g, 1.0 if limit == -inf else float(-np.expm1(-np.exp(min(700.0, lp - limit))))) for ids, lp, g in rows])
        return out


_LATTICES: dict[int, Lattice] = {}


def lattice_of(model: bytes) -> Lattice:
    key = hash(model)
    if key not in _LATTICES:
        _LATTICES[key] = Lattice(Vocabulary(model))
    return _LATTICES[key]


def row_seed(key: object, seed: int = SEED) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{key}".encode(), digest_size=8).digest(), "big")


SAMPLE = "rank int, n_pieces int, log_prob double, perturbed double, inclusion double, ids_sha256 string, decoded boolean"


def _together(keys: list, texts: list[str | None]) -> Iterator[tuple[list, list[str]]]:
    """Rows in groups of at most MOST_CHARS characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > MOST_CHARS:
            yield keys[at:k], [x or "" for x in texts[at:k]]
            at, size = k, 0
        size += len(t or "") + 1
    if at < len(keys):
        yield keys[at:], [x or "" for x in texts[at:]]


def encode(docs: DataFrame, k: int = K, model_path: str = MODEL, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces and ids_sha256 of the model's own encoding, decoded (whether it decodes to the text), samples (array of
    SAMPLE: the k sampled segmentations, largest first); with_ids: also the piece ids of the encoding and of every sample."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path, "rb") as f:  # on the driver only: 0.5 MB of vocabulary go along with the tasks
        shared = spark.sparkContext.broadcast(f.read())
    digest = lambda ids: hashlib.sha256(np.ascontiguousarray(ids, "<i4").tobytes()).hexdigest()
    item = pa.struct([("rank", pa.int32()), ("n_pieces", pa.int32()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("ids_sha256", pa.string()), ("decoded", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = lattice_of(shared.value)
        try:
            for b in batches:
                yield rows_of(s, b)
        finally:
            s.clear()

    def rows_of(s: Lattice, b: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, ok, samples, best_ids, sample_ids = [], [], [], [], [], []
        for keys, texts in _together(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seeds = np.array([row_seed(key, seed) for key in keys], np.uint64)
            units = s.units(texts)
            for text, best, found in zip(texts, s.encode(texts, units), s.sample(units, k, seeds), strict=True):
                raw = b" " + text.encode()
                n.append(len(best))
                sha.append(digest(best))
                ok.append(not text or s.vocab.bytes_of(best) == raw)
                samples.append([{"rank": r, "n_pieces": len(i), "log_prob": lp, "perturbed": g, "inclusion": p, "ids_sha256": digest(i), "decoded": s.vocab.bytes_of(i) == raw} for r, (i, lp, g, p) in enumerate(found)])
                if with_ids:
                    best_ids.append(best.tolist())
                    sample_ids.append([i.tolist() for i, *_ in found])
        cols = [b.column(0), pa.array(n, pa.int32()), pa.array(sha, pa.string()), pa.array(ok, pa.bool_()), pa.array(samples, pa.list_(item))]
        names = ["doc_id", "n_pieces", "ids_sha256", "decoded", "samples"]
        if with_ids:
            cols += [pa.array(best_ids, pa.list_(pa.int32())), pa.array(sample_ids, pa.list_(pa.list_(pa.int32())))]
            names += ["ids", "sample_ids"]
        return pa.RecordBatch.from_arrays(cols, names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_pieces int, ids_sha256 string, decoded boolean, samples array<struct<{re.sub(r'(\w+) (\w+)', r'\1: \2', SAMPLE)}>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>, sample_ids array<array<int>>" if with_ids else ""))


def decode(rows: DataFrame, model_path: str = MODEL) -> DataFrame:
    """rows: doc_id, ids. Returns doc_id, text."""
    with open(model_path, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = lattice_of(shared.value).vocab
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else vocab.decode(i) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
