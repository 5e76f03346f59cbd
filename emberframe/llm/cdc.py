"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's white space counts as single spaces. Its bytes run through a gear hash (h = 2 h + gear[byte], of which the last WINDOW bytes
are kept); a chunk ends where the hash is smaller than at the REACH places on either side. That depends on nearby bytes only, so
boundaries follow the content: after an insertion they fall into step again, and a passage has the same inner chunks in whatever text it stands.
Smallest values come about evenly, so chunks are seldom much longer than 2 REACH + 1 bytes, their mean: short passages have whole
chunks too. Where a text repeats a few bytes over and over no place is the smallest; there it's cut at
smallest values that occur again, GAP bytes apart or more, in step with the repeats, and at MOST bytes anywhere.

Chunks are deduplicated by 128-bit digest: of equal ones the first in the order of the table's rows stays, the others are repeats,
be it in other documents or in the same. Repeated chunks that touch make a run; runs of SPAN_WORDS words or more are reported, shorter ones are chance.
A passage loses the rest of a chunk at either end, so SPAN_WORDS is below the 50 words that a passage of interest has.
A run is reported in spans, one for each stretch whose chunks stay in one place: removing all spans that aren't
kept leaves every chunk of a run exactly once.

Only repeated chunks move by document, and hot digests (a licence, a banner) are broadcast,
so no group of equal chunks meets in a task.

Edge cases: a null or empty text has no chunk and no row; a text's last chunk ends
with it; equal texts repeat as a whole; rows are documents by their place in the table, so rows with one
doc_id, or none, are one document each; a text of more than 2**PLACES chunks ends a run at that multiple; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import attach, small_batches, stage, table

#: Bytes that the hash sees; places on either side that a boundary's hash is compared with; bytes between cuts among repeats, and in a chunk, at most.
WINDOW, REACH, GAP, MOST = 16, 20, 64, 512
#: Words that a repeated run has at least.
SPAN_WORDS = 38
GEAR = np.random.default_rng(5).integers(0, 2**32, 256, dtype=np.uint32)
#: A chunk's number: the task, the document within it, the chunk within that, in so many bits.
DOCS, PLACES = 23, 21


def gear(data: np.ndarray) -> np.ndarray:
    """The hash behind every byte: the sum of gear[byte] << age over the last WINDOW bytes, in log2(WINDOW) doublings."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, 2 * step
    return h


def boundaries(data: bytes) -> np.ndarray:
    """Ends of the chunks of data, exclusive; the last is len(data)."""
    h = gear(np.frombuffer(data, np.uint8))
    n, w = len(h), REACH
    edge = np.full(w, 2**32 - 1, np.uint32)
    low, size = np.concatenate([edge, h, edge]), 1  # low[k]: the least of w values from k on, by doublings
    while 2 * size <= w:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[:n + w + 1], low[w - size:n + 2 * w + 1 - size])
    before, behind = low[:n], low[w + 1:]
    ends = np.flatnonzero((h < before) & (h <= behind)) + 1
    ends = np.append(ends[ends < n], n)
    gaps = np.diff(ends, prepend=0)
    wide = np.flatnonzero(gaps > 4 * w)
    if not len(wide):
        return ends
    more = []
    again = np.flatnonzero((h == before) & (h <= behind)) + 1
    for e, gap in zip(ends[wide].tolist(), gaps[wide].tolist(), strict=True):
        k = int(np.searchsorted(again, e - gap + 1))
        while k < len(again) and again[k] < e:
            more.append(int(again[k]))
            k = int(np.searchsorted(again, again[k] + GAP))
    ends = np.unique(np.concatenate([ends, np.array(more, ends.dtype)]))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > MOST:
        starts = ends - gaps
        ends = np.sort(np.concatenate([ends, *[np.arange(s + MOST, e, MOST) for s, e in zip(starts[gaps > MOST], ends[gaps > MOST], strict=True)]]))
    return ends


def cut(text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(places in the text at which its chunks start, their words, their bytes with single spaces)."""
    raw = np.frombuffer(text, np.uint8)
    space = (raw == 32) | (raw >= 9) & (raw <= 13)
    after = np.concatenate([[False], space[:-1]])
    kept = np.flatnonzero(~(space & after))
    plain = np.where(space, np.uint8(32), raw)[kept]
    data = plain.tobytes()
    ends = boundaries(data)
    starts = np.concatenate([[0], ends[:-1]])
    begins = ((~space) & (after | (np.arange(len(raw)) == 0)))[kept]
    return kept[starts], np.add.reduceat(begins, starts), [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def chunks(docs: DataFrame) -> DataFrame:
    """at (the chunk's number, in order of rows and within them), doc_id, start, stop (bytes), n_words (that start in the chunk), d1, d2 (the digest); staged."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = TaskContext.get().partitionId() << DOCS, 0
        for b in batches:
            own, at, first, last, words, digests = [], [], [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                starts, n, parts = cut(t)
                own.append(np.full(len(starts), k))
                at.append(((number + seen) << PLACES) + np.arange(len(starts)))
                seen += (len(starts) >> PLACES) + 1
                first.append(starts)
                last.append(np.append(starts[1:], len(t)))
                words.append(n)
                digests += map(xxh3_128_digest, parts)
            if seen >> DOCS or number >> 63 - PLACES:
                raise OverflowError("too many documents in a task, or tasks")
            if not own:
                continue
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(at)), b.column(0).take(pa.array(np.concatenate(own))), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (first, last, words)), pa.array(d[:, 0]), pa.array(d[:, 1])],
                ["at", "doc_id", "start", "stop", "n_words", "d1", "d2"])

    kind = dict(docs.dtypes)["doc_id"]
    return stage(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"at long, doc_id {kind}, start int, stop int, n_words int, d1 long, d2 long"), "chunks")


def repeated_spans(docs: DataFrame, span_words: int = SPAN_WORDS) -> DataFrame:
    """One row for each span: doc_id, start, stop (bytes of the text in UTF-8), n_words, n_chunks, kept (whether it stays here), keep_id (doc_id of
    the row in which it stays), run_start, run_stop and run_words (of the run that it's a part of)."""
    rows = chunks(docs)
    key = ["d1", "d2"]
    groups = stage(rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1"), "chunk-groups")
    # Chunks move with as little as possible: a document's id is put back at the end, when only spans are left.
    found = attach(rows.select("at", "start", "stop", "n_words", *key), groups, key, "n", rows.count()).select("at", "start", "stop", "n_words", "first")
    number = F.shiftright("at", PLACES)
    order = Window.partitionBy("doc").orderBy("at")
    opens = F.when(F.lag("at").over(order) == F.col("at") - 1, 0).otherwise(1)
    turns = F.when(F.lag("first").over(order) == F.col("first") - 1, 0).otherwise(1)
    marked = found.withColumn("doc", number).withColumns({"opens": opens, "turns": F.greatest(opens, turns)})
    marked = marked.withColumns({"run": F.sum("opens").over(order), "span": F.sum("turns").over(order)})
    spans = marked.groupBy("doc", "run", "span").agg(
        F.min("at").alias("at"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n_words").alias("n_words"), F.count("*").alias("n_chunks"), F.min("first").alias("first"))
    whole = Window.partitionBy("doc", "run")
    spans = spans.withColumns({"run_words": F.sum("n_words").over(whole), "run_start": F.min("start").over(whole), "run_stop": F.max("stop").over(whole)}).where(F.col("run_words") >= span_words)
    ids = stage(rows.where(F.col("at").bitwiseAND(F.lit((1 << PLACES) - 1)) == 0).select(number.alias("doc"), "doc_id"), "chunk-docs")
    keepers = ids.select(F.col("doc").alias("keeper"), F.col("doc_id").alias("keep_id"))
    return spans.join(ids, "doc").withColumn("keeper", F.shiftright("first", PLACES)).join(keepers, "keeper").select(
        "doc_id", "start", "stop", "n_words", "n_chunks", (F.col("first") == F.col("at")).alias("kept"), "keep_id", "run_start", "run_stop", "run_words")


def op7_cdc_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
