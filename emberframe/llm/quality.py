"""Quality rules: fixed base rules over a document's words, then gradient-boosted trees over its statistics.

The trees learn the labels `quality` from at most TRAIN_ROWS labelled rows (those with the smallest hash of
doc_id). Symbols, repeated lines, repeated windows and shouting can only lower a document's chance, whatever
the sample says (monotonic constraints). Whole texts are read; nothing is cut.

Edge cases: a null or blank text has no word and fails the base rules; labels that are null, repeated or
absent are no error: without both classes among the labels there is no model and the base rules decide alone;
rows with one doc_id are judged one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt
from .common import small_batches, table, words_of

#: Labelled rows that the trees are fitted on, at most.
TRAIN_ROWS = 8000
#: A document is kept if its chance to be of good quality is this or more.
KEEP_AT = 0.4
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOL = re.compile(r"[#*$%&|<>]")
UPPER, DIGIT, END = re.compile(r"[A-Z]"), re.compile(r"[0-9]"), re.compile(r"[.!?](?=[\x20\x09-\x0D]|$)")
#: Statistic and its constraint: -1 if more of it can only lower the quality.
FEATURES = [("log_words", 0), ("word_len", 0), ("symbols_per_word", -1), ("dup_lines", -1), ("repeat_words", -1),
            ("upper", -1), ("digits", 0), ("ends_per_word", 0), ("shouts_per_word", -1), ("distinct", 0), ("line_words", 0)]
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k:k + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    seen: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(maybe).tolist():  # equal hashes are checked word by word
        seen.setdefault(w[i:i + width].tobytes(), []).append(i)
    edge = np.zeros(len(words) + 1, int)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(edge, places, 1)
            np.add.at(edge, np.array(places) + width, -1)
    return int((edge.cumsum() > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), the FEATURES."""
    text = text or ""
    words = words_of(text)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = len(SYMBOL.findall(text))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    n, c = max(1, len(words)), max(1, chars)
    feats = [np.log1p(len(words)), chars / n, symbols / n, dup / max(1, len(lines)), repeat / n, len(UPPER.findall(text)) / c,
             len(DIGIT.findall(text)) / c, len(END.findall(text)) / n, text.count("!") / n, len(set(words)) / n, len(words) / max(1, len(lines))]
    return [len(words), chars, symbols, dup, repeat], feats


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> gbt.Forest | None:
    """At most `rows` rows of statistics come to the driver. Of rows with one doc_id the smallest text is taken."""
    by = F.xxhash64(F.lit("quality"), "doc_id")
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("y"))
    sample = F.broadcast(known.orderBy(by, "doc_id").limit(rows))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([statistics(t)[1] for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    texts = docs.join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    found = texts.select("y", "text").mapInArrow(stats, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in found], float)
    if not len(y) or y.min() == y.max():
        return None
    order = sorted(range(len(y)), key=lambda k: (found[k]["x"], y[k]))  # the fit doesn't depend on the order of rows
    return gbt.fit(np.array([found[k]["x"] for k in order]), y[order], [m for _, m in FEATURES])


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality (null without a model)."""
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    forest = train(spark, docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            found = [statistics(t) for t in b.column(1).to_pylist()]
            base = np.array([x for x, _ in found], np.int64)
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            p = forest.probability(np.array([x for _, x in found])) if forest else None
            kept = ~failed & (p >= KEEP_AT) if forest else ~failed
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(kept),
                 pa.array(p) if forest else pa.nulls(b.num_rows, pa.float64())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"])

    return docs.mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, {BASE}, base_failed boolean, kept boolean, quality double")


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
