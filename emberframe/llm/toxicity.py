"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: case, homoglyphs, rare accents (Cyrillic, Greek, full width) and digit or
sign substitutions become one plain letter; anything else separates words. Terms are word beginnings, so one
automaton pass finds inflected forms too. Hits inside an exception phrase don't count. The sum of the
weights of the hits, normalised by length, becomes a score from 0 to 1 through a logistic curve.

The lexicon, its weights and the curve are learned from labelled rows whose crc32(doc_id) mod 3 isn't 1, at
most TRAIN_ROWS of them (smallest hash of doc_id). Scores use the text only. Whole texts are matched.

Edge cases: a null, empty or blank text has the score of a text without hits; null labels or doc_ids are
left out of training; without both classes among the labels the SEED terms and a fixed curve are used; a
null doc_id isn't held out; rows with one doc_id are scored one by one; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import exp, log, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, release, small_batches, stage, table

TRAIN_ROWS = 20_000
#: A document with this score or more is predicted toxic.
TOXIC_AT = 0.7
#: Word beginnings of so many letters are candidates for terms.
MIN_STEM, MAX_STEM = 4, 14
#: Nats of evidence that a learned term needs: its documents times -log(share of toxic documents).
EVIDENCE = 9.0
#: One in FOLDS sample rows fits the curve, the others give the terms.
FOLDS = 4
#: Rounds of learning, at most.
ROUNDS = 4
#: Terms that count before anything is learned.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown")
#: Phrases in which a term means no harm.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "class clown", "circus clown", "sore loser award", "scum line", "pond scum")

LOOKALIKES = {
    "a": "аα@4ɑ", "b": "вβ8", "c": "сϲ", "d": "ԁ", "e": "еεє3", "g": "9ɡ", "h": "һн", "i": "іιl1ıӏ", "j": "ј", "k": "кκ",
    "m": "мμ", "n": "пη", "o": "оο0σ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ5$", "t": "тτ7", "u": "υ", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "2",
}


class _Fold(dict):
    """str.translate table, filled as code points turn up."""

    def __missing__(self, code: int) -> str:
        one = chr(code).casefold()
        if "\xdf" <= one <= "\xff" and one.isalpha():  # letters of their own in western languages: e and é tell words apart
            self[code] = one
            return one
        plain = unicodedata.normalize("NFKD", chr(code)).casefold()
        kept = "".join(ONE.get(x, x if x.isalpha() else "") for x in plain if not unicodedata.combining(x))
        if unicodedata.combining(chr(code)) or unicodedata.category(chr(code)) == "Cf":
            self[code] = ""
        else:
            self[code] = kept or " "
        return self[code]


ONE = {x: letter for letter, all_of in LOOKALIKES.items() for x in all_of + letter if not (x == "l" and letter != "i")}
ONE["l"] = "i"  # l, i and 1 stand for one another
FOLD = _Fold()


def fold(text: str) -> str:
    return text.translate(FOLD)


@dataclass
class Lexicon:
    """weights: folded word beginnings; exceptions: folded phrases; curve: bias, slope of the weight per length, slope of the weight."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 3.0, 1.0)
    length_floor: int = field(default=25)

    @cached_property
    def automaton(self):  # noqa: ANN201
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(" " + term, (len(term) + 1, w))
        for phrase in self.exceptions:
            a.add_word(" " + phrase + " ", (len(phrase) + 2, None))
        a.make_automaton()
        return a

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def hits(self, text: str | None) -> list[tuple[int, float]]:
        """(start in the folded text, weight): of terms that begin at one place, the longest."""
        if not text or not self.weights:
            return []
        found: dict[int, tuple[int, float]] = {}
        safe: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton.iter(" " + fold(text) + " "):
            start = end - size + 1
            if w is None:
                safe.append((start, end))
            elif size > found.get(start, (0, 0.0))[0]:
                found[start] = (size, w)
        if safe:
            found = {s: x for s, x in found.items() if not any(a <= s < b for a, b in safe)}
        return [(s, w) for s, (_, w) in found.items()]

    def features(self, text: str | None) -> tuple[float, float]:
        """The weight of the hits for each hundred words, and the weight, both on a log scale."""
        w = sum(x for _, x in self.hits(text))
        if w <= 0:
            return 0.0, 0.0
        return log1p(100 * w / (len(text.encode("utf-8", "replace").split()) + self.length_floor)), log1p(w)

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def default_lexicon() -> Lexicon:
    return Lexicon({fold(t): 4.0 for t in SEED}, tuple(map(fold, EXCEPTIONS)))


def stems(words: set[str]) -> set[str]:
    return {w[:k] for w in words for k in range(MIN_STEM, min(len(w), MAX_STEM) + 1)}


def evidence(toxic: int, clean: int) -> float:
    """Nats that a toxic document without any clean one is worth."""
    return -log(max(toxic, 1) / max(1, toxic + clean))


def choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weighted terms from word beginnings with their numbers of toxic and clean documents.

    A beginning is a candidate if it's rare in clean documents and its evidence reaches EVIDENCE; of a chain of
    beginnings with (nearly) the same toxic documents the longest is taken, so a term is as specific as it can be.
    """
    base = evidence(toxic, clean)
    good = {s: p for s, (p, n) in counts.items() if p * base >= EVIDENCE and n <= 0.01 * p}
    longer: dict[str, int] = {}
    for s, p in good.items():
        if len(s) > MIN_STEM:
            longer[s[:-1]] = max(longer.get(s[:-1], 0), p)
    ends = {s for s, p in good.items() if longer.get(s, 0) < 0.9 * p}
    ends = {s for s in ends if not any(s[:k] in ends for k in range(MIN_STEM, len(s)))}
    weight = lambda s: log((counts[s][0] + 0.5) / (toxic + 1)) - log((counts[s][1] + 0.5) / (clean + 1))
    return {s: w for s in sorted(ends) if (w := weight(s)) > 0}


def logistic(x: np.ndarray, y: np.ndarray, reg: float = 0.02, steps: int = 60) -> tuple[float, float, float]:
    """Bias and two slopes that are not negative, by projected Newton steps; the classes count alike."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    b = np.array([-4.0, 1.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (w * (p - y)) + reg * np.array([0.01, 0.1, 0.1]) * b
        h = (a * (w * p * (1 - p))[:, None]).T @ a + reg * np.diag([0.01, 0.1, 0.1]) + 1e-9 * np.eye(3)
        b = b - np.clip(np.linalg.solve(h, g), -2, 2)
        b[1:] = np.maximum(b[1:], 0)
    return float(b[0]), float(b[1]), float(b[2])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Lexicon:
    """docs: doc_id, text. The sample is staged; what comes to the driver is bounded by its `rows` documents: counts of the word beginnings
    that have evidence for EVIDENCE in it, all of them, and two numbers for each document. Of rows with one doc_id the smallest text is taken."""
    by = F.xxhash64(F.lit("toxic"), "doc_id")
    known = labels.where((F.col("toxic").isin(0, 1)) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) != 1))
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(by, "doc_id").limit(rows)
    found = stage(docs.where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
                  .select("y", "text", (F.pmod(by, F.lit(FOLDS)) == 0).alias("curve")), "toxic-sample")
    # Terms come from the other folds: on the rows that chose them, clean texts would look cleaner than they are.
    terms_from, curve_from = found.where("NOT curve").drop("curve"), found.where("curve").drop("curve")
    size = {r["y"]: r["n"] for r in curve_from.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return default_lexicon()

    lexicon = default_lexicon()
    for _ in range(ROUNDS):  # terms for the toxic documents that no term explains yet
        def count(batches: Iterator[pa.RecordBatch], lexicon: Lexicon = lexicon) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = {0: Counter(), 1: Counter()}
                for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if not (y and lexicon.hits(t)):
                        n[y].update(stems(set(fold(t).split())) | {""})  # "" counts the documents
                terms = [*n[1].keys() | n[0].keys()]
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([n[1][t] for t in terms], pa.int64()), pa.array([n[0][t] for t in terms], pa.int64())], ["stem", "p", "n"])

        counts = terms_from.mapInArrow(count, "stem string, p long, n long").groupBy("stem").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        counts = stage(counts, "toxic-stems")
        left, clean = next(((r["p"], r["n"]) for r in counts.where("stem = ''").collect()), (0, 0))
        # Every beginning that can be a candidate, and no other (see choose).
        base = evidence(left, clean)
        seen = {r["stem"]: (r["p"], r["n"]) for r in counts.where(f"stem <> '' AND p * {base!r}D >= {EVIDENCE} AND n <= 0.01 * p").collect()} if base else {}
        release(counts)
        more = choose(seen, left, clean)
        if not more:
            break
        lexicon = Lexicon(lexicon.weights | more, lexicon.exceptions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [lexicon.features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in x], pa.float64()), pa.array([q for _, q in x], pa.float64())], ["y", "a", "b"])

    x = curve_from.mapInArrow(measure, "y int, a double, b double").collect()
    lexicon.curve = logistic(np.array([(r["a"], r["b"]) for r in x]), np.array([r["y"] for r in x], float))
    return lexicon


def toxicity(spark: SparkSession, docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs' columns, score and predicted; docs must not have columns of these two names."""
    small_batches(spark)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([lexicon.score(t) for t in b.column(at).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= TOXIC_AT).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    types = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(score, f"{types}, score double, predicted int")


def op10_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = train(spark, docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return toxicity(spark, docs, lexicon).select("doc_id", held.alias("held_out"), "score", "predicted")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with docs' columns."""
    lexicon = train(spark, docs.select("doc_id", "text"), labels)
    names = {c: f"__{k}" for k, c in enumerate(docs.columns) if c in ("score", "predicted")}
    found = toxicity(spark, docs.withColumnsRenamed(names), lexicon).where("predicted = 0").drop("score", "predicted")
    return found.withColumnsRenamed({v: k for k, v in names.items()})
