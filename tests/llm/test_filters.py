"""Quality trees, toxicity lexicon, personal data."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from emberframe.llm import gbt, pii, quality, toxicity

from . import fixtures as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_statistics(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines, dup = [], 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.append(x)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)]


def test_statistics_match_brute_force():
    rng = random.Random(5)
    texts = [None, "", " \n ", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n \n \nx ", "   a", "é# <b>|"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 60))) + rng.choice(["", "\n", "\n##"]) for _ in range(150)]
    for t in texts:
        assert quality.statistics(t)[0] == slow_statistics(t), t


def test_trees_learn_and_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.3) | (rng.random(3000) < 0.03)).astype(float)
    f = gbt.fit(x[:2000], y[:2000], [-1, 0, 0])
    assert ((f.probability(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93
    for row in x[:40]:
        line = np.repeat(row[None], 60, 0)
        line[:, 0] = np.linspace(0, 1, 60)
        assert (np.diff(f.margin(line)) <= 1e-12).all()


def test_scoring_walks_like_single_rows():
    rng = np.random.default_rng(1)
    x = rng.random((300, 2))
    f = gbt.fit(x, (x.sum(1) > 1).astype(float), [0, 0], trees=7)
    for row, m in zip(x[:30], f.margin(x), strict=False):
        total = f.base
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            total += f.value[node]
        assert total == pytest.approx(m)


def test_quality_rows(spark):
    docs = X.table(spark)
    none = X.labels(spark, [])
    got = quality.quality(spark, docs, none).collect()
    assert len(got) == docs.count() and all(r["quality"] is None and r["kept"] == (not r["base_failed"]) for r in got)
    for text, want in ((None, True), ("one two", True)):
        assert all(r["base_failed"] == want for r in got if r["doc_id"] in [i for i, t, _ in X.rows() if t == text and i is not None and i != 20])
    some = X.labels(spark, [(k, int(k < 3), 0) for k in range(6)] + [(None, 1, 0), (2, None, None), (2, 1, 0)])
    assert quality.quality(spark, docs, some).count() == len(got)
    assert quality.quality(spark, X.empty(spark), some).count() == 0


@pytest.mark.skipif(not X.HAVE, reason="no tables")
def test_quality_query_matches_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{X.SF}/documents.parquet").collect()}
    for r in quality.op1_quality_trees(spark, X.SF).collect():
        n, c, s, d, w = slow_statistics(texts[r["doc_id"]]) if len(texts[r["doc_id"]]) < 6000 else quality.statistics(texts[r["doc_id"]])[0]
        assert tuple(r)[1:6] == (n, c, s, d, w) and r["base_failed"] == (n < 10 or 100 * w > 20 * n)


def test_folding():
    assert toxicity.fold("IDIOT") == toxicity.fold("1d10t") == toxicity.fold("іdіоt") == toxicity.fold("ｉｄｉｏｔ") == "idiot"
    assert toxicity.fold("ñó") == "ñó" and toxicity.fold("a,b") == "a b" and toxicity.fold("lo5er") == toxicity.fold("loser")


def test_lexicon_hits_and_exceptions():
    lex = toxicity.Lexicon({"trash": 4.0, "tra": 1.0, "scum": 3.0}, ("trash can",))
    assert [w for _, w in lex.hits("Trash! a TRASH can scummy xtrash")] == [4.0, 3.0]
    slow = lambda t: [4.0 if w.startswith("trash") else 1.0 if w.startswith("tra") else 3.0 for w in toxicity.fold(t).split() if w.startswith(("tra", "scum"))]
    rng = random.Random(2)
    for _ in range(100):
        t = " ".join(rng.choice(["trash", "tram", "scum", "extra", "trAshy", "a"]) for _ in range(12))
        assert [w for _, w in lex.hits(t)] == slow(t)
    assert lex.score(None) == lex.score("") == lex.score("clean words") < 0.5 < lex.score("scum trash scum")
    long = "fine " * 3000
    assert lex.score("scum " + long) < lex.score("scum")


def toxic_world(n=900):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        y = int(rng.random() < 0.2)
        w = X.words(rng, rng.randint(30, 80)).split()
        for _ in range(3 * y):
            w[rng.randrange(len(w))] = "grumpf" + rng.choice(["an", "er", "th", "ou", "ble", "st"])
        docs.append((k, " ".join(w), "s"))
        labels.append((k, 1, y))
    return docs, labels


def test_toxicity_learns_unknown_terms(spark):
    docs, labels = toxic_world()
    table = X.table(spark, docs).select("doc_id", "text")
    lex = toxicity.train(spark, table, X.labels(spark, labels))
    assert any("grumpf".startswith(t) or t.startswith("grumpf") for t in lex.weights)
    y = {i: t for i, _, t in labels}
    held = [(i, t) for i, t, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((lex.score(t) >= toxicity.TOXIC_AT) == bool(y[i]) for i, t in held)
    assert right / len(held) > 0.97


def test_toxicity_never_sees_held_out_labels(spark):
    docs, labels = toxic_world(300)
    table = X.table(spark, docs).select("doc_id", "text")
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = toxicity.train(spark, table, X.labels(spark, labels)), toxicity.train(spark, table, X.labels(spark, turned))
    assert a.weights == b.weights and a.curve == b.curve


def test_toxicity_rows(spark):
    docs = X.table(spark)
    labels = X.labels(spark, [(1, 1, None), (None, 1, 1), (2, 1, 1)])
    kept = toxicity.drop_toxic(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count() and {r["score"] for r in kept.collect()} == {"clash"}
    bad = X.table(spark, [(1, "you idiot scum moron trash", "s"), (2, "fine words", "s")])
    assert [r["doc_id"] for r in toxicity.drop_toxic(spark, bad, labels).collect()] == [2]
    assert toxicity.drop_toxic(spark, X.empty(spark), labels).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_base(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_patterns_match_plain_regular_expressions():
    rng = random.Random(4)
    bits = ["a", "b.c", "@", "@@", ".", "x@y.z", "@d.e", "1", "22", "255", "256", "1.2.3.4", ".5.6", "+", "+1 ", "(555)", "-", " ", "4111111111111111", "4111 1111 1111 1111", "é", "_%", "+49 30 1234567", "..", "0" * 20]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(t) == slow_base(t), t


def test_long_ip_parts_count_by_value():
    zeros = "0" * 5000
    assert pii.base_spans(f"1.2.3.{zeros}4") == [("ip", 0, 5007)] and pii.base_spans(f"1.2.3.{zeros}256") == [] == pii.base_spans("1.2.3." + "9" * 5000)
    assert [pii.small(x) for x in ("0", "000", "255", "256", "0255", "1000", "99")] == [True, True, True, False, True, False, True]


def test_base_patterns_are_linear():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 50_000, "+1" + " " * 100_000, "a.b" * 60_000 + "@"):
        pii.base_spans(t)


def test_field_on_sentences_it_has_not_seen():
    field, rng = pii.trained(), random.Random(77)
    right = wrong = missed = 0
    for _ in range(250):
        text, gold = pii.sentence(rng)
        got = {(a, b): k for k, a, b in pii.all_spans(text, field)[1]}
        right += sum(got.get(s) == k for s, k in gold.items())
        missed += sum(got.get(s) != k for s, k in gold.items())
        wrong += sum(gold.get(s) != k for s, k in got.items())
    assert right / (right + missed) > 0.95 and right / (right + wrong) > 0.95


def test_decoding_is_the_best_segmentation():
    field, rng = pii.trained(), random.Random(3)

    def best(s, end):
        if end == 0:
            return 0.0
        return max([best(s, end - 1)] + [best(s, start) + field.score(k, f) for start, _, _, f in s.at[end] for k in pii.TYPES])

    for _ in range(25):
        text, _ = pii.sentence(rng)
        tokens = [(m.start(), m.end()) for m in pii.TOKEN.finditer(text)][:9]
        s = pii.Segments(text, tokens, [bool(pii.TRIGGER.search(text, a, b)) for a, b in tokens])
        index = {(a, b): f for row in s.at for _, a, b, f in row}
        assert sum(field.score(k, index[a, b]) for k, a, b in field.decode(s)) == pytest.approx(best(s, s.n))


def test_pii_rows(spark):
    t = "Mail bo.1@x.example.com or call (988) 555-2485 ok"
    docs = X.table(spark, [(1, t, "s"), (2, None, "s"), (3, "", None), (3, "clean words only", "s"), (None, "v 1.2", "s")])
    got = {r["doc_id"]: r for r in pii.find(docs).orderBy("spans").collect()}
    assert got[1]["spans"] == "email:5:23,phone:32:46" and got[1]["n_email"] == 1 and got[1]["n_phone"] == 0
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:5:23").hexdigest()
    assert got[2]["spans"] == got[3]["spans"] == got[None]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find(X.empty(spark)).count() == 0
