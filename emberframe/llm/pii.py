"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole candidate segments (one to MAX_TOKENS white-space tokens, a type) by features of the whole
span: its shape, digits, check sums, the word before it. A dynamic programme over bounded entity lengths chooses
boundaries and types jointly. Weights maximise the likelihood of generated sentences (forward and backward sums
over all segmentations, plain gradient steps, fixed seed); no text of the corpus is learned from.

A segment can only be an entity if it has a digit, an @ or a spelled-out at and dot, so tokens far from all of
these are outside in the best segmentation whatever the weights, and the programme runs only around them: the same
result as over the whole text. Spans of the base patterns stay; a segment that touches one is dropped.

Edge cases: a null text counts as empty and has no spans; spans are in code points, end exclusive; texts of any
length are read whole, patterns run in linear time; rows with one doc_id are read one by one; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from math import exp, inf, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the field, in the order that ties of spans are listed in.
TYPES = (*KINDS, "ssn", "iban")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits that it doesn't begin with, so these skip such places; runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d if not k % 2 else 2 * d - 9 * (d > 4))
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches: the run of local characters before an @, and a domain behind it. A run ends at the @ before."""
    out: list[Span] = []
    low = 0
    at = text.find("@")
    while at >= 0:
        run = text[low:at]
        start = at - (len(run) - len(run.rstrip(LOCAL)))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def small(part: str) -> bool:
    """Whether digits, with any number of zeros before them, are at most 255."""
    rest = part.lstrip("0")
    return len(rest) < 3 or len(rest) == 3 and rest <= "255"


def base_spans(text: str) -> list[Span]:
    """By start, then kind as listed."""
    out = emails(text)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(small(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = only_digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], TYPES.index(s[0]), s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- the field ----

MAX_TOKENS = 8
TOKEN = re.compile(r"\S+")
EDGE_LEFT, EDGE_RIGHT = "\"'<>[]{},;:!?=", "\"'<>[]{},;:!?.="
TRIGGER = re.compile(r"[0-9@]|[\[(] ?at ?[\])]|\bat\b(?=\s+\S{1,64}\s+dot\b)", re.I)
CUES = {"phone": "phone", "tel": "phone", "telephone": "phone", "call": "phone", "mobile": "phone", "cell": "phone", "fax": "phone", "telefon": "phone", "móvil": "phone",
        "email": "email", "mail": "email", "e-mail": "email", "contact": "email", "ssn": "ssn", "security": "ssn", "iban": "iban", "account": "iban", "konto": "iban",
        "card": "card", "visa": "card", "mastercard": "card", "karte": "card", "ip": "ip", "address": "ip", "host": "ip", "server": "ip"}
SHAPES = [(name, re.compile(p + r"\Z", re.I)) for name, p in (
    ("email", r"[\w.%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+"),
    ("email_spelled", r"[\w.%+-]+ ?(@|[\[(] ?at ?[\])]|\bat\b) ?[a-z0-9-]+( ?(\.|[\[(] ?dot ?[\])]|\bdot\b) ?[a-z0-9-]+)+"),
    ("ip4", r"\d{1,3}(\.\d{1,3}){3}"), ("ip_masked", r"\d{1,3}(\[\.\]\d{1,3}){3}"),
    ("ip6", r"(?=[0-9a-f:]*[0-9])([0-9a-f]{1,4}:){3,7}(:?[0-9a-f]{1,4}){1,4}|([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}"),
    ("phone_us", r"(\+?1[ .-]?)?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"), ("phone_int", r"(\+|00)[1-9]\d{0,2}([ .()-]{0,2}\d{2,4}){2,5}"),
    ("phone_local", r"0\d{1,4}[ /-]\d{3,4}([ -]?\d{2,4}){1,2}"),
    ("ssn", r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"), ("card_groups", r"\d{4}([ -]\d{4}){3}"),
    ("iban", r"[A-Z]{2}\d{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,4})?"),
    ("number", r"\d+"), ("decimal", r"\d+([.,]\d+)+"), ("date", r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}"), ("word", r"[^\W\d]+"),
)]


def features(span: str, before: str, tokens: int) -> list[str]:
    """Of a whole candidate segment."""
    digits = only_digits(span)
    n = len(digits)
    out = [f"shape:{name}" for name, p in SHAPES if p.match(span)] or ["shape:none"]
    out += [f"digits:{n if n < 4 else 4 if n < 7 else 7 if n < 10 else 10 if n < 14 else 14 if n < 20 else 20}", f"tokens:{min(tokens, 4)}"]
    if 13 <= n <= 19 and luhn(digits) and set(span) <= set("0123456789 -"):
        out.append("luhn")
    if "shape:iban" in out:
        s = span.replace(" ", "").upper()
        out.append("mod97" if 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else "no mod97")
    if "=" in span or '"' in span:
        out.append("assigned")
    cue = CUES.get(before.strip(".,:;()\"'").lower())
    return [*out, f"cue:{cue or 'none'}", *(f"{o}+{cue}" for o in out[:1] if cue)]


class Segments:
    """Candidate segments of a stretch of tokens: at[end] has (start, span start, span end, features)."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], hit: list[bool]) -> None:
        self.n = len(tokens)
        self.at: list[list[tuple[int, int, int, list[str]]]] = [[] for _ in range(self.n + 1)]
        run = [0]
        for h in hit:
            run.append(run[-1] + h)
        for end in range(1, self.n + 1):
            for start in range(end - 1, max(-1, end - 1 - MAX_TOKENS), -1):
                if run[end] == run[start]:
                    continue
                a, b = tokens[start][0], tokens[end - 1][1]
                if b - a > 120:
                    break
                span = text[a:b]
                a += len(span) - len(span.lstrip(EDGE_LEFT))
                b -= len(span) - len(span.rstrip(EDGE_RIGHT))
                if a >= b:
                    continue
                before = text[tokens[start - 1][0]:tokens[start - 1][1]] if start else ""
                self.at[end].append((start, a, b, features(text[a:b], before, end - start)))


def _plus(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -inf else a + log(1 + exp(b - a))


class Field:
    def __init__(self) -> None:
        self.w: dict[tuple[str, str], float] = {}

    def score(self, kind: str, feats: list[str]) -> float:
        w = self.w
        return sum(w.get((kind, f), 0.0) for f in feats) + w.get((kind, "bias"), -2.0)

    def decode(self, s: Segments) -> list[Span]:
        """The best segmentation: tokens outside score 0, bounded entities their weights."""
        best, back = [0.0] * (s.n + 1), [None] * (s.n + 1)
        for end in range(1, s.n + 1):
            best[end] = best[end - 1]
            for start, a, b, feats in s.at[end]:
                for kind in TYPES:
                    x = best[start] + self.score(kind, feats)
                    if x > best[end]:
                        best[end], back[end] = x, (start, kind, a, b)
        out, end = [], s.n
        while end:
            if back[end] is None:
                end -= 1
            else:
                start, kind, a, b = back[end]
                out.append((kind, a, b))
                end = start
        return out[::-1]

    def learn(self, s: Segments, gold: dict[tuple[int, int], str], rate: float) -> None:
        """One gradient step on the likelihood of gold: {(span start, span end): kind}."""
        scored = [[(start, a, b, feats, [self.score(k, feats) for k in TYPES]) for start, a, b, feats in row] for row in s.at]
        ahead = [0.0] + [-inf] * s.n
        for end in range(1, s.n + 1):
            ahead[end] = ahead[end - 1]
            for start, _, _, _, sc in scored[end]:
                for x in sc:
                    ahead[end] = _plus(ahead[end], ahead[start] + x)
        behind = [-inf] * s.n + [0.0]
        for end in range(s.n, 0, -1):
            behind[end - 1] = _plus(behind[end - 1], behind[end])
            for start, _, _, _, sc in scored[end]:
                for x in sc:
                    behind[start] = _plus(behind[start], behind[end] + x)
        total = ahead[s.n]
        for end in range(1, s.n + 1):
            for start, a, b, feats, sc in scored[end]:
                for kind, x in zip(TYPES, sc, strict=True):
                    g = (gold.get((a, b)) == kind) - exp(min(0.0, ahead[start] + x + behind[end] - total))
                    if abs(g) > 1e-3:
                        for f in (*feats, "bias"):
                            self.w[kind, f] = self.w.get((kind, f), -2.0 if f == "bias" else 0.0) * (1 - rate * 1e-3) + rate * g


def stretches(text: str) -> Iterator[tuple[list[tuple[int, int]], list[bool]]]:
    """Tokens (start, end) around triggers, and whether each has one. Far from triggers there's nothing to decide."""
    hits: list[tuple[int, int]] = []
    seen = -1
    for m in TRIGGER.finditer(text):
        if m.start() < seen:
            continue
        a, b = m.start(), m.end()
        while a and not text[a - 1].isspace():
            a -= 1
            if m.start() - a > 200:
                break
        t = TOKEN.match(text, a)
        b = max(b, t.end()) if t else b
        hits.append((a, b))
        seen = b
    k = 0
    while k < len(hits):
        last = k
        while last + 1 < len(hits) and hits[last + 1][0] - hits[last][1] < 200:
            last += 1
        low, high = max(0, hits[k][0] - 200), min(len(text), hits[last][1] + 200)
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, low, high)]
        flags, j = [], k
        for a, b in tokens:
            while j <= last and hits[j][1] <= a:
                j += 1
            flags.append(j <= last and hits[j][0] < b)
        yield tokens, flags
        k = last + 1


def sentence(rng: random.Random) -> tuple[str, dict[tuple[int, int], str]]:
    """A generated sentence with its entities."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    nz = lambda n: rng.choice("123456789") + d(n - 1)
    syl = ("an", "er", "tion", "ou", "ch", "le", "ver", "os", "ra", "th", "be", "ing", "ein", "que", "at", "dot")
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 3)))

    def card() -> str:
        s = rng.choice("345") + d(14)
        return next(s + c for c in "0123456789" if luhn(s + c))

    def iban() -> str:
        c, body = rng.choice(["DE", "FR", "ES", "GB", "NL"]), d(18)
        n = int("".join(str(int(x, 36)) for x in body + c + "00")) % 97
        s = f"{c}{98 - n:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[k:k + 4] for k in range(0, len(s), 4))

    host = lambda: f"{word()}.{rng.choice(['com', 'org', 'net', 'example.com'])}"
    at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("at", "dot"), (" at ", " dot ")])
    group = lambda s: " ".join(s[k:k + 4] for k in range(0, 16, 4))
    ip = lambda sep: sep.join(str(rng.randint(1, 255)) for _ in range(4))
    makers = {
        "email": [lambda: f"{word()}.{d(2)}@{host()}", lambda: f"{word()} {at.strip()} {word()} {dot.strip()} com", lambda: f"{word()}{at}{word()}{dot}org" if at.strip() != "at" else f"{word()} at {word()} dot org"],
        "ip": [lambda: ip("."), lambda: ip("[.]"), lambda: ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))],
        "card": [card, lambda: group(card())],
        "phone": [lambda: f"+1 ({nz(3)}) 555-{d(4)}", lambda: f"({nz(3)}) {nz(3)}-{d(4)}", lambda: f"{nz(3)}-{nz(3)}-{d(4)}", lambda: f"{nz(3)}.{nz(3)}.{d(4)}", lambda: f"+{nz(2)} {nz(3)} {d(3)} {d(4)}", lambda: f"00{nz(2)} {nz(3)} {d(6)[:3]} {d(3)}", lambda: f"0{nz(2)} {nz(4)} {d(4)}"],
        "ssn": [lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"],
        "iban": [iban],
    }
    others = [lambda: d(rng.randint(1, 20)), lambda: f"{nz(1)}.{d(1)}.", lambda: f"{nz(4)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{nz(2)}%", lambda: f"${nz(3)}.{d(2)}",
              lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"password={rng.getrandbits(72):018x}", lambda: f"\"{rng.getrandbits(160):040x}\"",
              lambda: f"{nz(1)}.{d(1)}.{d(1)}", lambda: f"{rng.randint(1, 12)}:{rng.randint(10, 59)}", lambda: f"{word()}@", lambda: f"{nz(3)}-{d(4)}", lambda: f"{word()}{d(3)}", lambda: f"{nz(2)} at {word()}", lambda: f"{rng.getrandbits(64):016x}"]
    parts: list[str] = []
    gold: dict[tuple[int, int], str] = {}
    length = 0
    for _ in range(rng.randint(4, 9)):
        r = rng.random()
        kind, s = None, word()
        if r < 0.22:
            kind = rng.choice(TYPES)
            s = rng.choice(makers[kind])()
            cues = [c for c, k in CUES.items() if k == kind]
            if rng.random() < 0.3:
                c = rng.choice(cues) + rng.choice(["", ":"])
                parts.append(c)
                length += len(c) + 1
        elif r < 0.5:
            s = rng.choice(others)()
        if kind:
            gold[length, length + len(s)] = kind
            s += rng.choice(["", "", "", ",", "."]) if kind != "ip" else ""
        parts.append(s)
        length += len(s) + 1
    return " ".join(parts), gold


@lru_cache(1)
def trained(sentences: int = 500, epochs: int = 4, seed: int = 6) -> Field:
    rng = random.Random(seed)
    field = Field()
    made = []
    for _ in range(sentences):
        text, gold = sentence(rng)
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        made.append((Segments(text, tokens, [bool(TRIGGER.search(text, max(0, a - 4), b)) for a, b in tokens]), gold))
    for e in range(epochs):
        rng.shuffle(made)
        for s, gold in made:
            field.learn(s, gold, 0.4 / (1 + e))
    return field


def all_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans)."""
    if not text:
        return [], []
    base = base_spans(text)
    more: list[Span] = []
    for tokens, hit in stretches(text):
        more += [s for s in field.decode(Segments(text, tokens, hit)) if not any(a < s[2] and s[1] < b for _, a, b in base)]
    return base, ordered(base + more)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base patterns), base_sha256, spans (all)."""
    small_batches(docs.sparkSession)
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [all_spans(t, field) for t in b.column(1).to_pylist()]
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([listed(every) for _, every in found], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def op6_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
