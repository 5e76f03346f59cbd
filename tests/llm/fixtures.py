"""Small tables with the awkward cases, and where the supplied tables are."""

import os
import random

SF = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, fp string, uid string, digest string, score string, kept string, n string, copies string, p string, key string"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "ou", "ion", "ble", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(seed=1):
    """(doc_id, text, source): nulls, blanks, repeats, ties, a long text, copies and near copies."""
    rng = random.Random(seed)
    base = [words(rng, 80) for _ in range(6)]
    near = base[0].split()
    near[40] = "changed"
    out = [(k, t, f"s{k % 3}") for k, t in enumerate(base)]
    out += [(10, base[0], "s0"), (11, base[0].replace(" ", "  \t", 5), "s1"), (12, " ".join(near), "s1"), (13, None, "s0"), (14, "", None), (15, " \n\t ", "s2"), (16, None, None),
            (17, words(rng, 6000), "s0"), (18, "one two", "s1"), (18, "one two", "s1"), (None, base[1], "s2"), (None, "null id", "s2"), (19, "x" * 3000, "s2"), (20, "Ünï ▁  🙂\nzwei", "s0"), (20, "same id, other text", "s0")]
    return out


def table(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *["clash"] * 10) for i, t, s in data], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, data, schema="doc_id bigint, quality int, toxic int"):
    return spark.createDataFrame(data, schema)
