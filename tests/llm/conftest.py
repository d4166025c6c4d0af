from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, row long, bucket int, name string, node long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "Iota", "kappa"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, repeated rows, near copies, shared passages, and columns with clashing names."""
    rng = random.Random(7)
    base, passage = words(rng, 90), words(rng, 70)
    texts = [None, "", " \t\n", "one two", "One Two", "ÉCOLE école", "école École", base, base.upper(), base, words(rng, 3000)]
    for _ in range(14):
        w = base.split()
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(9))
        texts.append(" ".join(w))
    texts += [words(rng, rng.randrange(5, 60)) + "\n" + passage + "\n" + words(rng, rng.randrange(40)) for _ in range(8)]
    texts += [words(rng, rng.randrange(1, 200)) for _ in range(20)]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a/x", "a/y", "b", None]), 0) for i, t in enumerate(texts)]
    out += [out[7], out[12], (None, "no id here", "en", "b", 0), (None, None, None, None, None)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, -1, -1, -1, -1, "x", -1) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
