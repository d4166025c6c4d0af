"""Very long texts, and whole results against plain Python, operator by operator."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from arclake.llm import exactdedup, jaccard, langid, linededup, mixing, packing, secrets, substring
from arclake.llm.queries import tokenizer_path
from test_corpus import brute_pieces, slow_grams
from test_dedup import brute_components


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(31)
    text = " ".join(rng.choice("alpha beta gamma delta epsilon".split()) + str(rng.randrange(3000)) for _ in range(150_000))
    changed = text.split()
    for k in range(0, len(changed), 40_000):
        changed[k] = "changed"
    secret = "3ax6xnjp29jd6fds4gc373sgvjxteol0"
    texts = [text, " ".join(changed), text.upper(), text[:900_000] + f" password={secret} " + text[900_000:1_000_000], "short text", "x" * 700_000]
    return [(i, t, "en", f"o{i}/r", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame(long_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def test_long_texts(long_docs, long_rows):
    spans = {r["doc_id"]: r for r in secrets.scan_secrets(long_docs).collect()}
    assert spans[3]["base"] == "assign:900001:900042" and spans[4]["base"] == "" and spans[0]["n_assign"] == 0
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(long_docs).collect())
    assert got == Counter(brute_components(long_rows))
    kept = {r["doc_id"]: r for r in exactdedup.exact_dedup(long_docs).collect()}
    assert {i: r["keep_id"] for i, r in kept.items()} == {0: 2, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    removed = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(long_docs).collect()}
    words = [t.split() for _, t, *_ in long_rows]
    assert removed[0] == 0 and removed[1] == len(words[1]) - sum(w == "changed" for w in words[1]) and removed[2] == 0 and removed[3] > 100_000
    assert {r["doc_id"]: r["size"] for r in mixing.mix_sources(long_docs).collect()} == {i: len(w) for i, w in enumerate(words)}
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(long_docs).collect()} == {i: "en" for i in range(6)}
    assert {r["doc_id"]: r["n_near"] for r in linededup.line_dedup(long_docs).collect()} == {i: 0 for i in range(6)}


def test_long_texts_are_packed_whole(long_docs, long_rows):
    rows = long_rows[3:]
    got = packing.pack_documents(long_docs.filter("doc_id >= 3"), tokenizer_path()).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == brute_pieces(rows, 4096)


def brute_owners(rows, max_owners=2, max_repos=16):
    """Own and copied candidates of each row, and the places that are shown."""
    owners, repos = defaultdict(set), defaultdict(set)
    for _, t, _, s, *_ in rows:
        for *_, value in secrets.candidates(t) if t else ():
            owners[value].add((s or "").split("/")[0] if s is not None else None)
            repos[value].add(s)
    out = Counter()
    for i, t, *_ in rows:
        found = [(start, kind, stop, value, len(owners[value]) > max_owners or len(repos[value]) > max_repos) for kind, start, stop, value in (secrets.candidates(t) if t else ())]
        own = [not copied and secrets.looks_live(value) for *_, value, copied in found]
        shown = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for (a, k, b, *_), mine in zip(found, own, strict=True) if k < 3 or mine)
        out[(i, shown, sum(own), sum(c for *_, c in found))] += 1
    return out


def test_ownership_against_plain_counts(spark):
    rng = random.Random(6)
    values = ["".join(rng.choices("abcdefghjkmnpqrstuvwxyz23456789", k=rng.choice([24, 32]))) for _ in range(25)]
    forms = ["{}", "token={}", "password: '{}'", "x {} y", "AKIA" + "Q7" * 9 + " {}", "example {}"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(forms).format(rng.choice(values[: rng.choice([2, 25])])) for _ in range(rng.randrange(4)))
        rows.append((i, rng.choice([text, text, text, None]), None, rng.choice([None, *(f"o{a}/r{b}" for a in range(3) for b in range(8))]), 0))
    df = spark.createDataFrame([(i, t, s) for i, t, _, s, _ in rows], "doc_id long, text string, source string").repartition(4)
    got = secrets.scan_secrets(df).collect()
    assert Counter((r["doc_id"], r["spans"], r["n_owner_specific"], r["n_widely_copied"]) for r in got) == brute_owners(rows)


def test_languages_against_plain_profiles(spark):
    rng = random.Random(4)
    letters = {"aa": "abcdefgh ", "bb": "efghijkl ", "cc": "àéîõüßñ ab"}
    rows = [(i, "".join(rng.choices(letters[lang], k=rng.choice([0, 3, 40, 400]))), lang) for i in range(90) for lang in [rng.choice(list(letters))]]
    rows += [(90, None, "aa"), (91, "12 34", "bb"), (None, "efgh ijkl", "bb"), (92, "abab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    import zlib

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    top = lambda grams: [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[: langid.TOP]]
    totals = defaultdict(Counter)
    for i, t, lang in rows:
        if not held(i) and t is not None and lang is not None:
            totals[lang] += slow_grams(t)
    profiles = {lang: {g: r for r, g in enumerate(top(c))} for lang, c in totals.items() if c}
    want = {}
    for i, t, _ in rows:
        own = top(slow_grams(t or ""))
        costs = {k: sum(abs(p[g] - r) if g in p else langid.TOP for r, g in enumerate(own)) for k, p in profiles.items()}
        best = min(costs, key=lambda k: (costs[k], k))
        want[i] = (held(i), best, 1 - costs[best] / (langid.TOP * len(own))) if own else (held(i), "und", 0.0)
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    assert got.keys() == want.keys()
    for i, (h, lang, score) in want.items():
        assert got[i][:2] == (h, lang) and got[i][2] == pytest.approx(score)
