"""Exact, near-copy, substring and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arclake.llm import common, exactdedup, graph, jaccard, linededup, substring

FOLD = str.maketrans(exactdedup.UPPER, exactdedup.LOWER)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("block_bytes", [4096, 7])
@pytest.mark.parametrize("mark", [F.xxhash64, lambda b: F.pmod(F.xxhash64(b), F.lit(3))], ids=["marks", "colliding"])
def test_exact_dedup(docs, rows, block_bytes, mark):
    got = exactdedup.exact_dedup(docs, block_bytes=block_bytes, mark=mark).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(FOLD)].append(i)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_keeps_columns(docs, rows, empty):
    kept = exactdedup.keep_distinct(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(t or "").translate(FOLD) for _, t, *_ in rows})
    assert exactdedup.exact_dedup(empty).count() == 0


def sets_of(rows):
    out = []
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(FOLD))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute_components(rows):
    sets = sets_of(rows)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b, (_, t) in enumerate(sets[:a]):
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                parent[root(a)] = root(b)
    names = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            names[root(a)] = min(i, names.get(root(a), i))
    return [(i, len(s), names.get(root(a))) for a, (i, s) in enumerate(sets)]


def test_jaccard_components(docs, rows, empty):
    got = jaccard.jaccard_components(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows))
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    want = {c for _, n, c in brute_components(rows) if c is not None}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == want
    assert jaccard.jaccard_components(empty).count() == 0


def test_one_document_of_each_component_stays(spark):
    one, other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in ("a", "b", "c"))
    rows = [(1, one), (1, other), (2, one + " more"), (3, other + " more"), (None, third), (None, third + " more")]
    kept = [tuple(r) for r in jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 3 and {(1, one), (1, other)} <= set(kept)
    assert {kept_text for i, kept_text in kept if i is None} <= {third, third + " more"}


def test_cross_pairs_lose_no_link():
    rng = random.Random(3)
    sets = []
    for _ in range(40):
        base = rng.sample(range(1000), rng.randrange(1, 60))
        sets.append(set(base))
        for _ in range(rng.randrange(3)):
            other = set(base)
            for _ in range(rng.randrange(1, 9)):
                other ^= {rng.randrange(1000)}
            if other:
                sets.append(other)
    columns = ([], [], [], [], [])
    for i, s in enumerate(sets):
        order = sorted(s)
        for p, token in enumerate(order[: jaccard.prefix_length(len(s))]):
            for c, v in zip(columns, (token, i, len(s), len(s), len(s) - p), strict=True):
                c.append(v)
    kinds = (np.uint64, np.int64, np.int32, np.int32, np.int32)
    for block in (3, 2048):
        found = set(map(tuple, jaccard.star_pairs(*(np.array(c, k) for c, k in zip(columns, kinds, strict=True)), block=block).tolist()))
        marks = [jaccard.marks_of(np.array(sorted(s)[: jaccard.prefix_length(len(s))], np.uint64).tobytes()) for s in sets]
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    assert (b, a) in found and jaccard.may_link(len(sets[a]), marks[a], len(sets[b]), marks[b])


def thue_morse(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return bits, [1 - b for b in bits]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_regular_words_and_runs_do_not_collide(n):
    one, other = ("".join("ab"[b] for b in bits).encode() for bits in thue_morse(n))
    a, b = jaccard.shingle_sets([one, other])
    assert a.tolist() != b.tolist()
    one, other = (b" ".join((b"x", b"y")[b] for b in bits) for bits in thue_morse(n))
    h, _ = common.hash_words([one])
    g, _ = common.hash_words([other])
    assert set(common.rolling(h, n).tolist()).isdisjoint(common.rolling(g, n).tolist())


def test_words_of_long_texts(monkeypatch):
    rng = random.Random(9)
    text = b"".join(rng.choice([b" ", b"\n", b"word", b"w" * 300, b"\xc3\xa9"]) for _ in range(4000))
    whole = common.word_prints([text, None, b"", b"one"])
    monkeypatch.setattr(common, "CHUNK", 64)
    cut = common.word_prints([text, None, b"", b"one"])
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and whole[1].tolist()[1:] == [0, 0, 1] and whole[1][0] == len(text.split())


def test_links_between_members_of_stars(spark):
    """Stars whose leaders are too far apart, and chains of near copies that only their members join."""
    rng = random.Random(12)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for step in range(10):
            for _ in range(4):
                own = list(base)
                for _ in range(rng.randrange(3)):
                    own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
                rows.append((len(rows), " ".join(own)))
            base = base[rng.randrange(4, 14) :] + [f"w{rng.randrange(10**6)}" for _ in range(8)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000 + i, 2000) for i in range(80)] + [(5000, 5000)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(80)}, 2000: 1000}


@pytest.mark.parametrize(("window", "hot"), [(50, substring.HOT), (50, 2), (4, substring.HOT), (4, 1)])
def test_remove_repeats(docs, rows, empty, window, hot):
    first = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, substring.LAST), substring.LAST if i is None else i)
    want = Counter()
    for i, t, *_ in rows:
        w, own = WORD.findall(t or ""), substring.LAST if i is None else i
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < own:
                gone[s : s + window] = [True] * window
        want[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    got = substring.remove_repeats(docs, window=window, hot=hot).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == want
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(WORD.findall(t or ""))
    for r in got:
        for start, stop, owner, at in r["repeats"]:
            own, other = texts[r["doc_id"]], [t for t in texts[owner]]
            run = [(w, o) for w in own for o in other if w[start:stop] == o[at : at + stop - start] and stop <= len(w)]
            assert run and stop - start >= window
            # maximal towards its owner: it goes on nowhere, unless a smaller document has the next window
            assert any(len(w) == stop or len(o) == at + stop - start or w[stop] != o[at + stop - start] or first[tuple(w[stop - window + 1 : stop + 1])] != owner for w, o in run)
    assert substring.remove_repeats(empty).count() == 0


def test_repeats_of_regular_texts(spark):
    """Texts that repeat themselves, Thue-Morse words, and a passage that every document has."""
    bits, others = thue_morse(256)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = ["a " * 300, "a " * 120, " ".join("xy"[b] for b in bits), " ".join("xy"[b] for b in others), *(f"q{i} {passage} r{i}" for i in range(30))]
    rows = list(enumerate(texts))
    first = {}
    for i, t in rows:
        w = t.split()
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    for hot in (substring.HOT, 3):
        got = {r["doc_id"]: r for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).collect()}
        for i, t in rows:
            w = t.split()
            gone = {s + k for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for k in range(50)}
            assert got[i]["n_removed"] == len(gone) and got[i]["kept"].split() == [x for k, x in enumerate(w) if k not in gone]
        assert [list(x) for x in got[20]["repeats"]] == [[1, 71, 4, 1]]


def distance_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_lines(rows, least=16):
    """Occurrences are told apart by their row; of equal places the result may keep any one, so counts are compared."""
    first = {}
    place = lambda i, at: (i is None, i or 0, at)
    for i, t in rows:
        for at, line in enumerate((t or "").split("\n") if t is not None else []):
            if re.search(r"\S", line, re.ASCII):
                first[line] = min(first.get(line, (True, 1 << 63, 0)), place(i, at))
    near = {a for a in first if any(first[b] < first[a] and a != b and max(len(a), len(b)) >= least and distance_within_one(a, b) for b in first)}
    out, kept = Counter(), set()
    for i, t in rows:
        own = t.split("\n") if t is not None else []
        near_at = [at for at, x in enumerate(own) if x in near]
        equal = [at for at, x in enumerate(own) if x in first and x not in near and (first[x] != place(i, at) or x in kept)]
        kept.update(x for at, x in enumerate(own) if x in first and x not in near and first[x] == place(i, at))
        out[(i, len(own), len(equal), len(near_at), tuple(sorted(equal + near_at)))] += 1
    return out


def found_lines(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_equal"], r["n_near"], tuple(r["removed"])) for r in linededup.line_dedup(df).collect())


def test_line_dedup(spark, docs, rows, empty):
    assert found_lines(docs) == brute_lines([r[:2] for r in rows])
    assert linededup.line_dedup(empty).count() == 0


def test_line_dedup_finds_every_single_edit(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choices("ab é", k=rng.choice([3, 14, 15, 16, 17, 31, 48, 130, 382, 383, 384, 385, 400, 512, 900, 17000]))) for _ in range(60)]
    for line in list(lines):
        k = rng.randrange(len(line) + 1)
        lines.append(rng.choice([line[:k] + line[k + 1 :], line[:k] + "x" + line[k:], line[:k] + "y" + line[k + 1 :], line]))
        lines.append(lines[-1][: len(lines[-1]) // 2] + "zz" + lines[-1][len(lines[-1]) // 2 :])
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 6 : i * 6 + 6])) for i in range(30)]
    assert found_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute_lines(rows)


def test_short_lines_are_near_from_their_bound_on(spark):
    rows = [(1, "abcdefghijklmno"), (2, "abcdefghijklmnop"), (3, "cat"), (4, "bat"), (5, "abcdefghijklmnx"), (6, "abcd"), (7, "abcde")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_lines(df) == brute_lines(rows)
    for least in (1, 5):
        got = Counter((r["doc_id"], r["n_lines"], r["n_equal"], r["n_near"], tuple(r["removed"])) for r in linededup.line_dedup(df, least=least).collect())
        assert got == brute_lines(rows, least)


def test_one_of_equal_places_stays(spark):
    rows = [(None, "the same line of text"), (None, "the same line of text"), (4, "another line of text here"), (4, "another line of text here"), ((1 << 63) - 1, "the same line of text")]
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_equal"] for r in got) == 3 and [r["n_equal"] for r in got if r["doc_id"] == (1 << 63) - 1] == [0]


@pytest.mark.parametrize("n", [50_000, 5_000_000])
def test_very_long_lines_take_linear_work(spark, n):
    rng = random.Random(8)
    line = "".join(rng.choices("abcdef ", k=n))
    rows = [(1, line), (2, line[: n // 2] + "x" + line[n // 2 + 1 :]), (3, line[:-7] + line[-6:])]
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_near"] for r in got} == {1: 0, 2: 1, 3: 1}
