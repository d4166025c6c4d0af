from __future__ import annotations

import corpus_pipeline
from arclake.llm import langid
from arclake.llm.common import materialize
from arclake.llm.queries import tokenizer_path
from test_corpus import brute_pieces, check_packing
from test_dedup import FOLD, brute_components


def test_stages_against_brute_force(spark, docs, rows):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_jaccard", "mix", "pack"]
    stages = dict(corpus_pipeline.STAGES)
    own = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)

    known = materialize(stages["language_id"](spark, docs, ""))
    assert known.columns == docs.columns
    profiles = langid.fit_profiles(docs.filter(~langid.held_out(docs["doc_id"])))
    predict = langid._predictor(profiles, langid.TOP)
    lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and predict(r[1].encode())[1] >= langid.LEAST_SCORE]
    assert len(lettered) > 0.9 * sum(bool(r[1] and r[1].strip()) for r in rows)
    assert sorted(own(known), key=repr) == sorted(lettered, key=repr)

    distinct = materialize(stages["exact_dedup"](spark, known, ""))
    best = {}
    for r in lettered:
        k = r[1].translate(FOLD)
        best[k] = max(best.get(k, r), r, key=key)
    assert sorted(own(distinct), key=repr) == sorted(best.values(), key=repr)

    first = materialize(stages["ngram_jaccard"](spark, distinct, ""))
    rest = list(best.values())
    want = [r for r, (i, _, c) in zip(rest, brute_components(rest), strict=True) if i == c]
    assert sorted(own(first), key=repr) == sorted(want, key=repr)

    mixed = materialize(stages["mix"](spark, first, ""))
    size = sum(len(r[1].split()) for r in want)
    assert abs(sum(len(r[1].split()) for r in own(mixed)) - size) <= 0.1 * size
    assert set(own(mixed)) <= set(want)

    packed = stages["pack"](spark, mixed, "").collect()
    check_packing(packed, 4096)
    assert sum(brute_pieces(own(mixed), 4096).values()) == len(packed)
    assert tokenizer_path()


def test_an_empty_table_goes_through(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""))
        assert docs.columns == empty.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
