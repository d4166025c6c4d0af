"""Language ID by rank-order profiles: out-of-place distance between frequent n-grams.

A profile is a language's ``top`` most frequent n-grams (one to three letters, words padded with a blank), in order
of frequency.  A document's own most frequent n-grams, over its whole text, are compared with each profile: every
n-gram costs the difference of its two ranks, and ``top`` where the profile lacks it.

Profiles are fitted on a bounded sample: about ``per_language`` training documents of each language, chosen by a
hash of doc_id.  Prediction reads nothing but the text.

Edge cases: a null text, or one without letters, is ``und`` with score 0; a null doc_id is a training row whose
remainder is that of the empty text; ties between languages go to the first by code point, ties between n-grams to
the smaller code; without training rows all is ``und``; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arclake.llm.common import as_bytes, fresh, quoted, slices, tidied

TOP = 300
PER_LANGUAGE = 3000
MAX_LANGUAGES = 1000
UNKNOWN = "und"
#: Scores below it are of no learned language.
LEAST_SCORE = 0.2


class Grams:
    """Counts n-grams of whole texts by table look-ups; its tables do not grow with the input.

    The first ``LETTERS`` letters that a worker meets get small numbers, so that an n-gram is a place in a table of
    fixed size, and the n-grams met get the places of a list.  A text with further letters is counted by sorting.
    A code holds 21 bits a letter, with a blank (1) on either side of each run of letters.
    """

    LETTERS = 127

    def __init__(self) -> None:
        self.small = np.full(0x110000, -1, np.int16)  # 0: no letter, LETTERS + 1: beyond the table
        self.points = np.ones(self.LETTERS + 1, np.int64)
        self.known = 1
        base = self.LETTERS + 1
        self.offsets = (0, base, base + base**2)
        self.place = np.full(base + base**2 + base**3, -1, np.int32)
        self.codes = np.zeros(1024, np.int64)
        self.met = 0

    def _learn(self, points: np.ndarray) -> None:
        for p in np.unique(points[self.small[points] < 0]).tolist():
            if not chr(p).isalpha():
                self.small[p] = 0
            elif self.known <= self.LETTERS:
                self.points[self.known] = p
                self.small[p] = self.known
                self.known += 1
            else:
                self.small[p] = self.LETTERS + 1

    def _add(self, index: np.ndarray) -> None:
        base = self.LETTERS + 1
        for i in np.unique(index[self.place[index] < 0]).tolist():
            if self.met == len(self.codes):
                self.codes = np.concatenate((self.codes, np.zeros_like(self.codes)))
            n = 3 - (i < self.offsets[2]) - (i < self.offsets[1])
            rest, code = i - self.offsets[n - 1], 0
            for k in range(n):
                code |= int(self.points[rest % base]) << (21 * k)
                rest //= base
            self.codes[self.met] = code
            self.place[i] = self.met
            self.met += 1

    def count(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram codes of a whole text and how often each occurs, in no order."""
        points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        small = self.small[points]
        if len(small) and small.min() < 0:
            self._learn(points)
            small = self.small[points]
        if not small.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a = np.zeros(len(small) + 2, np.int64)
        if small.max() > self.LETTERS:
            a[:] = 1
            a[1:-1][small > 0] = points[small > 0]
            middle = a[1:-1] > 1
            pairs = (a[:-1] > 1) | (a[1:] > 1)
            return np.unique(np.concatenate((a[a > 1], (a[:-1] | a[1:] << 21)[pairs], (a[:-2] | a[1:-1] << 21 | a[2:] << 42)[middle])), return_counts=True)
        a[1:-1] = small
        base = self.LETTERS + 1
        two = a[:-1] + a[1:] * base
        three = (two[:-1] + a[2:] * base**2)[a[1:-1] > 0]
        index = np.concatenate((a[a > 0], two[two > 0] + self.offsets[1], three + self.offsets[2]))
        places = self.place[index]
        if places.min() < 0:
            self._add(index)
            places = self.place[index]
        counts = np.bincount(places)
        met = np.flatnonzero(counts)
        return self.codes[met], counts[met]


_GRAMS: list[Grams] = []


def text_grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not _GRAMS:
        _GRAMS.append(Grams())
    return _GRAMS[0].count(text)


def frequent(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent codes in order; equal counts by code."""
    if len(codes) > top:
        some = counts >= np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))[:top]]


@tidied
def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            total: dict[str, Counter[int]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), as_bytes(part.column("text")), strict=True):
                codes, counts = text_grams(text or b"")
                total.setdefault(lang, Counter()).update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
            rows = [(lang, g, n) for lang, grams in total.items() for g, n in grams.items()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["lang", "gram", "n"])


def fit_profiles(training: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", top: int = TOP, per_language: int = PER_LANGUAGE) -> dict[str, list[int]]:
    """Language -> its most frequent n-grams in order; from about ``per_language`` documents of each."""
    spark = training.sparkSession
    rows = training.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    shares = spark.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "lang string, share double")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.join(F.broadcast(shares), "lang").filter(place < F.col("share"))  # at most MAX_LANGUAGES rows
    grams = sample.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = grams.withColumn("rank", rank).filter(F.col("rank") <= top).orderBy("lang", "rank").collect()
    profiles: dict[str, list[int]] = {r["lang"]: [] for r in counts}
    for r in best:
        profiles[r["lang"]].append(r["gram"])
    return {k: v for k, v in profiles.items() if v}


def _predictor(profiles: dict[str, list[int]], top: int):
    langs = sorted(profiles)
    vocabulary = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    ranks = np.full((len(vocabulary) + 1, len(langs)), -1, np.int32)
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(vocabulary, np.array(profiles[lang], np.int64)), j] = np.arange(len(profiles[lang]))

    def predict(text: bytes | None) -> tuple[str, float]:
        codes, counts = text_grams(text or b"")
        if not len(codes) or not langs:
            return UNKNOWN, 0.0
        own = frequent(codes, counts, top)
        at = np.searchsorted(vocabulary, own)
        at[vocabulary[np.minimum(at, len(vocabulary) - 1)] != own] = len(vocabulary)
        there = ranks[at]
        cost = np.where(there < 0, top, np.abs(there - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0)
        best = int(np.argmin(cost))
        return langs[best], 1.0 - float(cost[best]) / (top * len(own))

    return predict


def predict_languages(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", top: int = TOP, out: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the predicted language and its score appended, under the names ``out``; no other column is read."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    place = docs.columns.index(text)

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(profiles, top)
        for batch in batches:
            found = [predict(x) for x in as_bytes(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], schema.names)

    plain = docs.select(*(c.alias(f"c{i}") for i, c in enumerate(quoted(docs))))  # whatever the names hold
    return plain.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    profiles = fit_profiles(docs.filter(~held_out(F.col(doc_id))), doc_id, text, lang)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return predict_languages(plain, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text is in a language that was learned, with all their columns.

    A text without letters goes, and one whose n-grams are so far from every profile that its score is below ``least``:
    other scripts and letter junk.  Prose of the learned languages scores twice that and more.
    """
    profiles = fit_profiles(docs.filter(~held_out(F.col(doc_id))), doc_id, text, lang)
    pred, score = fresh(docs, "lang_pred", "lang_score")
    found = predict_languages(docs, profiles, text, out=(pred, score))
    found = found.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= least))
    return found.select(*quoted(found, (pred, score)))
