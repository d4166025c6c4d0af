"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into segments, coarse to fine; each keeps its mean and deviation.  For two vectors the inner product
of a segment of m components is at most m (mean * mean + deviation * deviation), and more segments bound it tighter:
with squared norms this is the familiar lower bound of the distance.  A block of queries goes through a group of vectors
chunk by chunk and carries each query's k-th best score along: the first chunk is scored, later ones only where the bounds
of one resolution after the other can still reach it.  Survivors of the finest are scored exactly, as integers.

Vectors are dealt to groups of bounded bytes, which are not copied; blocks of queries go to each group of their length.

Edge cases: a vector that is null or holds null or non-finite components takes no part, nor does one of another
length than the query's; a null vec_id takes no part; of equal scores the smaller vec_id wins; rows that repeat a
vec_id are queries and candidates of their own, each only without itself; fewer candidates than k give fewer rows; an
empty table gives none; other columns are ignored.  A component or a score that a long cannot hold is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arclake.llm.common import materialize, tidied

LEVELS = (1, 4, 16)
#: Bytes of a group of vectors and of a block of queries, and vectors of a chunk.
VECTOR_BYTES, QUERY_BYTES, CHUNK = 8 << 20, 1 << 19, 1024
#: Pairs of a query and a vector whose components are held at once.
PAIRS = 1 << 14
HITS = "query_row long, query_id long, vec_id long, score long"


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Per segment sqrt(m) * mean and sqrt(m) * deviation, so that the bound is a plain inner product."""
    out = []
    for part in np.array_split(v.astype(np.float64), segments, axis=1):
        m = part.shape[1] ** 0.5
        out += [m * part.mean(axis=1), m * part.std(axis=1)]
    return np.stack(out, axis=1)


class Exact:
    """Inner products of integer vectors: by floating-point where every sum fits in 53 bits, else by wider integers."""

    def __init__(self, q: np.ndarray, v: np.ndarray) -> None:
        self.most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
        self.kind = np.float64 if self.most < 2**53 else np.int64 if self.most < 2**62 else object

    def whole(self, out: np.ndarray) -> np.ndarray:
        if self.kind is object and out.size and max(abs(int(x)) for x in out.ravel()) >= 1 << 63:
            raise OverflowError("a score does not fit in a long")
        return out.astype(np.int64)

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.whole(a.astype(self.kind) @ b.astype(self.kind).T)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.whole((a.astype(self.kind) * b.astype(self.kind)).sum(axis=1))


def blocks(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs, ``PAIRS`` at a time; one empty block where there are none."""
    for at in range(0, max(1, len(i)), PAIRS):
        yield i[at : at + PAIRS], j[at : at + PAIRS]


class Best:
    """The k best (score, vec_id) of each query so far; ties to the smaller vec_id."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.query, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = (np.concatenate(pair) for pair in ((self.query, query), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, np.arange(self.n))
        keep = np.arange(len(query)) - first[query] < self.k
        self.query, self.ids, self.scores = query[keep], ids[keep], scores[keep]
        many = np.bincount(self.query, minlength=self.n)
        full = np.flatnonzero(many == self.k)
        self.least[full] = self.scores[np.cumsum(many)[full] - 1]


def best_of_group(q: np.ndarray, q_rows: np.ndarray, v: np.ndarray, v_ids: np.ndarray, v_rows: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS, chunk: int = CHUNK) -> Best:
    """The k best vectors of a group for each query of a block."""
    levels = tuple(s for s in levels if s <= q.shape[1]) or (1,)
    exact, best = Exact(q, v), Best(len(q), k)
    slack = 1e-6 * (1.0 + exact.most)
    of_queries = [statistics(q, s) for s in levels]
    for at in range(0, len(v), chunk):
        part, ids, other = v[at : at + chunk], v_ids[at : at + chunk], q_rows[:, None] != v_rows[at : at + chunk][None, :]
        if np.isinf(best.least).any():
            scores = exact.matrix(q, part)
            floor = np.partition(np.where(other, scores, scores.min(initial=0)), max(0, len(part) - k - 1), axis=1)[:, max(0, len(part) - k - 1)]
            i, j = np.nonzero(other & (scores >= floor[:, None]))
            best.add(i, ids[j], scores[i, j])
            continue
        of_part = [statistics(part, s) for s in levels]
        i, j = np.nonzero((of_queries[0] @ of_part[0].T >= best.least[:, None] - slack) & other)
        for a, b in zip(of_queries[1:], of_part[1:], strict=True):
            alive = np.concatenate([np.einsum("ij,ij->i", a[x], b[y]) >= best.least[x] - slack for x, y in blocks(i, j)])
            i, j = i[alive], j[alive]
        if len(i):
            best.add(i, ids[j], np.concatenate([exact.pairs(q[x], part[y]) for x, y in blocks(i, j)]))
    return best


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """Packs the rows of each (dim, block): ids, rows and data, in four bytes a component where they fit."""

    def pack(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        dim, block = (k.as_py() for k in key)
        data = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        data = data.astype("<i4") if len(data) and -(1 << 31) < data.min() and data.max() < 1 << 31 else data.astype("<i8")
        blobs = [part.column(c).to_numpy().astype("<i8").tobytes() for c in ("id", "row")] + [data.tobytes()]
        return pa.table({"dim": pa.array([dim], pa.int32()), f"{kind}_block": pa.array([block], pa.int32()), **{f"{kind}_{n}": pa.array([b], pa.binary()) for n, b in zip(("ids", "rows", "data"), blobs, strict=True)}})

    return rows.groupBy("dim", "block").applyInArrow(pack, f"dim int, {kind}_block int, {kind}_ids binary, {kind}_rows binary, {kind}_data binary")


def _scores(k: int):
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, *blobs = (batch.column(n)[i].as_py() for n in ("dim", "q_ids", "q_rows", "q_data", "v_ids", "v_rows", "v_data"))
                (q_ids, q_rows, q), (v_ids, v_rows, v) = (
                    (np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8"), np.frombuffer(data, f"<i{len(data) // (len(ids) // 8 * dim)}").reshape(-1, dim))
                    for ids, rows, data in (blobs[:3], blobs[3:])
                )
                best = best_of_group(q, q_rows, v, v_ids, v_rows, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_rows[best.query], q_ids[best.query], best.ids, best.scores)], ["query_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other vectors for every row that ``is_query`` marks."""
    x = F.col(embedding)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    integers = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    rows = vectors.filter(F.col(vec_id).isNotNull() & sound).select(F.col(vec_id).cast("long").alias("id"), integers.alias("v"), is_query.alias("is_query"), F.size(x).alias("dim"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    blocks = lambda n, most: F.ceil(n * F.col("dim") * 8 / most).cast("int")
    sizes = materialize(rows.groupBy("dim").agg(blocks(F.count(F.lit(1)), VECTOR_BYTES).alias("groups"), blocks(F.greatest(F.count_if("is_query"), F.lit(1)), QUERY_BYTES).alias("blocks")))
    dealt = rows.join(sizes, "dim")
    block = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int").alias("block")
    groups = _packed(dealt.select("dim", block("groups"), "id", "row", "v"), "v")
    queries = materialize(_packed(dealt.filter("is_query").select("dim", block("blocks"), "id", "row", "v"), "q"))
    met = queries.join(sizes, "dim").withColumn("v_block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).join(materialize(groups), ["dim", "v_block"])
    hits = met.select("dim", "q_ids", "q_rows", "q_data", "v_ids", "v_rows", "v_data").mapInArrow(_scores(k), HITS)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid AS rid, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.rid <> q.rid AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
