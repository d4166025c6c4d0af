"""Connected components of an edge table, by alternating stars.

Edges are first contracted inside each partition, so what is shuffled is close to a forest; large-star and small-star
steps then join every node to the smallest of its component.  Each step groups by a node with partial aggregation and
joins on it, so a node with very many neighbours is split by the skew join; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclake.llm.common import materialize, tidied

EDGES = "u long, v long"


@tidied
def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a batch with the smallest it is joined to there."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        columns = list(zip(*pairs, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node that has an edge, and the smallest node of its component."""
    now = materialize(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").mapInArrow(_contract, EDGES).distinct())
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large)
        down = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(down.select("u", F.col("m").alias("v"))).distinct())
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
