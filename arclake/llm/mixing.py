"""Mixing sources to target weights by subset-sum budget fitting.

Words are counted per document; a histogram of (source, exact length) is all the planner sees.  Each source takes
whole repeats of all its documents while they fit its target; the budget that remains is a subset-sum problem over
lengths.  Greedy proportional fill leaves a budget of a few long documents, which bounded-knapsack dynamic
programming fits exactly, and documents are then selected by seeded order within their length.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; repeated rows are
documents of their own; ties between equal lengths fall by seeded hash; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arclake.llm.common import as_bytes, fresh, materialize, quoted, ranked, row_key, slices, tidied

#: Places of the table of sums; for sources whose longest document has more words, sums are kept in steps of several.
SUMS = 1 << 22


def water_level(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> float:
    """Words a unit of weight gets when ``total`` is shared by weight and no share passes ``most`` times its size."""
    order = np.argsort(most * sizes / weights, kind="stable")
    sizes, weights = sizes[order].astype(float), weights[order].astype(float)
    left = total - most * np.concatenate(([0.0], np.cumsum(sizes)))[:-1]  # if all before are full
    weight = weights[::-1].cumsum()[::-1]
    open_ = np.flatnonzero(left / weight <= most * sizes / weights)
    return float(left[open_[0]] / weight[open_[0]]) if len(open_) else float("inf")


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; a share stops at ``most`` times its size and the excess is shared again."""
    if not sizes:
        return []
    level = water_level(np.array(sizes), np.array(weights), float(total), most)
    return [min(float(most * s), level * w) for s, w in zip(sizes, weights, strict=True)]


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths come as near to ``budget`` as can be.

    A proportional share of every length first, then the longest that fit while the rest is more than twice the
    longest length, then bounded-knapsack dynamic programming over that rest, which may end above it by less than
    the longest length if that is nearer.
    """
    take = np.zeros(len(lengths), np.int64)
    useful = lengths > 0
    total = int((lengths * counts)[useful].sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        take[useful] = counts[useful]
        return take
    take[useful] = (counts[useful].astype(object) * budget // total).astype(np.int64)
    rest = budget - int((lengths * take).sum())
    window = 2 * int(lengths.max())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= window:
            break
        if lengths[i]:
            more = min(int(counts[i] - take[i]), (rest - window) // int(lengths[i]) + 1, rest // int(lengths[i]))
            take[i] += more
            rest -= more * int(lengths[i])
    return take + nearest_sum(lengths, np.where(useful, counts - take, 0), rest)


def nearest_sum(lengths: np.ndarray, counts: np.ndarray, rest: int, places: int = SUMS) -> np.ndarray:
    """Bounded-knapsack dynamic programming: copies of each length whose sum is nearest to ``rest``.

    Copies go in powers of two.  Each reachable sum keeps the first item that reaches it, in a table of ``places`` at most.
    """
    take = np.zeros(len(lengths), np.int64)
    most = rest + int(lengths.max())
    step = -(-(most + 1) // places)
    goal, width = rest // step, most // step + 1
    items: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(counts > 0).tolist():
        left, copies = min(int(counts[i]), most // int(lengths[i])), 1
        while left > 0:
            copies = min(copies, left)
            items.append((i, copies, max(1, round(copies * int(lengths[i]) / step))))
            left -= copies
            copies *= 2
    origin = np.full(width, -1, np.int32)
    mask, reached = (1 << width) - 1, 1
    for k, (_, _, weight) in enumerate(items):
        new = (reached << weight) & mask & ~reached
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(width // 8 + 1, "little"), np.uint8), bitorder="little")
            origin[np.flatnonzero(bits[:width])] = k
            reached |= new
        if reached >> goal & 1:
            break
    at = (reached & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reached >> (goal + 1)
    if above and (beyond := (above & -above).bit_length()) < goal - at:
        at = goal + beyond
    while at > 0:
        i, copies, weight = items[origin[at]]
        take[i] += copies
        at -= weight
    return take


@tidied
def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            n = pa.array([len(x.split()) if x else 0 for x in as_bytes(part.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("key"), n], ["doc_id", "source", "key", "size"])


@tidied
def _quotas(table: pa.Table) -> pa.Table:
    """One source's histogram: how many documents of each length the rest of its target takes."""
    table = table.sort_by("size")
    lengths, counts = table.column("size").to_numpy(), table.column("n").to_numpy()
    quota = fit_budget(lengths, counts, table.column("budget")[0].as_py())
    return pa.table({"source": table.column("source"), "size": table.column("size"), "quota": pa.array(quota, pa.int64())})


def source_plan(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source: its target, the whole repeats it takes, and the budget that is left; any number of sources.

    Sources are numbered in their order partition by partition.  The water level is found by aggregates: at a level,
    sources that are full give theirs, and the rest of the words over the rest of the weight is the next level, until no
    more sources are full.
    """
    ordered = totals.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").sortWithinPartitions("last", "source")
    ordered = materialize(ordered.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)))
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("many"))  # one row for each partition of sources
    parts = parts.select("part", F.coalesce(F.sum("many").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    number = F.col("first") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    placed = materialize(ordered.join(parts, "part").select("source", "source_size", F.get(cycle, (number % len(weights)).cast("int")).alias("weight")))
    full = F.col("source_size") * most
    total = share * float(placed.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1.0
    while level > before:
        stopped = full < F.lit(level) * F.col("weight")
        given, weight = placed.agg(F.sum(F.when(stopped, full)), F.sum(F.when(~stopped, F.col("weight")))).first()
        level, before = (total - float(given or 0)) / weight if weight else float("inf"), level
    target = F.least(full.cast("double"), F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(math.floor(most)))).otherwise(0).cast("long")
    left = F.least(F.bround(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"), F.col("source_size"))
    rows = placed.withColumn("target", F.coalesce(target, F.lit(0.0))).withColumn("whole", whole)
    return rows.select(F.col("source").alias("p_source"), "source_size", "target", "whole", F.when(F.col("whole") >= most, 0).otherwise(left).cast("long").alias("budget"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3, seed: int = 17) -> DataFrame:
    """Words each document gives to the mix.

    Sources in code-point order (null last) get ``weights`` in turn and share ``share`` of all words; a target stops
    at ``most`` times its source's size.  Returns doc_id, source, size, source_size, target, repeats, taken.
    """
    own = F.col(doc_id).cast("long")
    plain = docs.select(own.alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"), row_key(own, F.col(text)).alias("key"))
    sized = materialize(plain.mapInArrow(_sizes, "doc_id long, source string, key binary, size long")).withColumn("h", F.xxhash64(F.lit(seed), "key"))
    hist = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    plan = materialize(source_plan(hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, most))
    planned = hist.join(plan, hist["source"].eqNullSafe(plan["p_source"]))
    quotas = planned.select("source", "size", "n", "budget").groupBy("source").applyInArrow(_quotas, "source string, size long, quota long")
    quotas = quotas.filter("quota > 0").select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), "quota")
    quotas = materialize(quotas)
    numbered = ranked(sized, ["source", "size"], ["h", "key"], F.col("h"))
    fits = numbered["source"].eqNullSafe(quotas["q_source"]) & (numbered["size"] == quotas["q_size"])
    chosen = numbered.join(quotas, fits, "left").join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    repeats = F.col("whole") + F.when(F.col("rank") < F.coalesce("quota", F.lit(0)), 1).otherwise(0)
    return chosen.select("doc_id", "source", "size", "source_size", "target", repeats.cast("long").alias("repeats"), (F.col("size") * repeats).cast("long").alias("taken"), "key")


def take_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns.

    Rows are joined by 128 bits of doc_id and text; only rows that are repeated are numbered, to share their takes.
    """
    own, key, all_, rows, times = fresh(docs, "own", "key", "all", "rows", "times")
    taken = mix_sources(docs, doc_id, text, source, seed=seed, **how)
    taken = materialize(taken.groupBy(F.col("key").alias(key)).agg(F.sum("repeats").alias(all_), F.count(F.lit(1)).alias(rows)).filter(F.col(all_) > 0))
    keyed = docs.withColumn(own, row_key(F.col(doc_id).cast("long"), F.col(text)))
    single = keyed.join(taken.filter(F.col(rows) == 1), F.col(own) == F.col(key)).withColumn(times, F.col(all_))
    if not taken.filter(F.col(rows) > 1).isEmpty():
        several = keyed.join(taken.filter(F.col(rows) > 1), F.col(own) == F.col(key))
        place = F.row_number().over(Window.partitionBy(own).orderBy(own))
        single = single.unionByName(several.withColumn(times, F.floor(F.col(all_) / F.col(rows)) + F.when(place <= F.col(all_) % F.col(rows), 1).otherwise(0)))
    copies = F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(own + "_copy")
    repeated = single.filter(F.col(times) > 0).select(*quoted(single, (own, key, all_, rows, times)), copies)
    return repeated.select(*quoted(repeated, (own + "_copy",)))
