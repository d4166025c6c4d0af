"""Benchmark statistics and evidence relations: ratios, dispersion, confidence, gates, applicability."""

from __future__ import annotations

import random
import statistics

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the bootstrap.
SEED, RESAMPLES = 32011, 10_000
MIB = 1 << 20


def median_and_dispersion(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, and median absolute deviation over the median's size; two exact aggregates."""
    middle = rows.groupBy(*by).agg(F.percentile(F.col(value), 0.5).alias("median"))
    far = rows.join(middle, by).withColumn("far", F.abs(F.col(value) - F.col("median")))
    return far.groupBy(*by).agg(F.first("median").alias("median"), (F.percentile("far", 0.5) / F.abs(F.first("median"))).alias("dispersion"))


def linear_percentile(value: Column, fraction: float) -> Column:
    """Interpolates neighbouring order statistics."""
    return F.percentile(value, fraction)


def bootstrap_ci(ratios: DataFrame, by: str, value: str, seed: int = SEED, resamples: int = RESAMPLES) -> DataFrame:
    """95 % interval of the median by seeded resampling; a group is one gate's seven to thirty rounds."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        own = [float(x) for x in part.sort_values("round")[value]]
        rng = random.Random(seed)
        draws = sorted(statistics.median(rng.choices(own, k=len(own))) for _ in range(resamples))

        def at(fraction: float) -> float:
            place = (len(draws) - 1) * fraction
            low = int(place)
            high = min(low + 1, len(draws) - 1)
            return draws[low] + (draws[high] - draws[low]) * (place - low)

        return pd.DataFrame({by: [key[0]], "low": [at(0.025)], "high": [at(0.975)]})

    kind = ratios.schema[by].dataType.simpleString()
    return ratios.select(by, "round", value).groupBy(by).applyInPandas(run, f"{by} {kind}, low double, high double")


def gate_outcomes(gates: DataFrame, by: list[str]) -> DataFrame:
    """INVALID beats FAIL beats PASS."""
    rank = F.when(F.col("outcome") == "INVALID", 2).when(F.col("outcome") == "FAIL", 1).otherwise(0)
    names = F.array(F.lit("PASS"), F.lit("FAIL"), F.lit("INVALID"))
    return gates.groupBy(*by).agg(F.element_at(names, F.max(rank) + 1).alias("outcome"))


def paired_ratios(candidate: DataFrame, oracle: DataFrame, on: list[str]) -> DataFrame:
    """Oracle seconds over candidate seconds, round by round."""
    return candidate.join(oracle, on).withColumn("ratio", F.col("oracle_seconds") / F.col("candidate_seconds"))


def throughput(n_bytes: Column, seconds: Column) -> Column:
    return n_bytes / F.lit(float(MIB)) / seconds


def rotation(round_: Column, n: int) -> Column:
    """Which comparator leads a round."""
    return F.pmod(round_, F.lit(n))


def applicable(scenarios: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Scenario and capability meet by family or by a common tag: two equi-joins and a distinct, not a product."""
    by_family = scenarios.select("scenario", F.explode("families").alias("family")).join(capabilities.select("capability", "family"), "family")
    by_tag = scenarios.select("scenario", F.explode("tags").alias("tag")).join(capabilities.select("capability", F.explode("tags").alias("tag")), "tag")
    return by_family.select("scenario", "capability").union(by_tag.select("scenario", "capability")).distinct()


def missing_and_foreign(selected: DataFrame, results: DataFrame, key: str) -> DataFrame:
    missing = selected.select(key).distinct().join(results, key, "left_anti").withColumn("kind", F.lit("missing"))
    foreign = results.select(key).distinct().join(selected, key, "left_anti").withColumn("kind", F.lit("foreign"))
    return missing.unionByName(foreign)


def impacted(paths: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Lanes a changed path selects; a path no rule knows selects the full lane."""
    lanes = F.filter(F.array(*[F.when(F.col("path").rlike(p), F.lit(lane)) for p, lane in rules]), lambda x: x.isNotNull())
    return paths.withColumn("lanes", F.when(F.size(lanes) > 0, F.array_sort(F.array_distinct(lanes))).otherwise(F.array(F.lit("full"))))




def size_ratio(decoded: Column, stored: Column) -> Column:
    """Decoded over stored bytes; null where nothing is stored."""
    return F.when(stored > 0, decoded / stored)


def peak(value: str) -> Column:
    return F.max(value)


def scaling(one: Column, many: Column, workers: Column) -> Column:
    """Efficiency of ``workers``: time of one over time of many, a worker."""
    return one / workers / many


def canonical_json(columns: list[str]) -> Column:
    """Sorted keys, no blanks; null fields are kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def canonical_digests(rows: DataFrame, by: list[str], columns: list[str], order: str) -> DataFrame:
    """SHA-256 of each group's records as one canonical JSON array; a group is a capsule's section, a few thousand records."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), canonical_json(columns).alias("j"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["j"]), ","), F.lit("]"))
    return rows.groupBy(*by).agg(F.sha2(text, 256).alias("digest"))
