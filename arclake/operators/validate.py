"""Set-based validation: overlaps, duplicates, trailing data, dispositions, failures and bounded retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Diagnostics that only warn; any other warning makes an archive noncanonical.
WARN_ONLY = (
    "archive-name.absolute-path", "archive-name.traversal-segment", "archive-name.windows-invalid-segment", "tes3.payload-offset-over-signed-2gib", "tes3.unsupported-asset-root",
    "bsa.payload-offset-over-signed-2gib", "bsa.nontexture-with-embedded-name", "bsa.uncompressed-sse-embedded-name", "bsa.cubemap-without-embedded-name",
)


def overlaps(spans: DataFrame, by: list[str], start: str = "start", end: str = "stop") -> DataFrame:
    """Spans that begin inside an earlier one; equal spans may be shared and empty ones reference nothing.

    Distinct spans are compared with the furthest end before them, so one pass of a window finds every offender.
    """
    own = spans.filter(F.col(end) > F.col(start)).select(*by, start, end).distinct()
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("reached", F.max(end).over(before)).filter(F.col("reached") > F.col(start))


def reserved_overlaps(spans: DataFrame, region: DataFrame, by: list[str], start: str = "start", end: str = "stop") -> DataFrame:
    """Spans that touch their archive's reserved region (region_start, region_stop)."""
    return spans.join(region, by).filter((F.col(start) < F.col("region_stop")) & (F.col(end) > F.col("region_start")) & (F.col(end) > F.col(start)))


def trailing(spans: DataFrame, sizes: DataFrame, by: list[str], empty_counts: bool, start: str = "start", end: str = "stop") -> DataFrame:
    """Bytes after the furthest end used; whether empty spans count as used depends on the family."""
    used = F.col(end) if empty_counts else F.when(F.col(end) > F.col(start), F.col(end)).otherwise(0)
    return spans.groupBy(*by).agg(F.max(used).alias("used")).join(sizes, by).withColumn("trailing", F.col("size") - F.col("used"))


def duplicates(entries: DataFrame, by: list[str], key: str = "identity") -> DataFrame:
    return entries.filter(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def dispositions(archives: DataFrame, diagnostics: DataFrame, by: str = "path") -> DataFrame:
    """CONFORMING, TOLERATED_NONCANONICAL or REJECTED, from the worst diagnostic."""
    weight = F.when(F.col("severity") == "ERROR", 2).when(F.col("id").isin(*WARN_ONLY), 0).otherwise(1)
    worst = diagnostics.groupBy(by).agg(F.max(weight).alias("worst"), F.count(F.lit(1)).alias("diagnostics"))
    names = F.array(F.lit("CONFORMING"), F.lit("TOLERATED_NONCANONICAL"), F.lit("REJECTED"))
    return archives.join(worst, by, "left").select(by, F.element_at(names, F.coalesce("worst", F.lit(0)) + 1).alias("disposition"), F.coalesce("diagnostics", F.lit(0)).alias("diagnostics"))


def failure_order(phase: str = "phase", ordinal: str = "ordinal", id_: str = "id", location: str = "location") -> list[Column]:
    return [F.asc(phase), F.asc_nulls_last(ordinal), F.asc(id_), F.asc_nulls_last(location)]


def primary_failure(failures: DataFrame, by: list[str]) -> DataFrame:
    """The first failure by phase, ordinal, id and location, absent values last; a cancellation is never displaced."""
    absent = lambda c: F.struct(F.col(c).isNull().alias("absent"), F.col(c).alias("value"))
    key = F.struct((F.col("kind") != "CANCELLED").alias("later"), F.col("phase"), absent("ordinal").alias("o"), F.col("id"), absent("location").alias("l"))
    return failures.groupBy(*by).agg(F.min_by(F.struct("kind", "phase", "ordinal", "id", "location"), key).alias("f")).select(*by, "f.*")


def retain(diagnostics: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group in failure order; where more exist, the last is a count of the others."""
    order = failure_order()
    ranked = diagnostics.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    keep = F.when(F.col("n") > most, most - 1).otherwise(most)
    kept = ranked.filter(F.col("place") <= keep).select(*by, "place", "id", F.lit(None).cast("long").alias("omitted"))
    more = ranked.filter((F.col("place") == most) & (F.col("n") > most)).select(*by, "place", F.lit("operation.records-truncated").alias("id"), (F.col("n") - (most - 1)).alias("omitted"))
    return kept.unionByName(more)


def rejected_by_policy(diagnostics: DataFrame, ids: list[str]) -> DataFrame:
    """Warnings that a policy turns into failures."""
    return diagnostics.filter(F.col("id").isin(*ids)).withColumn("kind", F.lit("POLICY"))
