"""Evidence capsules: sections of records as canonical JSON, with a manifest of their digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from arclake.operators import publish


def canonical(value: object) -> bytes:
    """Sorted keys, no blanks, UTF-8, a line feed at the end."""
    return (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n").encode()


def section(rows: DataFrame, order: list[str]) -> bytes:
    """A section's records in order; a section is a report, not a corpus."""
    return canonical([r.asDict(recursive=True) for r in rows.orderBy(*order).toLocalIterator()])


def write_capsule(spark: SparkSession, folder: str, sections: dict[str, bytes], policy: str = "FAIL") -> dict[str, str]:
    """Publishes the sections and ``manifest.json`` together; returns the digests."""
    digests = {name: hashlib.sha256(data).hexdigest() for name, data in sorted(sections.items())}
    files = [(f"{name}.json", data) for name, data in sections.items()] + [("manifest.json", canonical({"sections": digests}))]
    publish.publish(spark.createDataFrame(files, "name string, content binary"), folder, policy)
    return digests


def verify_capsule(files: DataFrame) -> list[str]:
    """Sections (name, content) that their manifest does not vouch for, and those that are missing."""
    held = {r["name"]: bytes(r["content"]) for r in files.collect()}
    digests = json.loads(held.pop("manifest.json"))["sections"]
    wrong = [n for n in digests if hashlib.sha256(held.get(f"{n}.json", b"")).hexdigest() != digests[n]]
    return sorted(wrong + [n for n in held if n.removesuffix(".json") not in digests])
