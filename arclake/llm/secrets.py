"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds base matches (assignments, access keys, hex strings) and further candidates: long
tokens that look random.  Every candidate's value is hashed, and the hashes are counted by distinct owners and
distinct repositories over the whole corpus.  A value that more than ``max_owners`` owners share, or that stands in more
than ``max_repos`` repositories of any, is a widely copied example; one with fewer that looks live is an owner-specific
credential.  Base spans are always reported; random-looking tokens only if they are owner-specific.

Edge cases: a null or empty text has no span; a null repository or owner counts as one unnamed owner; a null doc_id
is kept; repeated rows get a result each; an empty table gives no rows; other columns are ignored.  Offsets are code
points, ends exclusive, over the whole text however long.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclake.llm.common import materialize, slices, tidied

#: The kinds in their listed order, and the base patterns.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A run shorter than these bounds holds no other start that could reach them, so bounds in the pattern are the same
#: as filtering maximal runs.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: ``=`` only pads the end of a value; before a value it ends the name that the value is given to.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
ASSIGN_LEAST = 6
#: Words that mark a value as a placeholder.
PLACEHOLDERS = ("example", "changeme", "placeholder", "dummy", "sample", "yourkey", "xxxx", "0000", "1234")

FOUND = "doc_id long, repo string, owner string, base string, n_assign long, n_access long, n_hex long, candidates array<struct<kind:int,start:int,stop:int,value:binary,live:boolean>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    """Random-looking and no placeholder."""
    folded = value.lower()
    return len(value) >= 8 and not any(p in folded for p in PLACEHOLDERS) and entropy(value) >= 2.5 and any(c.isdigit() for c in value)


def looks_random(value: str) -> bool:
    """High entropy, and at least three of upper case, lower case, digits and signs, or letters and digits as dense as in hex.

    Density is the share of places where a letter meets a digit: 15/32 on average in random hex, 0.4 in random base 36,
    little in words that end in a number.
    """
    kinds = any(c.isupper() for c in value) + any(c.islower() for c in value) + any(c.isdigit() for c in value) + any(not c.isalnum() for c in value)
    return (kinds >= 3 or dense(value)) and entropy(value) >= 3.5


def dense(value: str) -> bool:
    """Letters and digits, which take turns at an eighth of the places at least."""
    turns = sum(a.isdigit() != b.isdigit() for a, b in pairwise(value))
    return turns * 8 >= len(value)


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, stop, value) of a whole text: base matches, then random-looking tokens outside them."""
    found: list[tuple[int, int, int, str]] = []
    if ":" in text or "=" in text:
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    covered, at, reached = sorted((a, b) for _, a, b, _ in found), 0, 0
    for m in TOKEN.finditer(text):  # tokens and spans both come in order, so one pass tells which meet
        while at < len(covered) and covered[at][0] < m.end():
            reached = max(reached, covered[at][1])
            at += 1
        if reached <= m.start() and looks_random(m[0]):
            found.append((3, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda c: (c[1], c[0]))


@tidied
def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.binary()), ("live", pa.bool_())])
    for batch in batches:
        for part in slices(batch, "text"):
            base, counts, lists = [], ([], [], []), []
            for text in part.column("text").to_pylist():
                own = candidates(text) if text else []
                base.append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in own if k < 3))
                for kind in range(3):
                    counts[kind].append(sum(c[0] == kind for c in own))
                lists.append([{"kind": k, "start": a, "stop": b, "value": hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "live": looks_live(v)} for k, a, b, v in own])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("repo"), part.column("owner"), pa.array(base, pa.string()), *[pa.array(c, pa.int64()) for c in counts], pa.array(lists, pa.list_(struct))],
                ["doc_id", "repo", "owner", "base", "n_assign", "n_access", "n_hex", "candidates"],
            )


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: distinct owners and distinct (owner, repository) pairs.  Every level combines before it shuffles."""
    each = found.select("owner", "repo", F.explode("candidates.value").alias("value"))
    pairs = each.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_uses"))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "source", owner: Column | None = None, max_owners: int = 2, max_repos: int = 16) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base (spans), spans, n_owner_specific, n_widely_copied.

    ``owner`` defaults to what stands before the first ``/`` of the repository.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(repo).cast("string").alias("repo"), (F.substring_index(F.col(repo).cast("string"), "/", 1) if owner is None else owner.cast("string")).alias("owner"), F.col(text).alias("text"))
    found = materialize(named.mapInArrow(_scan, FOUND).withColumn("row", F.monotonically_increasing_id()))
    frequency = materialize(ownership(found))
    each = found.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    judged = each.join(frequency, "value").withColumn("copied", (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)).withColumn("own", ~F.col("copied") & F.col("live"))
    place = F.struct("start", "kind", "stop")
    shown = (F.col("kind") < 3) | F.col("own")
    rows = judged.groupBy("row").agg(F.collect_list(F.when(shown, place)).alias("places"), F.count_if("own").alias("own"), F.count_if("copied").alias("copied"))
    kinds = F.array(*map(F.lit, KINDS))
    text_of = F.transform(F.array_sort("places"), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"]))
    rows = rows.select("row", F.array_join(text_of, ",").alias("shown"), "own", "copied")
    return found.join(rows, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base", F.coalesce("shown", F.lit("")).alias("spans"),
        F.coalesce("own", F.lit(0)).alias("n_owner_specific"), F.coalesce("copied", F.lit(0)).alias("n_widely_copied"),
    )
