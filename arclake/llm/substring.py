"""Substring dedup by prefix-partitioned suffix trees.

A repeat is a run of at least ``window`` words that occurs at several places; all but the places in the smallest
document are removed.  Windows are judged on the input, not on what is left.

* Prefixes.  The suffix that starts at a word belongs to the group of its prefix up to the end of its anchor: the least
  of the half-window prints inside its first ``window`` words.  Such prefixes have half a window to a whole one, equal
  windows have equal ones, and neighbouring suffixes mostly share their anchor, so that a group takes a run of suffixes
  with one copy of its words.  Anchors of one document only end there: no suffix of theirs repeats.
* Groups.  Groups are dealt to tasks so that a task holds about two million words, whatever the input.  A prefix with
  more than ``HOT`` occurrences is not piled up: it is extended to the whole window, where a subtree is a single node, and
  nodes are found by an aggregate that combines before it shuffles.
* Subtrees.  In a task the suffixes are sorted by their words, by prefix doubling: ranks of 1, 2, 4, ... ``window`` words,
  each from two shorter ones, with no hash of a run.  Runs of equal rank are the internal nodes of ``window`` words
  depth; the smallest place below a node is its owner.
* Repeats.  Along a document, nodes whose owners go on together are one repeat, extended until one side differs:
  ``repeats`` lists (start, stop, owner's document, owner's start) of every such maximal repeat.

Words are 64-bit prints with a seed of the run; the windows of hot prefixes have 128 bits.

Edge cases: a null text has no words; texts shorter than the window lose nothing; a null doc_id counts as larger than
any other (but 2**63 - 1, which counts as equal); rows that repeat a doc_id never remove words of each other; an empty
table gives no rows; a very long text is cut into words piece by piece; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclake.llm.common import as_bytes, bucket_count, filter_of, materialize, mix64, new_seed, passes, rolling, row_key, slices, tidied, word_prints

WINDOW = 50
LAST = (1 << 63) - 1
#: Bytes of text handled at once.
SLICE = 4 << 20
#: Occurrences of a prefix beyond which it is extended to the whole window.
HOT = 1 << 16
#: Words that a task holds for its subtrees.
GROUP_WORDS = 1 << 21


def least_prints(prints: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    out, have = prints, 1
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Suffixes:
    """All suffixes of a run of texts that have ``window`` words, cut into runs of one document and anchor."""

    def __init__(self, texts: list[bytes | None], window: int = WINDOW, seed: bytes = b"") -> None:
        self.prints, lengths = word_prints(texts, seed)
        self.h, self.window = mix64(self.prints[:, 0] + self.prints[:, 1]), window
        count = np.maximum(lengths - window + 1, 0)
        text = np.repeat(np.arange(len(texts)), count)
        local = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        place = local + (np.cumsum(lengths) - lengths)[text]
        half = window // 2
        anchor = least_prints(rolling(self.h, half), window - half + 1)[place] if len(place) else np.zeros(0, np.uint64)
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        since = np.arange(len(anchor)) - np.maximum.accumulate(np.where(new, np.arange(len(anchor)), 0))
        starts = np.flatnonzero(new | (since % (half + 1) == 0))  # a run of a text that repeats itself is cut
        self.anchor, self.text, self.start, self.place = anchor[starts], text[starts], local[starts], place[starts]
        self.n = np.diff(np.append(starts, len(anchor)))

    def paths(self, column: int) -> np.ndarray:
        """Print of the window that starts at each word."""
        return rolling(np.ascontiguousarray(self.prints[:, column]), self.window)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indexes of runs, one run after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and where each run of equal ones starts."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    return (mix64(x) >> np.uint64(16)) % np.uint64(n)


def _packed(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket that has entries, each column packed."""
    order, cuts = runs(bucket)
    ends = np.append(cuts[1:], len(order))[: len(cuts)]
    blobs = [pa.array([x[order][a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts].astype(np.int32)), *blobs], ["bucket", *columns])


def _unpacked(part: pa.Table, kinds: dict) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(part.column(c).to_pylist()), kind) for c, kind in kinds.items()]


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("at").to_numpy(zero_copy_only=False).astype(np.int64)


ANCHORS = {"anchor": np.uint64, "least": np.int64, "most": np.int64, "n": np.int64}


def _anchors(window: int, n_buckets: int, seed: bytes):
    """Per batch and anchor: smallest and largest document, and occurrences, packed per bucket of anchors."""

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for part in slices(batch, "text", SLICE):
                s = Suffixes(as_bytes(part.column("text")), window, seed)
                found.append((s.anchor, _ids(part)[s.text]))
            anchor, doc = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(2))
            if len(anchor):
                order, at = runs(anchor)
                doc = doc[order]
                columns = {"anchor": anchor[order][at], "least": np.minimum.reduceat(doc, at), "most": np.maximum.reduceat(doc, at), "n": np.diff(np.append(at, len(doc)))}
                yield _packed(_bucket(columns["anchor"], n_buckets), columns)

    return run


@tidied
def _shared(part: pa.Table) -> pa.Table:
    """Anchors that more than one document has, and their occurrences."""
    anchor, least, most, n = _unpacked(part, ANCHORS)
    order, at = runs(anchor)
    several = np.minimum.reduceat(least[order], at) != np.maximum.reduceat(most[order], at)
    return pa.table({"anchor": pa.array(anchor[order][at][several].view(np.int64)), "n": pa.array(np.add.reduceat(n[order], at)[several])})


#: Packed columns of a group: distinct runs (words, number of suffixes), then occurrences of runs.
RUNS = {"words": np.uint64, "counts": np.int32, "own": np.int32, "doc": np.int64, "key1": np.uint64, "key2": np.uint64, "start": np.int64}


def _chosen(s: Suffixes, shared: np.ndarray, hot: np.ndarray, want_hot: bool) -> np.ndarray:
    """Runs whose anchors may be shared, either the hot ones or the others."""
    is_hot = np.isin(s.anchor, hot) if len(hot) else np.zeros(len(s.anchor), bool)
    return np.flatnonzero(is_hot if want_hot else passes(shared, s.anchor) & ~is_hot)


def _keys(part: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("key").to_pylist()), np.uint64).reshape(-1, 2)


def _deal(window: int, n_buckets: int, sent, seed: bytes):
    """Runs of suffixes with their words, once for equal ones of a batch, packed per bucket of anchors."""

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, hot = sent.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = Suffixes(as_bytes(part.column("text")), window, seed)
                own = _chosen(s, shared, hot, False)
                if not len(own):
                    continue
                bucket = _bucket(s.anchor[own], n_buckets)
                paths = s.paths(0)  # first and last window cover a run, so they tell equal runs of a batch
                order, cuts = runs(bucket, paths[s.place[own]], paths[s.place[own] + s.n[own] - 1], s.n[own])
                own, bucket = own[order], bucket[order]
                which = np.cumsum(np.isin(np.arange(len(own)), cuts)) - 1
                one = own[cuts]
                lengths = s.n[one] + window - 1
                words = s.h[gather(s.place[one], lengths)]
                word_at = np.concatenate(([0], np.cumsum(lengths)))
                keys, docs = _keys(part)[s.text[own]], _ids(part)[s.text[own]]
                edges = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(own))
                rows = []
                for a, b in zip(edges, edges[1:], strict=False):
                    c, d = which[a], which[b - 1] + 1
                    rows.append([words[word_at[c] : word_at[d]], s.n[one[c:d]].astype(np.int32), (which[a:b] - c).astype(np.int32), docs[a:b], keys[a:b, 0], keys[a:b, 1], s.start[own[a:b]]])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(len(RUNS)))], ["bucket", *RUNS])

    return run


def nodes_of(words: np.ndarray, room: np.ndarray, window: int) -> np.ndarray:
    """Lexicographic rank of the ``window`` words from each place on, by prefix doubling; -1 where they do not fit.

    ``room`` is the number of words left in a place's own run.
    """
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < window:
        step = min(have, window - have)
        at = np.flatnonzero(room >= have + step)
        pair = rank[at] * (int(rank.max(initial=0)) + 1) + rank[at + step]
        rank = np.full(len(words), -1, np.int64)
        rank[at] = np.unique(pair, return_inverse=True)[1]
        have += step
    return rank


#: Packed repeats of documents: document and key, words from start to stop, and where the owner has them.
FLAGS = {"doc": np.int64, "key1": np.uint64, "key2": np.uint64, "start": np.int64, "stop": np.int64, "owner": np.int64, "owner_start": np.int64}
FLAGGED = "bucket int, " + ", ".join(f"{c} binary" for c in FLAGS)


def _joined(doc, key1, key2, start, owner, owner_start, length) -> dict[str, np.ndarray]:
    """Neighbouring places of a document whose owners go on together, as repeats."""
    order = np.lexsort((start, owner_start - start, owner, doc, key2, key1))
    doc, key1, key2, start, owner, owner_start, length = (x[order] for x in (doc, key1, key2, start, owner, owner_start, length))
    same = np.ones(len(doc), bool)
    same[:1] = False
    for x in (doc, key1, key2, owner, owner_start - start):
        same[1:] &= x[1:] == x[:-1]
    stop = start + length
    apart = np.cumsum(~same) * (int(stop.max(initial=0)) + 1)
    furthest = np.maximum.accumulate(stop + apart) - apart  # one place may lie inside another
    same[1:] &= start[1:] <= furthest[:-1]
    at = np.flatnonzero(~same)
    last = np.append(at[1:], len(doc))[: len(at)] - 1
    return {"doc": doc[at], "key1": key1[at], "key2": key2[at], "start": start[at], "stop": furthest[last], "owner": owner[at], "owner_start": owner_start[at]}


def doc_bucket(key: np.ndarray, n_buckets: int) -> np.ndarray:
    return _bucket(key, n_buckets)


def _subtrees(window: int, n_buckets: int):
    """Sorts the suffixes of a group and gives the repeats of later documents, dealt to the buckets of documents."""

    @tidied
    def run(part: pa.Table) -> pa.Table:
        held = [x.as_py() for x in part.column("counts")]
        words, counts, own, doc, key1, key2, start = _unpacked(part, RUNS)
        shift = np.cumsum([0, *(len(x) // 4 for x in held)])[:-1]
        own = own + np.repeat(shift, [len(x) // 4 for x in part.column("own").to_pylist()])
        counts = counts.astype(np.int64)
        lengths = counts + window - 1
        ends = np.cumsum(lengths)
        rank = nodes_of(words, np.repeat(ends, lengths) - np.arange(len(words)), window)
        node = rank[gather(ends - lengths, counts)]  # of each suffix of each distinct run
        first = np.cumsum(counts) - counts
        inside = np.arange(len(node)) - np.repeat(first, counts)
        # The smallest place of each distinct run, then of each node.
        order, at = runs(own)
        by = np.lexsort((start, doc, own))
        least_doc, least_start = doc[by][at], start[by][at]
        runs_of = np.repeat(np.arange(len(counts)), counts)
        d, t = least_doc[runs_of], least_start[runs_of] + inside
        by = np.lexsort((t, d, node))
        ordered = node[by]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        owner, owner_start = np.empty(len(node), np.int64), np.empty(len(node), np.int64)
        which = np.cumsum(new) - 1
        owner[by], owner_start[by] = d[by][new][which], t[by][new][which]
        # Occurrences of runs, suffix by suffix.
        each = np.repeat(np.arange(len(own)), counts[own])
        suffix = gather(first[own], counts[own])
        later = np.flatnonzero(owner[suffix] < doc[each])
        each, suffix = each[later], suffix[later]
        flags = _joined(doc[each], key1[each], key2[each], start[each] + inside[suffix], owner[suffix], owner_start[suffix], np.full(len(each), window, np.int64))
        return pa.Table.from_batches([_packed(doc_bucket(flags["key1"], n_buckets), flags)])

    return run


WINDOWS = "path1 long, path2 long, at long, key binary, start long"


def _windows(window: int, sent, seed: bytes):
    """Every window of hot prefixes by itself."""

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, hot = sent.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = Suffixes(as_bytes(part.column("text")), window, seed)
                own = _chosen(s, shared, hot, True)
                each = np.repeat(own, s.n[own])
                inside = gather(np.zeros(len(own), np.int64), s.n[own])
                place, text = s.place[each] + inside, pa.array(s.text[each])
                yield pa.RecordBatch.from_arrays([*(pa.array(s.paths(i)[place].view(np.int64)) for i in range(2)), part.column("at").take(text), part.column("key").take(text), pa.array(s.start[each] + inside)], ["path1", "path2", "at", "key", "start"])

    return run


def _hot_flags(window: int, n_buckets: int):
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch)
            doc, start, owner, owner_start = (batch.column(c).to_numpy() for c in ("at", "start", "owner", "owner_start"))
            flags = _joined(doc, keys[:, 0], keys[:, 1], start, owner, owner_start, np.full(len(doc), window, np.int64))
            yield _packed(doc_bucket(flags["key1"], n_buckets), flags)

    return run


def extended(plain: DataFrame, window: int, n_buckets: int, sent, seed: bytes) -> DataFrame:
    """Repeats of hot prefixes, extended to the whole window."""
    rows = materialize(plain.mapInArrow(_windows(window, sent, seed), WINDOWS))
    nodes = rows.groupBy("path1", "path2").agg(F.min(F.struct("at", "start")).alias("owner"), F.max("at").alias("most"))
    nodes = materialize(nodes.filter("owner.at < most").select("path1", "path2", F.col("owner.at").alias("owner"), F.col("owner.start").alias("owner_start")))
    later = rows.join(nodes, ["path1", "path2"]).filter(F.col("at") > F.col("owner"))
    return later.select("at", "key", "start", "owner", "owner_start").mapInArrow(_hot_flags(window, n_buckets), FLAGGED)


_SPANS = pa.list_(pa.list_(pa.int64()))
GATHERED = "at long, key binary, found array<array<bigint>>"


@tidied
def _gather(part: pa.Table) -> pa.Table:
    """One row per document: its maximal repeats, in order."""
    doc, key1, key2, start, stop, owner, owner_start = _unpacked(part, FLAGS)
    f = _joined(doc, key1, key2, start, owner, owner_start, stop - start)
    order, at = runs(f["key1"], f["key2"], f["doc"])
    by = np.lexsort((f["start"], f["doc"], f["key2"], f["key1"]))
    four = np.stack([f[c][by] for c in ("start", "stop", "owner", "owner_start")], axis=1)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(four) + 1, 4, np.int32)), pa.array(four.ravel()))
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(by)).astype(np.int32)), inner)
    keys = np.stack([f["key1"][by][at], f["key2"][by][at]], axis=1)
    return pa.table({"at": pa.array(f["doc"][by][at]), "key": pa.array([k.tobytes() for k in keys], pa.binary()), "found": lists})


KEPT = "doc_id long, n_words long, n_removed long, kept string, spans array<array<long>>, repeats array<array<long>>"


def _remove(digest: bool):
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for text, found in zip(as_bytes(part.column("text")), part.column("found").to_pylist(), strict=True):
                    own, spans, kept, last, gone = text.split() if text else [], [], [], 0, 0
                    for s, e, *_ in found or ():
                        if spans and s <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], e)
                        else:
                            spans.append([s, e])
                    for s, e in spans:
                        kept += own[last:s]
                        gone, last = gone + e - s, e
                    left = b" ".join(kept + own[last:] if spans else own)
                    for column, value in zip(rows, (len(own), gone, hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "replace"), spans, found or []), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.string(), _SPANS, _SPANS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], [c.split()[0] for c in KEPT.split(", ")])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, or their SHA-256), spans (removed words), repeats."""
    spark, seed = docs.sparkSession, new_seed()
    own = F.col(doc_id).cast("long")
    key = row_key(own, F.col(text))
    plain = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(LAST)).alias("at"), key.alias("key"), F.col(text).alias("text"))
    few = bucket_count(spark, 0)
    met = plain.select("at", "text").mapInArrow(_anchors(window, few, seed), "bucket int, " + ", ".join(f"{c} binary" for c in ANCHORS))
    shared = materialize(met.groupBy("bucket").applyInArrow(_shared, "anchor long, n long"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    most = [r[0] for r in shared.filter(F.col("n") > hot).select("anchor").collect()]  # one for each ``hot`` occurrences at most
    sent = spark.sparkContext.broadcast((filter_of(shared, "anchor"), np.array(most, np.int64).view(np.uint64)))
    groups = bucket_count(spark, total * (window + window // 4), GROUP_WORDS)
    dealt = plain.mapInArrow(_deal(window, groups, sent, seed), "bucket int, " + ", ".join(f"{c} binary" for c in RUNS))
    flags = dealt.groupBy("bucket").applyInArrow(_subtrees(window, few), FLAGGED)
    if most:
        flags = flags.union(extended(plain, window, few, sent, seed))
    found = flags.groupBy("bucket").applyInArrow(_gather, GATHERED)
    return plain.join(materialize(found), ["at", "key"], "left").select("doc_id", "text", "found").mapInArrow(_remove(digest), KEPT)


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM p),
f AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS owner FROM k),
c AS (SELECT DISTINCT doc_id, s + t AS i FROM f, range(0, 50) r(t) WHERE owner < doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
u AS (SELECT doc_id, count(*) AS n_spans FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM f WHERE owner < doc_id) WHERE before IS NULL OR s - before > 50 GROUP BY doc_id),
v AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = x.doc_id AND c.i = x.i)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM v GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_removed, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256, CAST(coalesce(u.n_spans, 0) AS INTEGER) AS n_spans
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN u USING (doc_id)
"""
