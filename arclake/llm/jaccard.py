"""N-gram Jaccard join with set-relation skipping.

A document is the set of its distinct word shingles.  Equal sets are one node.  Tokens are ordered rarest first, as
far as counts over the whole corpus tell; two sets that are similar enough must share a token of their prefixes, and
where that token stands bounds how much they can share at all.

* Stars: a set is first tried against the most typical set it shares min-hashes with.  Where that link holds, the set
  becomes a member of the other's star, and the number of its tokens that the leader lacks is kept.
* Index-level skipping: the index list of a token has one entry a star: the range of its sizes and the furthest that
  any of its prefixes reaches from there.  Lists are sorted by size; sizes and positions that cannot reach the
  threshold are skipped in blocks, and pairs are listed between stars, never between their members.
* Answer-level skipping: only leaders are compared on whole texts.  What a member shares with another star follows from
  its leader's answer: at most the leaders' overlap and the tokens that either leader lacks.  A pair of stars whose
  leaders link, or that other links join already, needs no more; where the bound still allows a link of two members, those
  members are compared themselves.

The order of tokens and the choice of leaders only steer the work: every pair of sets that passes the bounds is decided
on whole texts, so no link is lost.  Nodes are numbered when their table is written, by 128 bits of the set; texts are
fetched by 128 bits of their SHA-256.  A group of the index holds about a million entries, whatever the input.

Edge cases: a null or wordless text has an empty set, is linked with nothing and is its own component; a null doc_id
is a document whose component is named by the smallest non-null doc_id (null if there is none); repeated rows and
equal texts are linked; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclake.llm.common import among, as_bytes, bucket_count, fresh, hash_words, materialize, mix64, new_seed, quoted, rolling, slices, text_key, tidied
from arclake.llm.graph import components

WORDS = 5
NUM, DEN = 75, 100
SEEDS = 8
#: A leader is tried where at least this many of the min-hashes agree.
AGREE = 4
#: Bytes of text handled at once.
SLICE = 2 << 20
#: Tokens that a slice of texts holds so many times are counted; the most frequent of them are put last in the order.
LOCAL_LEAST = 2
HOT_TOKENS = 1 << 20


def shingle_sets(texts: list[bytes | None], words: int = WORDS, seed: bytes = b"") -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit fingerprints of its shingles; a shorter text is one shingle."""
    h, counts = hash_words([x.lower() if x else x for x in texts], seed)
    rolled, out, at = rolling(h, words), [], 0
    for n in counts.tolist():
        own = np.sort(rolled[at : at + n - words + 1]) if n >= words else rolling(h[at : at + n], n) if n else h[:0]
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
        at += n
    return out


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def least_overlap(a: int | np.ndarray, b: int | np.ndarray, num: int = NUM, den: int = DEN):
    """Smallest intersection with den * intersection >= num * union."""
    return -(-num * (a + b) // (den + num))


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1


def least_overlap_column(a: Column, b: Column, num: int, den: int) -> Column:
    return F.ceil((a + b) * num / (den + num))


def _heavy(words: int, seed: bytes):
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in slices(batch, "text", SLICE):
                h, counts = hash_words([x.lower() if x else x for x in as_bytes(part.column("text"))], seed)
                ends = np.repeat(np.cumsum(counts), counts)
                rolled = rolling(h, words)
                found.append(rolled[np.arange(len(rolled)) + words <= ends[: len(rolled)]])
            tokens = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(tokens)))
            often = n >= LOCAL_LEAST
            yield pa.RecordBatch.from_arrays([pa.array(tokens[first[often]].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])

    return run


def frequent_tokens(docs: DataFrame, words: int = WORDS, most: int = HOT_TOKENS, seed: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens, sorted, and their places in the order; at most ``most`` of them, 12 bytes each."""
    counted = materialize(docs.select("text").mapInArrow(_heavy(words, seed), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    size = F.floor(F.log2("n") * 8)
    least, total = 0, 0
    for step, many in sorted(map(tuple, counted.groupBy(size.alias("step")).agg(F.count(F.lit(1)).alias("many")).collect()), reverse=True):  # a few hundred steps at most
        if (total := total + many) > most:
            least = step + 1
            break
    top = counted.filter(size >= least).toArrow()
    tokens, counts = (top.column(c).to_numpy() for c in ("token", "n"))
    tokens = tokens.view(np.uint64)
    order = np.lexsort((tokens, counts))
    rank = np.empty(len(tokens), np.uint32)
    rank[order] = np.arange(1, len(tokens) + 1, dtype=np.uint32)
    by_token = np.argsort(tokens)
    return tokens[by_token], rank[by_token]


BASE = "doc_id long, h binary, set binary, n int, common int, least array<long>, prefix binary"


def _describe(words: int, seeds: int, num: int, den: int, hot, seed: bytes):
    multipliers = [np.uint64(int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1) for i in range(seeds)]
    mask = np.uint64((1 << 22) - 1)

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_tokens, hot_rank = hot.value
        maybe = np.zeros(1 << 22, bool)  # a quick look before the search
        maybe[hot_tokens & mask] = True
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(as_bytes(part.column("text")), words, seed)
                sizes = np.array([len(x) for x in sets], np.int64)
                tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                rank = np.zeros(len(tokens), np.uint32)
                look = np.flatnonzero(maybe[tokens & mask])
                if len(look):
                    at = np.minimum(np.searchsorted(hot_tokens, tokens[look]), len(hot_tokens) - 1)
                    there = hot_tokens[at] == tokens[look]
                    rank[look[there]] = hot_rank[at[there]]
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                least = np.zeros((len(full), seeds), np.int64)
                for j, m in enumerate(multipliers if len(full) else ()):
                    x = tokens * m
                    least[:, j] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), starts).view(np.int64)
                common = np.zeros(len(sets), np.int32)
                if len(full):
                    common[full] = np.add.reduceat((rank > 0).astype(np.int32), starts)
                prefixes, keys, at = [], [], 0
                for i, own in enumerate(sets):
                    n = len(own)
                    if n:
                        keep = prefix_length(n, num, den)
                        prefixes.append((own[np.argsort(rank[at : at + n], kind="stable")[:keep]] if common[i] else own[:keep]).tobytes())
                    else:
                        prefixes.append(b"")
                    keys.append(set_key(own))
                    at += n
                offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, seeds, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(keys, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(common), pa.ListArray.from_arrays(pa.array(offsets), pa.array(least.ravel())), pa.array(prefixes, pa.binary())],
                    ["doc_id", "h", "set", "n", "common", "least", "prefix"],
                )

    return run


POSTINGS = "bucket int, tokens binary, stars binary, small binary, large binary, reach binary"
_POSTED = (("tokens", np.uint64), ("stars", np.int64), ("small", np.int32), ("large", np.int32), ("reach", np.int32))


def combined(tokens: np.ndarray, stars: np.ndarray, small: np.ndarray, large: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each token and star, in the order of both: smallest and largest size, furthest reach."""
    order = np.lexsort((stars, tokens))
    tokens, stars = tokens[order], stars[order]
    first = np.flatnonzero(np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (stars[1:] != stars[:-1])))) if len(order) else np.zeros(0, np.int64)
    if len(first) == len(order):
        return tokens, stars, small[order], large[order], reach[order]
    return tokens[first], stars[first], np.minimum.reduceat(small[order], first), np.maximum.reduceat(large[order], first), np.maximum.reduceat(reach[order], first)


def _post(n_buckets: int):
    """Index entries of each batch, packed per bucket of tokens."""

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("prefix").to_pylist()
            lengths = np.array([len(b) // 8 for b in blobs], np.int64)
            tokens = np.frombuffer(b"".join(blobs), np.uint64)
            each = np.repeat(np.arange(len(blobs)), lengths)
            position = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            star, n = batch.column("star").to_numpy()[each], batch.column("n").to_numpy()[each]
            packed = combined(tokens, star, n, n, (n - position).astype(np.int32))
            bucket = (mix64(packed[0]) >> np.uint64(20)) % np.uint64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
            columns = [x[order] for x in packed]
            rows = [pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cut[:-1]].astype(np.int32)), *rows], ["bucket", *(name for name, _ in _POSTED)])

    return run


def star_pairs(tokens: np.ndarray, stars: np.ndarray, small: np.ndarray, large: np.ndarray, reach: np.ndarray, num: int = NUM, den: int = DEN, block: int = 2048, most: int = 1 << 20) -> np.ndarray:
    """Distinct pairs (u < v) of stars with sizes that may match, which share a token that stands early enough in both."""
    tokens, stars, small, large, reach = combined(tokens, stars, small, large, reach)
    order = np.lexsort((small, tokens))
    tokens, stars, small, large, reach = tokens[order], stars[order], *(x[order].astype(np.int64) for x in (small, large, reach))
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(tokens)))
    found: list[np.ndarray] = []

    def keep(u: np.ndarray, v: np.ndarray) -> None:
        fits = (small[v] * num <= large[u] * den) & (small[u] * num <= large[v] * den) & (np.minimum(reach[u], reach[v]) >= least_overlap(small[u], small[v], num, den))
        a, b = stars[u[fits]], stars[v[fits]]
        if len(a):
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            if sum(map(len, found)) > most:
                found[:] = [np.unique(np.concatenate(found), axis=0)]

    for n in np.unique(lengths[(lengths > 1) & (lengths <= 64)]).tolist():  # short lists of one length at once
        own, (i, j) = starts[lengths == n], np.triu_indices(n, 1)
        step = max(1, most // len(i))
        for at in range(0, len(own), step):
            part = own[at : at + step, None]
            keep((part + i).ravel(), (part + j).ravel())
    for a, n in zip(starts[lengths > 64].tolist(), lengths[lengths > 64].tolist(), strict=True):
        for i in range(a, a + n, block):
            to = min(i + block, a + n)
            # smallest sizes ascend: nothing lies beyond the last that the largest set of this block may match
            stop = a + int(np.searchsorted(small[a : a + n], large[i:to].max() * den // num, side="right"))
            for j in range(i, stop, block):
                end = min(j + block, a + n)
                if min(reach[i:to].max(), reach[j:end].max()) < least_overlap(int(small[i]), int(small[j]), num, den):
                    continue  # no position of the block can reach the threshold
                u, v = np.nonzero(np.arange(i, to)[:, None] < np.arange(j, end))
                keep(i + u, j + v)
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


PAIRS = "u long, v long"


def _join_bucket(num: int, den: int):
    @tidied
    def run(part: pa.Table) -> pa.Table:
        pairs = star_pairs(*(np.frombuffer(b"".join(part.column(name).to_pylist()), kind) for name, kind in _POSTED), num, den)
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    return run


def shared_least(a: int, b: int, num: int = NUM, den: int = DEN) -> int:
    """Tokens that two prefixes must share: what the sets beyond the prefixes can add at most is known.

    Common tokens up to the nearer end of the two prefixes lie in both; beyond it one of the sets has no more than
    its tokens after its prefix.
    """
    return least_overlap(a, b, num, den) - max(-(-num * x // den) for x in (a, b)) + 1


def marks_of(prefix: bytes) -> bytes:
    """A prefix with half of each token's bits: enough to count what two prefixes share, never too low."""
    return np.frombuffer(prefix, np.uint64).astype(np.uint32).tobytes()


def may_link(a: int, x: bytes, b: int, y: bytes, num: int = NUM, den: int = DEN) -> bool:
    return int(np.isin(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)).sum()) >= shared_least(a, b, num, den)


@tidied
def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array([marks_of(x) for x in batch.column("prefix").to_pylist()], pa.binary())], ["node", "n", "marks"])


def _enough(num: int, den: int):
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("a", "x", "b", "y")), strict=True)
            fits = pa.array([may_link(a, x, b, y, num, den) for a, x, b, y in columns], pa.bool_())
            yield batch.select(["u", "v"]).filter(fits)

    return run


OVERLAPS = "u long, v long, a long, b long, both long"


def _overlap(words: int, seed: bytes):
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))  # rows come sorted by u
        for batch in batches:
            for part in slices(batch, "y", SLICE):
                left, rows = part.column("u").to_pylist(), []
                for i, own in enumerate(shingle_sets(as_bytes(part.column("y")), words, seed)):
                    if left[i] != last[0]:
                        last = (left[i], shingle_sets([as_bytes(part.column("x").slice(i, 1))[0]], words, seed)[0])
                    rows.append((len(last[1]), len(own), len(np.intersect1d(last[1], own, assume_unique=True))))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v"), *columns], ["u", "v", "a", "b", "both"])

    return run


def plausible(nodes: DataFrame, pairs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs of nodes whose prefixes share as many tokens as those of linked sets must."""
    ids = materialize(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    marks = materialize(nodes.select("node", "n", "prefix").join(ids, "node", "left_semi").mapInArrow(_marks, "node long, n int, marks binary"))
    left = pairs.join(marks.select(F.col("node").alias("v"), F.col("n").alias("b"), F.col("marks").alias("y")), "v")
    both = left.join(marks.select(F.col("node").alias("u"), F.col("n").alias("a"), F.col("marks").alias("x")), "u")
    return both.select("u", "v", "a", "x", "b", "y").mapInArrow(_enough(num, den), PAIRS)


def overlaps(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, seed: bytes) -> DataFrame:
    """(u, v, sizes a and b, tokens in both) of pairs of nodes, by their whole texts."""
    ids = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = materialize(nodes.select("node", "h").join(ids, "node", "left_semi"))
    found = among(docs.select("h", "text"), "h", wanted).join(wanted, "h")
    texts = materialize(found.groupBy("node").agg(F.first("text").alias("text")))
    left = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")), "v")
    both = left.join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")), "u")
    return both.select("u", "v", "x", "y").mapInArrow(_overlap(words, seed), OVERLAPS)


def linked(num: int, den: int) -> Column:
    return F.col("both") * den >= (F.col("a") + F.col("b") - F.col("both")) * num


def star_links(docs: DataFrame, nodes: DataFrame, words: int, num: int, den: int, seed: bytes) -> DataFrame:
    """(u, v, a, b, both): each set and the most typical set that it shares min-hashes with, where they are similar enough."""
    each = nodes.select("node", (F.col("n") - F.col("common")).alias("own"), F.posexplode("least").alias("seed", "hash"))
    best = each.groupBy("seed", "hash").agg(F.min(F.struct("own", "node")).alias("best"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    leaders = materialize(best.select("seed", "hash", F.col("best.node").alias("leader")))
    tried = each.join(leaders, ["seed", "hash"]).filter("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("agree")).filter(F.col("agree") >= AGREE)
    tried = materialize(tried.groupBy("node").agg(F.max_by("leader", F.struct("agree", "leader")).alias("leader")).select(F.col("leader").alias("u"), F.col("node").alias("v")))
    return materialize(overlaps(docs, nodes, tried, words, seed).filter(linked(num, den)))


#: Members of a star that are packed into one row.
PACK = 512
PACKED = "star long, node binary, n binary, extra binary, many binary, marks binary"


@tidied
def _pack(part: pa.Table) -> pa.Table:
    """Members of a star: their numbers, sizes, extra tokens, and the marks of their prefixes, one after the other."""
    marks = [marks_of(x) for x in part.column("prefix").to_pylist()]
    numbers = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("node", "n", "extra")]
    many = np.array([len(m) // 4 for m in marks], np.int64).tobytes()
    return pa.table({"star": part.column("star").slice(0, 1), **{k: pa.array([v], pa.binary()) for k, v in zip(("node", "n", "extra", "many", "marks"), (*numbers, many, b"".join(marks)), strict=True)}})


def _between(num: int, den: int):
    """Pairs of members of two stars that the leaders' overlap, their sizes and their marks leave possible."""

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i in range(batch.num_rows):
                both = batch.column("both")[i].as_py()
                (un, ua, ue, um), (vn, va, ve, vm) = ([np.frombuffer(batch.column(f"{side}_{c}")[i].as_py(), np.int64) for c in ("node", "n", "extra", "many")] for side in "uv")
                u_marks, v_marks = (np.frombuffer(batch.column(f"{side}_marks")[i].as_py(), np.uint32) for side in "uv")
                u_at, v_at = np.cumsum(um) - um, np.cumsum(vm) - vm
                for k, n in enumerate(ua.tolist()):
                    enough = (n * num <= va * den) & (va * num <= n * den) & (both + ue[k] + ve >= least_overlap(n, va, num, den))
                    if enough.any():
                        shared = np.add.reduceat(np.isin(v_marks, u_marks[u_at[k] : u_at[k] + um[k]]).astype(np.int64), v_at)
                        least = least_overlap(n, va, num, den) - np.maximum(-(-num * n // den), -(-num * va // den)) + 1
                        mates = vn[enough & (shared >= least)]
                        found.append((np.full(len(mates), un[k]), mates))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["u", "v"])

    return run


def derived(docs: DataFrame, nodes: DataFrame, members: DataFrame, answers: DataFrame, links: DataFrame, words: int, num: int, den: int, seed: bytes) -> DataFrame:
    """Links of members of two stars whose leaders do not link, from their leaders' answers.

    Members of u and v share at most what the leaders share and what each has beside its leader.  Pairs of stars that
    links join already are done.  First members meet the other's leader, then, where the stars are still apart, each
    other.  Members come in packs, and only pairs that their prefixes leave possible are listed.
    """
    around = members.groupBy(F.col("star").alias("node")).agg(F.min("n").alias("small"), F.max("extra").alias("extra"))
    around = nodes.select("node", "n").join(around, "node").select("node", F.least("n", "small").alias("small"), "extra")

    def side(x: str, y: str) -> DataFrame:
        return around.select(F.col("node").alias(x), F.col("small").alias(f"small_{y}"), F.col("extra").alias(f"extra_{y}"))

    open_ = answers.filter(~linked(num, den)).join(side("u", "a"), "u", "left").join(side("v", "b"), "v", "left")
    more = F.coalesce("extra_a", F.lit(0)) + F.coalesce("extra_b", F.lit(0))
    open_ = materialize(open_.filter((more > 0) & (F.col("both") + more >= least_overlap_column(F.coalesce("small_a", "a"), F.coalesce("small_b", "b"), num, den))).select("u", "v", "both"))
    for leaders in (True, False):
        if open_.isEmpty():
            break
        joint = materialize(components(links)).select(F.col("node").alias("u"), F.col("component").alias("cu"))
        apart = open_.join(joint, "u", "left").join(joint.select(F.col("u").alias("v"), F.col("cu").alias("cv")), "v", "left")
        open_ = materialize(apart.filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v", "both"))
        ends = open_.select(F.col("u").alias("star")).union(open_.select("v")).distinct()
        own = members.join(ends, "star", "left_semi").join(nodes.select("node", "prefix"), "node")
        sizes = own.groupBy("star").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs"))
        own = own.join(sizes, "star").withColumn("pack", F.pmod(F.xxhash64("node"), F.col("packs")))
        packed = materialize(own.groupBy("star", "pack").applyInArrow(_pack, PACKED))
        lead = nodes.select(F.col("node").alias("star"), "node", "n", F.lit(0).cast("long").alias("extra"), "prefix").join(ends, "star", "left_semi")
        lead = materialize(lead.groupBy("star").applyInArrow(_pack, PACKED)) if leaders else None

        def ways(x: DataFrame, y: DataFrame, open_: DataFrame = open_) -> DataFrame:
            for rows, name in ((x, "u"), (y, "v")):
                open_ = open_.join(rows.select(F.col("star").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("node", "n", "extra", "many", "marks"))), name)
            return open_.drop("u", "v").mapInArrow(_between(num, den), PAIRS)

        pairs = ways(lead, packed).union(ways(packed, lead)) if leaders else ways(packed, packed)
        found = overlaps(docs, nodes, materialize(pairs.distinct()), words, seed).filter(linked(num, den))
        links = materialize(links.union(found.select("u", "v")))
    return links


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, h (key of its text)."""
    return component_rows(docs, doc_id, text, words, num, den).drop("component")


def component_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``jaccard_components`` and their component itself, null for empty sets."""
    spark, seed = docs.sparkSession, new_seed()
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("h"), F.col(text).alias("text"))
    hot = spark.sparkContext.broadcast(frequent_tokens(plain, words, seed=seed))
    base = materialize(plain.mapInArrow(_describe(words, SEEDS, num, den, hot, seed), BASE))
    sets = base.filter("n > 0")
    nodes = sets.groupBy("set").agg(F.first(F.struct("n", "common", "least", "prefix")).alias("s"), F.min("h").alias("h"))
    nodes = materialize(nodes.select("set", "h", "s.*").withColumn("node", F.monotonically_increasing_id()))
    stars = star_links(plain, nodes, words, num, den, seed)
    # A set that leads others is in no star itself, so that a star's members all have their leader's answer.
    members = materialize(stars.join(stars.select(F.col("u").alias("v")).distinct(), "v", "left_anti").select(F.col("v").alias("node"), F.col("u").alias("star"), F.col("b").alias("n"), (F.col("b") - F.col("both")).alias("extra")))
    posted = nodes.select("node", "n", "prefix").join(members.select("node", "star"), "node", "left").select(F.coalesce("star", "node").alias("star"), "n", "prefix")
    entries = nodes.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    met = posted.mapInArrow(_post(bucket_count(spark, entries // 8)), POSTINGS).groupBy("bucket").applyInArrow(_join_bucket(num, den), PAIRS)
    met = materialize(met.distinct())
    several = members.select("star").distinct()
    wide = met.join(several.select(F.col("star").alias("u")), "u", "left_semi").union(met.join(several.select(F.col("star").alias("v")), "v", "left_semi").select("u", "v"))
    single = met.join(several.select(F.col("star").alias("u")), "u", "left_anti").join(several.select(F.col("star").alias("v")), "v", "left_anti").select("u", "v")
    pairs = materialize(plausible(nodes, materialize(single), num, den).union(wide.distinct()))
    answers = materialize(overlaps(plain, nodes, pairs, words, seed))
    links = materialize(stars.select("u", "v").union(answers.filter(linked(num, den)).select("u", "v")))
    links = derived(plain, nodes, members, answers, links, words, num, den, seed)
    joint = materialize(components(links))
    # Back to documents.
    owned = nodes.select("set", "node").join(joint, "node", "left").select("set", F.coalesce("component", "node").alias("component"))
    named = materialize(sets.select("doc_id", "set").join(owned, "set").groupBy("set", "component").agg(F.min("doc_id").alias("least")))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = materialize(named.select("set", "component").join(names, "component"))
    whole = sets.select("doc_id", "h", "set", "n").join(answers, "set").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "h", "component")
    alone = base.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "h")
    return whole.unionByName(alone, allowMissingColumns=True)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component, one of each, with all their columns.

    A row without a doc_id stays where no row of its component has one; of repeated rows one stays.  Texts without
    words are linked with nothing: they all stay.
    """
    rows = materialize(component_rows(docs, doc_id, text).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))
    joint, alone = rows.filter("component is not null"), rows.filter("component is null")
    own, id_, key, times = fresh(docs, "own", "id", "key", "times")
    first = joint.groupBy("component").agg(F.min("h").alias(key), F.first("doc_id").alias(id_), F.count(F.lit(1)).alias(times))
    first = materialize(first.select(key, id_, times).union(alone.select("h", "doc_id", F.lit(1).cast("long")).distinct()))
    keyed = docs.withColumn(own, text_key(F.col(text)))
    same = (F.col(own) == F.col(key)) & F.col(doc_id).cast("long").eqNullSafe(F.col(id_))
    kept = keyed.join(first.filter(F.col(times) == 1), same, "left_semi")
    if not first.filter(F.col(times) > 1).isEmpty():  # a doc_id that occurs several times in one component
        kept = kept.union(keyed.join(first.filter(F.col(times) > 1), same, "left_semi").dropDuplicates([own, doc_id]))
    return kept.select(*quoted(kept, (own,)))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, md5(array_to_string(w[s:s + 4], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(k, '' ORDER BY k)) AS own FROM t GROUP BY doc_id),
o AS (SELECT own, min(doc_id) AS doc_id, any_value(n) AS n FROM n GROUP BY own),
r AS (SELECT k, doc_id, n FROM t JOIN o USING (doc_id)),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM r a JOIN r b ON a.k = b.k AND a.doc_id < b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
c AS (SELECT doc_id AS u, doc_id AS v FROM o UNION SELECT c.u, e.v FROM c JOIN e ON c.v = e.u),
m AS (SELECT u, min(v) AS component_id FROM c GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (own) LEFT JOIN m ON m.u = o.doc_id
"""
