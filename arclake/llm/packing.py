"""Best-fit packing of tokenised documents by linear grouping.

The planner sees only how many pieces have each length, at most ``capacity`` numbers however large the corpus is.
Large pieces, longest first, form groups of equal cardinality and count as long as the longest of their group.
Configurations of few such sizes are optimised by bounded knapsack over the groups that are left and used as often
as the counts allow.  Actual pieces then take the places of their group, and small pieces go best-fit, longest
first, into the room that is really left.  All of this is arithmetic on ranges of equal sequences; the pieces
themselves stay distributed and look their range up by (length, rank).

Edge cases: a null or empty text is one piece with the end token alone; a null doc_id packs like any other; repeated
rows are pieces of their own; ties between equal lengths fall by seeded hash; an empty table gives no rows; other
columns are ignored.  A very long text gives as many full pieces as it needs.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arclake.llm.common import as_bytes, materialize, ranked, slices, tidied

CAPACITY = 4096
#: Larger pieces are grouped; smaller ones fill the room that is left.
SMALL = CAPACITY // 8
GROUPS = 256
END_ID = 1
#: A plan of more ranges than this is joined by shuffle, not broadcast.
BROADCAST_RANGES = 200_000


#: The runs into which the tokenizer splits a word of ASCII characters, in lower case.
RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class WordIds(dict):
    """Token ids of a word as little-endian unsigned 32-bit bytes, kept per worker in two generations.

    White space is dropped by this tokenizer and separates its words, so a text's ids are its words' ids in a row.
    Unknown words are encoded many at a time; each of their letter or sign runs ends with an end-of-word token, which
    is how the ids are dealt back to the words.  Words of other shapes are encoded one at a time.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.old = Tokenizer.from_file(path), most, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def __missing__(self, word: bytes) -> bytes:
        value = self.old.get(word)
        if value is None:
            value = np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 64:
            self[word] = value
        return value

    def learn(self, words: set[bytes]) -> None:
        """Encode the unknown words of plain shape, together."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        plain, runs = [], []
        for word in [w for w in words.difference(self.old) if w not in self]:
            if len(word) <= 64:
                text = word.decode("utf-8", "replace")
                if text.isalpha():
                    plain.append(word)
                    runs.append(1)
                elif text[:-1].isalpha() and text[-1] in ".,;:!?":
                    plain.append(word)
                    runs.append(2)
                elif text.isascii() and b"<|" not in word:
                    plain.append(word)
                    runs.append(len(RUNS.findall(text.lower())))
        for at in range(0, len(plain), 1000):
            own, last = plain[at : at + 1000], np.cumsum(runs[at : at + 1000])
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(own).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == last[-1] and ends[-1] == len(ids):  # else they are encoded one at a time
                data, begin = ids.tobytes(), 0
                for word, end in zip(own, (4 * ends[last - 1]).tolist(), strict=True):
                    self[word] = data[begin:end]
                    begin = end

    def split(self, text: bytes | None) -> list[bytes]:
        """Words in lower case, as the tokenizer has them, unless the text may hold its special tokens."""
        return (text if b"<|" in text else text.lower()).split() if text else []


_WORDS: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int):
    end = END_ID.to_bytes(4, "little")

    @tidied
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WORDS.get(path) or _WORDS.setdefault(path, WordIds(path))
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids, seeds, numbers, starts, lengths, crcs = [], [], [], [], [], []
                texts = [known.split(text) for text in as_bytes(part.column("text"))]
                known.learn(set().union(*texts))
                for doc, h, words in zip(part.column("doc_id").to_pylist(), part.column("h").to_pylist(), texts, strict=True):
                    data = b"".join(map(known.__getitem__, words)) + end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at : at + 4 * capacity]
                        ids.append(doc)
                        seeds.append(h)
                        numbers.append(piece)
                        starts.append(at // 4)
                        lengths.append(len(own) // 4)
                        crcs.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(seeds, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "h", "piece", "start", "length", "ids_crc32"],
                )

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", seed: int = 29) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, h (a seeded hash), piece, start, length, ids_crc32."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("h"), F.col(text).alias("text"))
    return plain.mapInArrow(_pieces(tokenizer, capacity), "doc_id long, h long, piece int, start long, length long, ids_crc32 long")


def _configuration(sizes: list[int], left: list[int], first: int, capacity: int) -> dict[int, int]:
    """Group -> number of places: one of ``first`` and what fills the rest best, by bounded knapsack over sizes."""
    rest, mask = capacity - sizes[first], (1 << (capacity - sizes[first] + 1)) - 1
    reached, steps = 1, []
    for g in range(first, len(sizes)):
        free, step = left[g] - (g == first), 1
        if sizes[g] > rest or free <= 0:
            continue
        free = min(free, rest // sizes[g])
        while free > 0:
            step = min(step, free)
            grown = (reached | (reached << (step * sizes[g]))) & mask
            if grown != reached:
                steps.append((grown & ~reached, g, step))
                reached = grown
            free -= step
            step *= 2
        if reached >> rest & 1:
            break
    at, config = reached.bit_length() - 1, defaultdict(int, {first: 1})
    for new, g, step in reversed(steps):
        if new >> at & 1:
            config[g] += step
            at -= step * sizes[g]
    return dict(config)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int]], int]:
    """Ranges (length, first rank, end rank, first sequence), one place of each sequence a range, and the number of sequences."""
    ranges: list[tuple[int, int, int, int]] = []
    opened = counts.get(capacity, 0)
    if opened:
        ranges.append((capacity, 0, opened, 0))
    large = sorted((x for x, n in counts.items() if small < x < capacity and n), reverse=True)
    total = sum(counts[x] for x in large)
    sizes: list[int] = []
    left: list[int] = []
    members: list[deque[list[int]]] = []  # of each group: [length, first rank, end rank], longest first
    if total:
        each = -(-total // groups)
        for x in large:
            at = 0
            while at < counts[x]:
                if not left or left[-1] == each:
                    sizes.append(x)
                    left.append(0)
                    members.append(deque())
                n = min(each - left[-1], counts[x] - at)
                members[-1].append([x, at, at + n])
                left[-1] += n
                at += n
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    gaps = 0  # bit g: some sequence has room for g

    def leave(gap: int, lo: int, hi: int) -> None:
        nonlocal gaps
        if gap and lo < hi:
            room[gap].append((lo, hi))
            gaps |= 1 << gap

    for first in range(len(sizes)):
        while left[first]:
            config = _configuration(sizes, left, first, capacity)
            times = min(left[g] // n for g, n in config.items())
            pieces = [(opened, opened + times, capacity)]
            for g, n in config.items():
                left[g] -= n * times
                for _ in range(n):
                    cut: list[tuple[int, int, int]] = []
                    for lo, hi, gap in pieces:
                        while lo < hi:
                            run = members[g][0]
                            m = min(hi - lo, run[2] - run[1])
                            ranges.append((run[0], run[1], run[1] + m, lo))
                            cut.append((lo, lo + m, gap - run[0]))
                            run[1] += m
                            lo += m
                            if run[1] == run[2]:
                                members[g].popleft()
                    pieces = cut
            for lo, hi, gap in pieces:
                leave(gap, lo, hi)
            opened += times
    for x in sorted((x for x, n in counts.items() if 0 < x <= min(small, capacity - 1) and n), reverse=True):
        rank = 0
        while rank < counts[x]:
            above = gaps >> x
            if not above:
                more = -(-(counts[x] - rank) // (capacity // x))
                leave(capacity, opened, opened + more)
                opened += more
                above = gaps >> x
            gap = x + (above & -above).bit_length() - 1
            lo, hi = room[gap].pop()
            n = min(hi - lo, counts[x] - rank)
            if n < hi - lo:
                room[gap].append((lo + n, hi))
            if not room[gap]:
                gaps &= ~(1 << gap)
            ranges.append((x, rank, rank + n, lo))
            leave(gap - x, lo, lo + n)
            rank += n
    return ranges, opened


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", seed: int = 29, small: int | None = None, groups: int = GROUPS) -> DataFrame:
    """Pack all documents; returns doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer, capacity, doc_id, text, seed))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    ranges, _ = plan_sequences(counts, capacity, capacity // 8 if small is None else small, groups)
    plan = spark.createDataFrame(_range_table(ranges))
    if len(ranges) <= BROADCAST_RANGES:
        plan = F.broadcast(plan)
    places = ranked(pieces, ["length"], ["h", "doc_id", "piece"], F.xxhash64("h", "piece"), buckets=1024)
    inside = (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("r_first")) & (F.col("rank") < F.col("r_end"))
    placed = places.join(plan, inside).withColumn("sequence_id", F.col("r_sequence") + F.col("rank") - F.col("r_first"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", offset.alias("offset"))


def _range_table(ranges: list[tuple[int, int, int, int]]) -> pa.Table:
    columns = list(zip(*ranges, strict=True)) or [(), (), (), ()]
    return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(("r_length", "r_first", "r_end", "r_sequence"), columns, strict=True)})
