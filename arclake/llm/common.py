"""What the corpus operators share: the shared folder, byte-wise words, packed exchanges.

Executors can be lost at any time, so lineage is cut only with Parquet tables in the folder that
``spark.checkpoint.dir`` names.  Nothing here uses a machine-local folder on a cluster.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclake.operators import staging
from arclake.operators.staging import release as release_tables  # noqa: F401
from arclake.operators.staging import shared_folder as shared_dir  # noqa: F401

#: A word is a maximal run of bytes other than these six, which is what ``bytes.split`` does too.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch while a table is written: texts are long, and a batch is held by the JVM and by Python.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    conf = df.sparkSession.conf
    usual = conf.get(_BATCH)
    conf.set(_BATCH, str(min(BATCH_ROWS, int(usual)) if int(usual) > 0 else BATCH_ROWS))
    try:
        return staging.stage(df)
    finally:
        conf.set(_BATCH, usual)


def bucket_count(spark: SparkSession, entries: int, most: int = 1 << 20) -> int:
    """Groups of a packed exchange: as many as hold ``most`` entries each, and one for each shuffle partition at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // most))


def new_seed() -> bytes:
    """What the prints of one run are keyed by; drawn by the driver and sent with the tasks."""
    return os.urandom(16)


def text_key(text: F.Column) -> F.Column:
    """128 bits of a text's SHA-256, by which it is fetched again."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def row_key(doc_id: F.Column, text: F.Column) -> F.Column:
    """128 bits of the SHA-256 of a row's doc_id and text, null told from empty."""
    known = F.concat(F.when(doc_id.isNull(), "n").otherwise("i"), F.when(text.isNull(), "n").otherwise("t"))
    return F.unhex(F.substring(F.sha2(F.concat_ws("\x00", known, F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"), 256), 1, 32))


def quoted(df: DataFrame, but: tuple[str, ...] = ()) -> list[F.Column]:
    """The columns of ``df``, whatever their names hold."""
    return [df["`" + c.replace("`", "``") + "`"] for c in df.columns if c not in but]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have."""
    known, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


#: Bits of a filter for each key it holds, and its 64-bit words at most (64 MB).
FILTER_BITS, FILTER_MOST = 16, 1 << 23


def _filter_place(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys % np.uint64(words)).astype(np.int64), (keys >> np.uint64(40)) & np.uint64(63)


def _key_words(column: pa.Array) -> np.ndarray:
    """64-bit keys, or the first eight bytes of 16-byte keys."""
    if pa.types.is_integer(column.type):
        return column.to_numpy().view(np.uint64)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)[:, 0]


def filter_of(keys: DataFrame, key: str) -> np.ndarray:
    """A filter of the keys of a table, as words of bits; it grows with their number, up to a fixed size.

    It only saves work: whatever it lets through by mistake is compared afterwards.
    """
    words = 1 << max(6, min(FILTER_MOST, keys.count() * FILTER_BITS // 64 + 1).bit_length())

    @tidied
    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = _filter_place(_key_words(batch.column(0)), words)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << bit).view(np.int64))], ["word", "bits"])

    table = keys.select(key).mapInArrow(bits_of, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filter_ = np.zeros(words, np.uint64)
    filter_[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return filter_


def passes(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word, bit = _filter_place(keys, len(filter_))
    return (filter_[word] >> bit & np.uint64(1)).astype(bool)


def among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose 16-byte ``key`` may be among those of ``keys``, a table: others stay out of the shuffle that follows."""
    sent = rows.sparkSession.sparkContext.broadcast(filter_of(keys, key))

    @tidied
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(sent.value, _key_words(batch.column(key)))))

    return rows.mapInArrow(through, rows.schema)


def tidied(run: Callable) -> Callable:
    """``run`` of a Python worker, which gives the memory it has freed back once a partition or group is done.

    Workers are kept for later stages, and what their allocators hold on to would add up with those.
    """

    @wraps(run)
    def wrapped(batches):
        out = run(batches)
        if isinstance(out, Iterator):
            return _then_tidy(out)
        _tidy()
        return out

    return wrapped


def _then_tidy(out: Iterator) -> Iterator:
    try:
        yield from out
    finally:
        _tidy()


def _tidy() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


_LIBC = ctypes.CDLL(None)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts reach ``most`` bytes, so very long texts do not add up in a worker."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that scatters them (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Bytes of text whose words are handled at once, and four-byte pieces of a word that are.
CHUNK = 1 << 20
PIECES = 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
#: Odd multipliers of the left and the right part of a run of words.
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(8)
def _multipliers(seed: bytes) -> np.ndarray:
    """Two rows of odd multipliers, for a word's length and for each of its pieces."""
    return np.frombuffer(hashlib.shake_256(seed).digest(16 * (PIECES + 1)), np.uint64).reshape(2, -1) | np.uint64(1)


def _chunk_prints(data: np.ndarray, seed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Prints of the words of a chunk, and where they start."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = last - first
    keys = _multipliers(seed)
    pieces = np.ndarray((len(data) + 1,), "<u4", np.concatenate((data, np.zeros(4, np.uint8))), strides=(1,))
    sums = [n.astype(np.uint64) * k[0] for k in keys]
    for j in range(min(PIECES, -(-int(n.max(initial=0)) // 4))):
        at = np.flatnonzero(n > 4 * j) if j else slice(None)
        piece = (pieces[first[at] + 4 * j] & _MASKS[np.minimum(n[at] - 4 * j, 4)]).astype(np.uint64)
        for s, k in zip(sums, keys, strict=True):
            s[at] += piece * k[j + 1]
    out = np.stack([mix64(s) for s in sums], axis=1)
    for i in np.flatnonzero(n > 4 * PIECES).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(data[first[i] : last[i]], digest_size=16, key=seed[:64]).digest(), np.uint64)
    return out, first


def word_prints(texts: list[bytes | None], seed: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """128-bit prints of the words of all texts in a row (two 64-bit columns), and the number of words of each text.

    A print is a pair of multilinear hashes of a word's pieces with multipliers drawn from ``seed``, or a keyed BLAKE2b of
    a long word.  Operators draw the seed anew for each run, so that no words can be made to collide.
    """
    data = np.frombuffer(b"\n".join(x or b"" for x in texts), np.uint8)
    prints, starts, at = [], [], 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not _SPACE[data[end]]:  # a chunk ends between words
            ahead = np.flatnonzero(_SPACE[data[end : end + 4096]])
            end = end + int(ahead[0]) if len(ahead) else end + 4096
        own, first = _chunk_prints(data[at:end], seed)
        prints.append(own)
        starts.append(first + at)
        at = end
    if not prints:
        return np.zeros((0, 2), np.uint64), np.zeros(len(texts), np.int64)
    offsets = np.cumsum([0, *(len(x or b"") + 1 for x in texts)])
    return np.concatenate(prints), np.diff(np.searchsorted(np.concatenate(starts), offsets))


def hash_words(texts: list[bytes | None], seed: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """64-bit prints of the words of all texts in a row, and the number of words of each text."""
    prints, counts = word_prints(texts, seed)
    return mix64(prints[:, 0] + prints[:, 1] * _RIGHT), counts


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Prints of the ``k`` consecutive words that start at each place; one fewer place per extra word.

    Runs are put together from two shorter ones, whose prints are scattered at every step: unlike powers of one base,
    no regular arrangement of words (such as Thue-Morse) makes two runs meet.
    """
    out, have = h, 1
    while have < k:
        step = min(have, k - have)
        if len(out) <= step:
            return np.zeros(0, np.uint64)
        out = mix64(out[: len(out) - step] * _LEFT + out[step:] * _RIGHT + np.uint64(have))
        have += step
    return out


def ranked(df: DataFrame, keys: list[str], order: list, spread: F.Column, out: str = "rank", buckets: int = 256) -> DataFrame:
    """Number the rows of each key group from 0, with no group in one task.

    A group is cut into ``buckets`` by ``spread`` (a deterministic 64-bit hash of the row).  Rows are numbered
    within their bucket, and the small table of bucket sizes gives each bucket its first number.  The order of the
    whole group is (bucket, ``order``): seeded, and the same in every run.
    """
    from pyspark.sql import Window

    rows = df.withColumn("__bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    sizes = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = rows.withColumn("__row", F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)) - 1)
    same = F.col("__bucket") == F.col("__b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = inside.join(firsts, same, "inner")
    return joined.withColumn(out, (F.col("__first") + F.col("__row")).cast("long")).drop("__bucket", "__row", "__first", "__b", *[f"__{k}" for k in keys])
