"""Payload codecs: stored, zlib, LZ4 frames and raw LZ4 blocks, with exact consumption and exact sizes.

Pure functions over bytes plus Arrow-batched column forms.  LZ4 is encoded at the library's highest level.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the LZ4 frame and block formats.
FRAME_MAGIC = 0x184D2204
FRAME_FLAGS = 0x60  # version 1, independent blocks, no checksums, no content size
FRAME_BLOCK = 0x70  # blocks of at most 4 MiB
BLOCK_BYTES = 4 << 20
STORED_BLOCK = 0x80000000
LEAST_MATCH, LAST_LITERALS, MATCH_LIMIT, FARTHEST = 4, 5, 12, 0xFFFF
RAW_DECODED_LIMIT = 16 << 20
CODECS = ("stored", "zlib", "lz4_frame", "lz4_raw")


class CodecError(ValueError):
    """``codec.invalid-data``, ``codec.size-mismatch`` or ``codec.dispatch-limit``."""


#: Level of the native encoder; the highest that the block format's library knows.
LZ4_LEVEL = 12


def lz4_block_encode(data: bytes) -> bytes:
    return pa.Codec("lz4_raw", compression_level=LZ4_LEVEL).compress(data, asbytes=True) if data else b"\0"


def _native(data: bytes, kind: str, size: int) -> bytes | None:
    """The native decoder's answer where it has exactly ``size`` bytes: they fit, and one byte less does not."""
    codec = pa.Codec(kind)
    try:
        out = codec.decompress(data, size, asbytes=True)
    except (OSError, pa.ArrowInvalid):
        return None
    try:
        codec.decompress(data, size - 1)
    except (OSError, pa.ArrowInvalid):
        return out
    return None


def lz4_block_decode(data: bytes, size: int) -> bytes:
    """Decoded by the library; a block that it refuses is walked here, which names the fault."""
    if size > 1 and (found := _native(data, "lz4_raw", size)) is not None:
        return found
    out, at = bytearray(), 0
    try:
        while True:
            token = data[at]
            at += 1
            n = token >> 4
            if n == 15:
                while True:
                    more = data[at]
                    at += 1
                    n += more
                    if more != 255:
                        break
            if at + n > len(data):
                raise CodecError("codec.invalid-data")
            out += data[at : at + n]
            at += n
            if at == len(data):
                break
            distance = data[at] | data[at + 1] << 8
            at += 2
            n = (token & 15) + LEAST_MATCH
            if token & 15 == 15:
                while True:
                    more = data[at]
                    at += 1
                    n += more
                    if more != 255:
                        break
            if not 0 < distance <= len(out):
                raise CodecError("codec.invalid-data")
            start = len(out) - distance
            if distance >= n:
                out += out[start : start + n]
            else:
                out += (bytes(out[start:]) * (n // distance + 1))[:n]
            if len(out) > size:
                raise CodecError("codec.size-mismatch")
    except IndexError:
        raise CodecError("codec.invalid-data") from None
    if len(out) != size:
        raise CodecError("codec.size-mismatch")
    return bytes(out)


def lz4_frame_encode(data: bytes) -> bytes:
    import xxhash

    head = bytes([FRAME_FLAGS, FRAME_BLOCK])
    out = bytearray(struct.pack("<I", FRAME_MAGIC) + head + bytes([xxhash.xxh32_intdigest(head) >> 8 & 255]))
    for at in range(0, len(data), BLOCK_BYTES):
        block = data[at : at + BLOCK_BYTES]
        packed = lz4_block_encode(block)
        stored = len(packed) >= len(block)
        out += struct.pack("<I", len(block) | STORED_BLOCK if stored else len(packed)) + (block if stored else packed)
    return bytes(out + struct.pack("<I", 0))


def _block_size(data: bytes) -> int:
    """Decoded bytes of a block, by walking its sequences."""
    total = at = 0
    while at < len(data):
        token, at = data[at], at + 1
        counts = []
        for part in (token >> 4, token & 15):
            n = part
            if part == 15:
                while True:
                    more, at = data[at], at + 1
                    n += more
                    if more != 255:
                        break
            counts.append(n)
            if len(counts) == 1:
                at += n
                total += n
                if at >= len(data):
                    return total
                at += 2
        total += counts[1] + LEAST_MATCH
    return total


def lz4_frame_decode(data: bytes, size: int) -> bytes:
    """A frame that is used up and has ``size`` bytes; its headers are walked, its blocks decoded by the library."""
    import xxhash

    try:
        magic, flags, block = struct.unpack_from("<IBB", data)
        if magic != FRAME_MAGIC or flags >> 6 != 1 or flags & 2 or block & 0x8F:
            raise CodecError("codec.invalid-data")
        at = 6 + (8 if flags & 8 else 0) + (4 if flags & 1 else 0)
        if data[at] != xxhash.xxh32_intdigest(data[4:at]) >> 8 & 255 or flags & 1:
            raise CodecError("codec.invalid-data")
        at += 1
        blocks: list[tuple[bool, bytes]] = []
        while True:
            (n,) = struct.unpack_from("<I", data, at)
            at += 4
            if n == 0:
                break
            stored, n = bool(n & STORED_BLOCK), n & (STORED_BLOCK - 1)
            own = data[at : at + n]
            if len(own) < n:
                raise CodecError("codec.invalid-data")
            at += n + (4 if flags & 0x10 else 0)
            blocks.append((stored, own))
        at += 4 if flags & 4 else 0
        if at == len(data) and size > 1 and (found := _native(data, "lz4", size)) is not None:
            return found
        out = bytearray()
        for stored, own in blocks:
            out += own if stored else lz4_block_decode(own, _block_size(own))
            if len(out) > size:
                raise CodecError("codec.size-mismatch")
    except (struct.error, IndexError):
        raise CodecError("codec.invalid-data") from None
    if at != len(data) or len(out) != size:
        raise CodecError("codec.size-mismatch" if len(out) != size else "codec.invalid-data")
    return bytes(out)


def encode(data: bytes, codec: str) -> bytes:
    if codec == "stored":
        return data
    if codec == "zlib":
        return zlib.compress(data, 9)
    if codec == "lz4_frame":
        return lz4_frame_encode(data)
    if len(data) > RAW_DECODED_LIMIT:
        raise CodecError("codec.dispatch-limit")
    return lz4_block_encode(data)


def decode(data: bytes, codec: str, size: int) -> bytes:
    """The payload, or an error unless the stream is used up and has exactly ``size`` bytes."""
    if codec == "stored":
        out = data
    elif codec == "zlib":
        stream = zlib.decompressobj()
        try:
            out = stream.decompress(data, size + 1)
        except zlib.error:
            raise CodecError("codec.invalid-data") from None
        if not stream.eof and len(out) <= size or stream.unused_data:
            raise CodecError("codec.invalid-data")
    elif codec == "lz4_frame":
        return lz4_frame_decode(data, size)
    else:
        if size > RAW_DECODED_LIMIT:
            raise CodecError("codec.dispatch-limit")
        return lz4_block_decode(data, size)
    if len(out) != size:
        raise CodecError("codec.size-mismatch")
    return out


def decode_prefix(data: bytes, codec: str, most: int = 128) -> bytes:
    """At most the first ``most`` bytes; only the block formats decode further than they must."""
    if codec == "stored":
        return data[:most]
    if codec == "zlib":
        return zlib.decompressobj().decompress(data, most)
    if codec == "lz4_raw":
        return lz4_block_decode(data, _block_size(data))[:most]
    (n,) = struct.unpack_from("<I", data, 7)
    own = data[11 : 11 + (n & (STORED_BLOCK - 1))]
    return (own if n & STORED_BLOCK else lz4_block_decode(own, _block_size(own)))[:most]


def bound(size: Column, codec: str) -> Column:
    """Most bytes an encoder may need for ``size`` bytes."""
    if codec == "stored":
        return size
    if codec == "zlib":
        return size + F.call_function("shiftright", size, F.lit(12)) + F.call_function("shiftright", size, F.lit(14)) + F.call_function("shiftright", size, F.lit(25)) + 13
    raw = size + F.floor(size / 255).cast("long") + 16
    return raw if codec == "lz4_raw" else size + (F.floor(size / BLOCK_BYTES).cast("long") + 1) * 4 + 11


def encode_column(payload: Column, codec: Column) -> Column:
    @F.pandas_udf("binary")
    def run(data: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else encode(bytes(d), k) for d, k in zip(data, kinds, strict=True)], dtype=object)

    return run(payload.cast("binary"), codec)


def decode_column(payload: Column, codec: Column, size: Column) -> Column:
    """(content, error): a bad stream is a value, not a failed job."""

    @F.pandas_udf("content binary, error string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, kinds, sizes in parts:
            content, errors = [], []
            for d, k, n in zip(data, kinds, sizes, strict=True):
                try:
                    content.append(decode(bytes(d), k, int(n)))
                    errors.append(None)
                except CodecError as e:
                    content.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"content": pd.Series(content, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run(payload, codec, size)
