"""Texture arithmetic as column expressions: bits per pixel, block bytes, mip sizes, chunk plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format numbers (inclusive ranges) by bits per pixel, and by bytes of a 4 x 4 block.
BITS = {
    128: ((1, 4),),
    96: ((5, 8),),
    64: ((9, 22), (102, 102), (108, 109)),
    32: ((23, 47), (67, 69), (87, 93), (100, 101), (107, 107)),
    24: ((104, 105),),
    16: ((48, 59), (85, 86), (114, 115)),
    12: ((103, 103), (106, 106), (110, 110)),
    8: ((60, 65), (73, 78), (82, 84), (94, 99), (111, 113)),
    4: ((70, 72), (79, 81)),
    1: ((66, 66),),
}
BLOCKS = {8: ((70, 72), (79, 81)), 16: ((73, 78), (82, 84), (94, 99))}
LEGACY_WRITABLE = (28, 49, 61, 65, 71, 74, 77, 80, 81, 83, 84, 85, 86, 87, 88)
EXTENDED_WRITABLE = (29, 72, 75, 78, 91, 93, 95, 96, 98, 99)
MOST_CHUNKS = 4
SPLIT_SIDE = 512


def _ranged(table: dict[int, tuple[tuple[int, int], ...]], f: Column) -> Column:
    out = F.lit(0)
    for value, ranges in table.items():
        for lo, hi in ranges:
            out = F.when(f.between(lo, hi), value).otherwise(out)
    return out


def bits_per_pixel(f: Column) -> Column:
    return _ranged(BITS, f)


def block_bytes(f: Column) -> Column:
    return _ranged(BLOCKS, f)


def is_writable(f: Column) -> Column:
    return f.isin(*LEGACY_WRITABLE, *EXTENDED_WRITABLE)


def mip_side(side: Column, level: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.call_function("shiftright", side.cast("long"), level.cast("int")))


def mip_size(width: Column, height: Column, f: Column) -> Column:
    """Bytes of one image; blocks are whole however small the image is."""
    block = block_bytes(f)
    up = lambda side: F.floor((side.cast("long") + 3) / 4).cast("long")
    plain = (width.cast("long") * height.cast("long") * F.floor(bits_per_pixel(f) / 8)).cast("long")
    return F.when(block > 0, up(width) * up(height) * block).otherwise(plain)


def mip_sizes(width: Column, height: Column, mips: Column, f: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), mips.cast("int") - 1), lambda i: mip_size(mip_side(width, i), mip_side(height, i), f))


def chunk_count(width: Column, height: Column, mips: Column, cube: Column) -> Column:
    """One chunk a level while both sides are large, the rest together; a cube map is one chunk."""
    large = F.size(F.filter(F.sequence(F.lit(0), F.lit(MOST_CHUNKS - 2)), lambda i: (F.call_function("shiftright", F.least(width, height).cast("long"), i) >= SPLIT_SIDE) & (i < mips - 1)))
    return F.when(cube, 1).otherwise(large + 1)


def chunk_plan(width: Column, height: Column, mips: Column, f: Column, cube: Column) -> Column:
    """Chunks as (offset, size, first mip, last mip)."""
    sizes = mip_sizes(width, height, mips, f)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    payload = total(sizes) * F.when(cube, 6).otherwise(1)
    n = chunk_count(width, height, mips, cube)

    def one(i: Column) -> Column:
        before, last = total(F.slice(sizes, F.lit(1), i)), i == n - 1
        return F.struct(before.alias("offset"), F.when(last, payload - before).otherwise(F.element_at(sizes, i + 1)).alias("size"), i.alias("start_mip"), F.when(last, mips.cast("int") - 1).otherwise(i).alias("end_mip"))

    return F.transform(F.sequence(F.lit(0), n - 1), one)


def chunks_of(sizes: list[int], payload: int, side: int, cube: bool) -> list[tuple[int, int, int, int]]:
    """``chunk_plan`` of one texture from its level sizes and shorter side, in plain Python."""
    alone = [] if cube else [i for i in range(min(len(sizes), MOST_CHUNKS) - 1) if side >> i >= SPLIT_SIDE]
    edges = [sum(sizes[:i]) for i in range(len(alone) + 1)]
    lasts = [*alone, len(sizes) - 1]
    return [(at, to - at, i, last) for i, (at, to, last) in enumerate(zip(edges, [*edges[1:], payload], lasts, strict=True))]
