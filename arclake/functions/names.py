"""Archive entry names as column expressions: identity, safety, wire hashes, classes, masks.

Everything here stays inside Catalyst.  Unsigned 64-bit hashes are longs that hold the bit pattern; ``unsigned`` gives
their order.  Case folding is ASCII only, wherever the format says so.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MASK32 = 0xFFFFFFFF

# Fixed values of the archive formats: asset roots in order of precedence, the extensions of each class for names
# without such a root, and the file-flag bits that a class contributes (the last is the class of everything else).
ROOTS = ("meshes", "textures", "materials", "geometries", "sound\\voice", "sound", "music", "scripts\\source", "source\\scripts", "scripts", "strings", "trees", "video", "lodsettings", "distantlod", "interface", "programs", "menus", "fonts", "facegen", "lsdata", "shaders", "shadersfx", "grass", "vis", "seq", "dialogueviews", "bookart", "icons", "splash")
EXTENSIONS = (".nif .kf .kfm .egm .egt .tri .psa .hkt .hkx .ssf .btr .bto .btt .dtl", ".dds .tga .png", ".bgsm .bgem", ".mesh", ".lip .wav .xwm .mp3 .ogg .fuz", ".wav .xwm .ogg", ".xwm .mp3", ".psc", ".psc", ".pex .psc", ".strings .ilstrings .dlstrings", ".spt", ".bik .bk2", ".lodsettings .dlodsettings .lod", ".cmp .lod", ".swf .png .txt", ".swf", ".xml .htm .txt .scc .bat", ".fnt .tex", ".ctl", ".dat", ".sdp", ".fxp", ".gid", ".uvd", ".seq", ".xml", ".dds .tga", ".dds .tga", ".dds .tga")
CONTRIBUTIONS = (1, 2, 256, 256, 16, 8, 256, 256, 256, 256, 256, 64, 256, 257, 257, 256, 256, 32, 128, 256, 256, 256, 256, 256, 256, 256, 256, 256, 256, 256, 256)
RESERVED = r"(?:CON|PRN|AUX|NUL|COM[1-9¹²³]|LPT[1-9¹²³])"
#: Folders of made-up names, for entries whose own names are absent or unreadable; parameters of this library.
SYNTHETIC_HASH, SYNTHETIC_WIRE = "__arclake_hash__", "__arclake_wire__"
UNSUPPORTED_TES3_ROOTS = ("sound", "music", "video", "fonts", "splash")
EXTENSION_BITS = ((".kf", 0x80), (".nif", 0x8000), (".dds", 0x8080), (".wav", 0x80000000))
FOLD = 65599


def ascii_fold(name: Column) -> Column:
    return F.translate(name, UPPER, LOWER)


def separators(name: Column) -> Column:
    return F.translate(name, "/", "\\")


def segments(name: Column) -> Column:
    return F.split(separators(name), r"\\", -1)


def is_ascii(name: Column) -> Column:
    return F.octet_length(name) == F.char_length(name)


def is_ansi(name: Column) -> Column:
    """Every character has a byte in windows-1252."""
    high = "".join(bytes([b]).decode("cp1252", "ignore") for b in range(128, 256))
    return name.rlike(rf"\A[\x00-\x7f{high}]*\z")


def is_safe(name: Column) -> Column:
    """Non-empty, no NUL or colon, and no segment that is empty, dots, or ends in a blank or dot."""
    bad = F.exists(segments(name), lambda s: (s == "") | s.endswith(" ") | s.endswith("."))
    return (name != "") & ~name.contains("\x00") & ~name.contains(":") & ~bad


def identity(name: Column) -> Column:
    """Backslashes, A-Z folded; null where the name is not structurally safe."""
    return F.when(is_safe(name), ascii_fold(separators(name)))


def canonical(name: Column) -> Column:
    """Wire form of an ASCII name; null for others."""
    return F.when(is_ascii(name), ascii_fold(separators(name)))


def is_absolute(name: Column) -> Column:
    n = separators(name)
    return n.startswith("\\") | n.rlike(r"^[A-Za-z]:\\")


def traversal_ordinal(name: Column) -> Column:
    """Place of the first ``.`` or ``..`` segment, from 0; null without one."""
    found = F.array_position(F.transform(segments(name), lambda s: s.isin(".", "..")), F.lit(True))
    return F.when(found > 0, (found - 1).cast("long"))


def is_windows_invalid(name: Column) -> Column:
    """A control character, a character Windows refuses, or a reserved device name before the first dot."""
    pattern = rf"""[\x01-\x1f"*<>?|]|^(?i:{RESERVED})(?:\.|$)"""
    return F.exists(segments(name), lambda s: s.rlike(pattern))


_REFUSED = re.compile(rf"""[\x01-\x1f"*<>?|]|\A(?i:{RESERVED})(?:\.|\Z)""")


def refused_by_windows(segment: str) -> bool:
    """``is_windows_invalid`` of one segment, in plain Python."""
    return bool(_REFUSED.search(segment))


def basename(name: Column) -> Column:
    return F.substring_index(separators(name), "\\", -1)


def dirname(name: Column) -> Column:
    """What stands before the last separator, empty without one."""
    n = separators(name)
    return F.when(n.contains("\\"), F.substring(n, F.lit(1), F.char_length(n) - F.char_length(F.substring_index(n, "\\", -1)) - 1)).otherwise(F.lit(""))


def mask_pattern(mask: str) -> str:
    """A glob of ``*`` and ``?`` as an anchored regular expression over folded names."""
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in mask)
    return r"\A" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in fold) + r"\z"


def matches_masks(name: Column, masks: list[str]) -> Column:
    """Basename fits any mask; no mask keeps all."""
    if not masks:
        return F.lit(True)
    return ascii_fold(basename(name)).rlike("(?s)" + "|".join(mask_pattern(m) for m in masks))


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def _shl(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n.cast("int"))


def _shr(x: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, n.cast("int"))


def tes3_hash(name: Column) -> Column:
    """Two 32-bit halves: xor of the first half's bytes, xor and rotation of the second's; high half the rotated one."""
    codes = _codes(name)
    half = F.floor(F.size(codes) / 2).cast("int")
    low = F.aggregate(F.transform(F.slice(codes, 1, half), lambda b, i: _shl(b, (i * 8) % 32)), F.lit(0).cast("long"), lambda a, s: a.bitwiseXOR(s))

    def turn(a: Column, s: Column) -> Column:
        x, r = a.bitwiseXOR(s), s.bitwiseAND(F.lit(31))
        return _shr(x, r).bitwiseOR(_shl(x, 32 - r)).bitwiseAND(F.lit(MASK32))

    rest = F.transform(F.slice(codes, half + 1, F.greatest(F.size(codes) - half, F.lit(0))), lambda b, i: _shl(b, (i * 8) % 32))
    high = F.aggregate(rest, F.lit(0).cast("long"), turn)
    return _shl(high, F.lit(32)).bitwiseOR(low)


def stem_and_extension(base: Column) -> tuple[Column, Column]:
    """A basename cut before its last dot; the extension keeps the dot and is empty without one."""
    dotted = base.contains(".")
    n = F.when(dotted, F.char_length(base) - F.char_length(F.substring_index(base, ".", -1)) - 1).otherwise(F.char_length(base))
    return F.substring(base, F.lit(1), n), F.substring(base, n + 1, F.lit(1 << 30))


def bsa_hash_of(stem: Column, ext: Column) -> Column:
    """Versioned hash of a folder (no extension) or of the two parts of a basename: end points and length below, folded
    middle and extension above.

    The parts are used several times: give them as columns of their own where many names are hashed.
    """
    n = F.char_length(stem)
    code = lambda i: F.ascii(F.substring(stem, i, F.lit(1))).cast("long")
    low = code(n).bitwiseOR(_shl(n.cast("long").bitwiseAND(F.lit(255)), F.lit(16))).bitwiseOR(_shl(code(F.lit(1)), F.lit(24)))
    low = low.bitwiseOR(F.when(n > 2, _shl(code(n - 1), F.lit(8))).otherwise(F.lit(0).cast("long")))
    bits = F.lit(0).cast("long")
    for text, value in EXTENSION_BITS:
        bits = F.when(ext == text, F.lit(value).cast("long")).otherwise(bits)
    fold = lambda text: F.aggregate(_codes(text), F.lit(0).cast("long"), lambda a, b: (a * FOLD + b).bitwiseAND(F.lit(MASK32)))
    high = (fold(F.substring(stem, F.lit(2), F.greatest(n - 3, F.lit(0)))) + fold(ext)).bitwiseAND(F.lit(MASK32))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(_shl(high, F.lit(32)).bitwiseOR(low.bitwiseOR(bits)))


def with_bsa_hash(rows: DataFrame, out: str, component: Column, is_basename: bool) -> DataFrame:
    """Adds the hash of a folder or basename, by projections that each use short expressions."""
    rows = rows.withColumn("__component", component)
    stem, ext = stem_and_extension(F.col("__component")) if is_basename else (F.col("__component"), F.lit(""))
    rows = rows.withColumns({"__stem": stem, "__ext": ext})
    return rows.withColumn(out, bsa_hash_of(F.col("__stem"), F.col("__ext"))).drop("__component", "__stem", "__ext")


def ba2_hash(text: Column) -> Column:
    """CRC-32 that starts at zero and is not inverted: the checksums of a text and of as many zero bytes differ by it."""
    data = text.cast("binary")
    return F.crc32(data).bitwiseXOR(F.crc32(F.repeat(F.lit("\x00"), F.octet_length(data)).cast("binary")))


def ba2_identity(name: Column) -> Column:
    """base_hash, extension (four bytes, NUL padded) and dir_hash of an ASCII name."""
    c = canonical(name)
    base = basename(c)
    dotted = base.contains(".")
    ext = F.when(dotted, F.substring_index(base, ".", -1)).otherwise(F.lit(""))
    stem = F.when(dotted, F.substring(base, F.lit(1), F.char_length(base) - F.char_length(ext) - 1)).otherwise(base)
    return F.struct(ba2_hash(stem).alias("base_hash"), F.rpad(ext, 4, "\x00").cast("binary").alias("extension"), ba2_hash(dirname(c)).alias("dir_hash"))


def unsigned(h: Column) -> Column:
    """Sort key of a 64-bit pattern as an unsigned number."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def _hex(x: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(x)), digits, "0")


def synthetic_bsa_name(folder: Column, folder_hash: Column, ordinal: Column, name_hash: Column) -> Column:
    return F.concat(F.lit(f"{SYNTHETIC_HASH}\\f"), _hex(folder, 8), F.lit("-"), _hex(folder_hash, 16), F.lit("\\e"), _hex(ordinal, 8), F.lit("-"), _hex(name_hash, 16))


def synthetic_ba2_name(dir_hash: Column, ordinal: Column, base_hash: Column, extension: Column) -> Column:
    return F.concat(F.lit(f"{SYNTHETIC_HASH}\\d"), _hex(dir_hash, 8), F.lit("\\e"), _hex(ordinal, 8), F.lit("-"), _hex(base_hash, 8), F.lit("-x"), F.lower(F.hex(extension)))


def synthetic_wire_name(ordinal: Column) -> Column:
    return F.concat(F.lit(f"{SYNTHETIC_WIRE}\\e"), _hex(ordinal, 8))


def _numbers(keys: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in keys.items() for x in pair))


#: Class by root folder, and by extension where several classes know it the first of them.
_BY_ROOT = {root: i for i, root in enumerate(ROOTS)}
_BY_EXTENSION = {ext: i for i, known in reversed(list(enumerate(EXTENSIONS))) for ext in known.split(" ")}


def asset_class(key: Column) -> Column:
    """0 to 29 by root folder, else by final extension; 30 for the rest.  ``key`` is an identity.

    A root of two folders stands before the one of its first folder; both are looked up in literal maps.
    """
    base = basename(key)
    ext = F.when(base.contains("."), F.concat(F.lit("."), F.substring_index(base, ".", -1)))
    roots, extensions = _numbers(_BY_ROOT), _numbers(_BY_EXTENSION)
    folder = [F.try_element_at(roots, F.substring_index(key, "\\", n)) for n in (2, 1)]
    return F.when(key.isNotNull(), F.coalesce(*folder, F.try_element_at(extensions, ext), F.lit(len(ROOTS)))).otherwise(F.lit(len(ROOTS)))


def contribution(class_number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CONTRIBUTIONS]), class_number + 1).cast("long")


def has_unsupported_tes3_root(name: Column) -> Column:
    n = ascii_fold(separators(name))
    return n.contains("\\") & F.substring_index(n, "\\", 1).isin(*UNSUPPORTED_TES3_ROOTS)


def split_path(path: Column, part: Column) -> Column:
    """Insert a part number before the last dot of the file name, or append it."""
    name = F.regexp_extract(path, r"[^/\\]*$", 0)
    stem = F.substring(path, F.lit(1), F.char_length(path) - F.char_length(F.substring_index(name, ".", -1)) - 1)
    numbered = F.concat(stem, part.cast("string"), F.lit("."), F.substring_index(name, ".", -1))
    return F.when(name.contains("."), numbered).otherwise(F.concat(path, part.cast("string")))
