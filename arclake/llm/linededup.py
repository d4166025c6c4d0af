"""Line dedup by deletion neighbourhoods, with DataFrame functions only.

Two lines within one edit share a string that is left when one character is deleted (or one of them is that string of
the other).  A line's variants are emitted as hashed keys, equal keys are joined, the edit distance is verified and
the earliest line stays.

A line has as many variants as characters, so the place of the edit is narrowed down first: a line is cut into at
least three pieces, and lines that agree in everything but one piece share a hashed key of all the rest.  Only lines
that share such a key with another line emit variants, and only those that delete inside that piece.  The edit of
any two lines within the bound falls into some piece, so no pair is lost.  Pieces are hashed once each, and the key of a
rest is the exclusive or of its pieces' hashes; pieces grow with the root of very long lines, so that the work for a line
is about linear in its length.

A group of equal keys is never listed.  Its members that lack the same character position are pairwise within one
edit, and so are those that were shortened and the one line that equals the key; the least line of each kind settles
the whole group, by partial aggregation.  A line goes if an earlier line of the input is equal or near.

The bound is relative: two lines are near when one edit is at most a ``least``-th of the longer one, so that short lines,
whose single characters are their meaning, must be equal (``least`` = 1 lets lines of any length be near).

Edge cases: a null text has no lines; an empty one has one empty line; lines without visible characters always stay; a
null doc_id comes last; of lines at the same place of rows that repeat a doc_id exactly one stays; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclake.llm.common import materialize

PIECE = 128
LEAST = 16
#: Bits of the filter of wanted lines for each of them, and its 64-bit words at most (4 MB).
FILTER_BITS, FILTER_MOST = 16, 1 << 19


def _width(n: Column) -> Column:
    """Characters of a piece for lines of ``n`` characters: a third, at least 4 and at most ``PIECE``, or the root of ``n``."""
    return F.greatest(F.lit(4), F.least(F.lit(PIECE), F.ceil(n / 3).cast("int")), F.ceil(F.sqrt(n)).cast("int"))


def _count(n: Column) -> Column:
    return F.ceil(n / _width(n)).cast("int")


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))


def _before(hashes: Column) -> Column:
    """Exclusive or of what stands before each place, and of all at last."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(hashes, start, lambda s, h: F.struct(s["x"].bitwiseXOR(h).alias("x"), F.concat(s["out"], F.array(s["x"])).alias("out")), lambda s: F.concat(s["out"], F.array(s["x"])))


def _pieces(line: Column, width: Column) -> Column:
    """All pieces in one pass over the line."""
    return F.regexp_extract_all(line, F.concat(F.lit("(?s).{1,"), width.cast("string"), F.lit("}")), F.lit(0))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _own_keys(line: Column, n: Column) -> Column:
    """Keys of all but one piece, piece by piece."""
    hashes = F.transform(_pieces(line, _width(n)), lambda x, i: F.xxhash64(i, x))
    keys = lambda own, all_: F.transform(own, lambda h, j: F.xxhash64(n, j, all_.bitwiseXOR(h)))
    return _with(hashes, lambda own: _with(_xor(own), lambda all_: keys(own, all_)))


def _short_keys(line: Column, n: Column) -> Column:
    """Keys as the shorter of two lines: pieces of ``n`` + 1 characters, of which one lacks a character."""
    longer = n + 1
    width = _width(longer)
    left = _before(F.transform(_pieces(line, width), lambda x, i: F.xxhash64(i, x)))
    right = _before(F.transform(_pieces(F.substring(line, width, F.lit(1 << 30)), width), lambda x, i: F.xxhash64(i + 1, x)))

    def keys(both: Column) -> Column:
        rest = lambda j: F.get(both["left"], j).bitwiseXOR(F.get(both["right"], j)).bitwiseXOR(both["all"])
        return F.transform(F.sequence(F.lit(0), _count(longer) - 1), lambda j: F.xxhash64(longer, j, rest(j)))

    ends = lambda r: F.struct(left.alias("left"), r.alias("right"), F.element_at(r, -1).alias("all"))
    return _with(right, lambda r: _with(ends(r), keys))


def _three(line: Column, n: Column, skipped: Column) -> Column:
    """The same keys for lines of three pieces at most, by substrings; ``skipped`` characters are left out."""
    width = _width(n)
    at = lambda j: j * width
    return F.transform(F.sequence(F.lit(0), _count(n) - 1), lambda j: F.xxhash64(n, j, F.substring(line, F.lit(1), at(j)), F.substring(line, at(j) + skipped + 1, F.lit(1 << 30))))


def _keys(line: Column, n: Column, least: int) -> Column:
    """Keys of a line as itself, then as the shorter of two, as far as their longer line may be near another."""
    few = 3 * PIECE - 1  # the shorter of two lines is cut as the longer
    own = F.when(n < least, F.array().cast("array<bigint>")).when(n <= few, _three(line, n, _width(n))).otherwise(_own_keys(line, n))
    short = F.when(n < few, _three(line, n + 1, _width(n + 1) - 1)).otherwise(_short_keys(line, n))
    return F.when(n + 1 >= least, F.concat(own, short))


def _without(line: Column, place: Column) -> Column:
    """A line without the character at a place from 1; the whole line for -1."""
    return F.when(place < 0, line).otherwise(F.concat(F.substring(line, F.lit(1), place - 1), F.substring(line, place + 1, F.lit(1 << 30))))


def _variants(line: Column, n: Column, key: Column, slot: Column, least: int) -> Column:
    """(variant key, deleted place) of a piece; a whole line stands for the variant it equals, with place -1."""
    own = F.when(n < least, 0).otherwise(_count(n))
    whole = slot >= own
    width = F.when(whole, _width(n + 1)).otherwise(_width(n))
    at = F.when(whole, slot - own).otherwise(slot) * width
    inside = F.substring(line, at + 1, F.when(whole, width - 1).otherwise(width))
    deleted = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x), F.lit(1))), lambda i: F.struct(F.xxhash64(key, _without(x, i)).alias("variant"), (at + i).alias("place")))
    return F.when(whole, F.array(F.struct(F.xxhash64(key, inside).alias("variant"), F.lit(-1).alias("place")))).otherwise(_with(inside, deleted))


def _may_be_in(h: Column, wanted: DataFrame) -> Column:
    """Whether a hash may be among those of ``wanted``, by a filter that grows with their number up to ``FILTER_MOST`` words.

    The filter is one array, a scalar subquery; it keeps other lines out of a shuffle, and what it lets through by mistake
    joins nothing there.
    """
    words = 1 << min(FILTER_MOST.bit_length() - 1, max(6, (wanted.count() * FILTER_BITS // 64).bit_length()))
    word, bit = (lambda x: x.bitwiseAND(F.lit(words - 1).cast("long"))), (lambda x: F.call_function("shiftrightunsigned", x, F.lit(40)).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    own = wanted.select(word(F.col("h1")).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h1"))).alias("bits"))
    own = own.groupBy("id").agg(F.bit_or("bits").alias("bits"))
    dense = wanted.sparkSession.range(words).join(own, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    filter_ = materialize(dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda w: w["bits"]).alias("bits")))
    found = F.element_at(filter_.scalar(), (word(h) + 1).cast("int"))
    return F.call_function("shiftrightunsigned", found, bit(h)).bitwiseAND(F.lit(1).cast("long")) == 1


PLACE = ("unnamed", "doc_id", "at", "row")


def line_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Occurrences (row, doc_id, at, line hashes, blank) and the hashes of the distinct lines that go with what they copy."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lines = base.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("at", "line"))
    hashed = lines.select("row", "doc_id", F.col("doc_id").isNull().alias("unnamed"), F.coalesce("at", F.lit(-1)).alias("at"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.col("line").rlike(r"\S").alias("seen"), "line", F.char_length("line").alias("n"))
    table = materialize(hashed.withColumn("keys", F.when(F.col("seen"), _keys(F.col("line"), F.col("n"), least))).drop("line"))
    told = table.filter("seen")
    first = materialize(told.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("first")))
    # Keys of all but one piece that two different lines share.
    each = table.filter("keys is not null").select("h1", "h2", F.posexplode("keys").alias("slot", "key"))
    shared = materialize(each.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key"))
    near = materialize(each.join(shared, "key", "left_semi").select("h1", "h2", "slot", "key").distinct())
    # Their texts, once each, and the deletion neighbourhood of the piece.
    wanted = materialize(near.select("h1", "h2").distinct())
    again = base.select(F.explode(F.split("text", "\n", -1)).alias("line")).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "line")
    again = again.filter(_may_be_in(F.col("h1"), wanted))
    texts = materialize(again.join(wanted, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line")))
    known = texts.join(first, ["h1", "h2"]).withColumn("n", F.char_length("line"))
    order = F.struct("first", "h1", "h2")
    variants = known.join(near, ["h1", "h2"]).select(order.alias("own"), F.explode(_variants(F.col("line"), F.col("n"), F.col("key"), F.col("slot"), least)).alias("v")).select("own", "v.variant", "v.place")
    variants = materialize(variants)
    kinds = materialize(variants.groupBy("variant", "place").agg(F.min("own").alias("least")))
    of = lambda line, place: F.struct(line.alias("line"), place.alias("place"))
    shortened, whole = F.min(F.when(F.col("place") >= 0, of(F.col("least"), F.col("place")))), F.min(F.when(F.col("place") < 0, of(F.col("least"), F.col("place"))))
    groups = kinds.groupBy("variant").agg(shortened.alias("shortened"), whole.alias("whole"))
    joined = variants.join(kinds, ["variant", "place"]).join(materialize(groups), "variant")
    beside = F.when(F.col("least") < F.col("own"), of(F.col("least"), F.col("place")))
    earlier = F.when(F.col("place") < 0, F.col("shortened")).otherwise(F.least(beside, F.col("whole")))
    pairs = joined.select("own", "place", earlier.alias("other")).filter("other.line < own").distinct()
    pairs = pairs.select(F.col("own.h1").alias("h1"), F.col("own.h2").alias("h2"), "place", F.col("other.line.h1").alias("o1"), F.col("other.line.h2").alias("o2"), F.col("other.place").alias("other_place"))
    other = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other"))
    # One edit: the same string is left without one character of either, or of one of them.
    checked = pairs.join(texts, ["h1", "h2"]).join(other, ["o1", "o2"]).filter(_without(F.col("line"), F.col("place")) == _without(F.col("other"), F.col("other_place")))
    gone = checked.select("h1", "h2").distinct()
    return table.select(*PLACE, "h1", "h2", "seen"), materialize(first.join(gone.withColumn("near", F.lit(True)), ["h1", "h2"], "left"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_lines, n_equal and n_near (lines that go), removed (their numbers from 0)."""
    table, verdicts = line_verdicts(docs, doc_id, text, least)
    judged = table.join(verdicts, ["h1", "h2"], "left")
    near = F.col("seen") & F.coalesce("near", F.lit(False))
    equal = F.col("seen") & (F.struct(*PLACE) != F.col("first")) & ~near
    rows = judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.count_if(F.col("at") >= 0).alias("n_lines"), F.count_if(equal).alias("n_equal"), F.count_if(near).alias("n_near"),
        F.array_sort(F.collect_list(F.when(equal | near, F.col("at")))).alias("removed"),
    )
    return rows.drop("row")


ORACLE = """
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
f AS (SELECT line, min({'d': doc_id, 'a': pos}) AS first, length(line) AS n FROM l WHERE regexp_matches(line, '[^\\x09-\\x0D\\x20]') GROUP BY line),
v AS (SELECT line, first, n, i, left(line, i - 1) || substr(line, i + 1) AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 16)),
near AS (
  SELECT line FROM (SELECT line, first, min(first) OVER (PARTITION BY rest, i) AS least FROM v) WHERE least < first
  UNION SELECT v.line FROM v JOIN f ON v.rest = f.line AND f.first < v.first
  UNION SELECT f.line FROM v JOIN f ON v.rest = f.line AND v.first < f.first
), j AS (
  SELECT l.doc_id, l.pos, near.line IS NOT NULL AS near, near.line IS NULL AND f.line IS NOT NULL AND f.first <> {'d': l.doc_id, 'a': l.pos} AS same
  FROM l LEFT JOIN f USING (line) LEFT JOIN near USING (line)
)
SELECT d.doc_id, count(j.pos) AS n_lines, count(*) FILTER (j.same) AS n_equal, count(*) FILTER (j.near) AS n_near,
       coalesce(string_agg(CAST(j.pos AS VARCHAR), ',' ORDER BY j.pos) FILTER (j.same OR j.near), '') AS removed
FROM documents d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id
"""
