"""Exact dedup by deterministic block naming, with DataFrame functions only.

A normalised text is cut into blocks of a fixed number of bytes.  The distinct blocks are sorted and their place in
that order is their integer name; then adjacent names are paired, the distinct pairs are sorted and named in turn,
and so on until a document has one name.  Equal names at equal depth mean equal texts: no name rests on a hash.

* The order of blocks is (64-bit mark, bytes).  Blocks meet by mark, at most one group of distinct blocks per mark,
  aggregated before the shuffle so that a block which a third of all documents share is sent once per task.
* A document keeps its marks only.  A mark that just one distinct block has stands for that block; where several
  blocks share a mark (``mark`` can be replaced to force it), blocks travel with their bytes and are compared.
* Names are (leading bits of the order, place among those): global order without one global task.

Edge cases: a null text counts as empty, and empty texts are equal; a null doc_id loses to any other; of repeated
rows with the kept doc_id exactly one is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arclake.llm.common import fresh, materialize, quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 4096


def ascii_lower(text: Column) -> Column:
    """A-Z alone become a-z; a text of single bytes takes the byte-wise path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _blocks(data: Column, size: int) -> Column:
    """The blocks of a binary column, one (empty) block at least."""
    last = F.greatest(F.ceil(F.octet_length(data) / size).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _named(distinct: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """Integer names of distinct rows: their place within a bucket, below the bucket's own number."""
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)).cast("long")
    return distinct.withColumn("__bucket", bucket).withColumn("name", F.shiftleft(F.col("__bucket").cast("long"), 40) + place).drop("__bucket")


def document_names(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, mark: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, text_sha256, n_blocks, and its identity (depth, name)."""
    data = ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), data.alias("data"))
    blocks = base.select(F.explode(_blocks(F.col("data"), block_bytes)).alias("block"))
    met = blocks.select(mark(F.col("block")).alias("mark"), "block").groupBy("mark").agg(F.collect_set("block").alias("blocks"))
    several = F.size("blocks") > 1
    met = materialize(met.select("mark", F.size("blocks").alias("n"), F.when(several, F.array_sort("blocks")).alias("blocks")))
    shared = bool(met.filter("n > 1").limit(1).count())
    marks = F.transform(_blocks(F.col("data"), block_bytes), lambda b: mark(b))
    rows = base.select("doc_id", F.sha2("data", 256).alias("text_sha256"), marks.alias("marks"), *(["data"] if shared else [])).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows)
    each = met.select("mark", F.explode(F.when(F.col("n") > 1, F.col("blocks")).otherwise(F.array(F.lit(None).cast("binary")))).alias("block"))
    names = materialize(_named(each, F.shiftrightunsigned(F.col("mark"), 48) if mark is F.xxhash64 else F.pmod("mark", F.lit(65536)), ["mark", "block"]))
    if shared:
        own = F.transform(_blocks(F.col("data"), block_bytes), lambda b: F.struct(mark(b).alias("mark"), b.alias("block")))
        at = rows.select("row", F.size("marks").alias("n"), F.posexplode(own).alias("pos", "own")).select("row", "n", "pos", "own.mark", "own.block")
        names = names.select(F.col("mark").alias("m"), F.col("block").alias("b"), "name")
        state = at.join(names, (at["mark"] == names["m"]) & (names["b"].isNull() | (at["block"] == names["b"])))
    else:
        at = rows.select("row", F.size("marks").alias("n"), F.posexplode("marks").alias("pos", "mark"))
        state = at.join(names.select("mark", "name"), "mark")
    state = materialize(state.select("row", "n", "pos", "name"))
    ended = [state.filter("n = 1").select("row", F.lit(0).alias("depth"), "name")]
    longest, depth = rows.agg(F.max(F.size("marks"))).first()[0] or 1, 0
    while longest > 1:
        depth, longest = depth + 1, -(-longest // 2)
        half = F.col("pos") % 2
        pairs = state.filter("n > 1").groupBy("row", F.expr("pos div 2").cast("int").alias("pos"))
        pairs = pairs.agg(F.max("n").alias("n"), F.max(F.when(half == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("right"))
        pairs = materialize(pairs)
        names = materialize(_named(pairs.select("left", "right").distinct(), F.pmod(F.xxhash64("left", "right"), F.lit(65536)), ["left", "right"]))
        state = pairs.join(names, ["left", "right"]).select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name")
        state = materialize(state)
        ended.append(state.filter("n = 1").select("row", F.lit(depth).alias("depth"), "name"))
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    return rows.select("row", "doc_id", "text_sha256", F.size("marks").alias("n_blocks")).join(found, "row")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, mark: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_blocks.

    Of equal normalised texts the row with the largest doc_id stays.
    """
    named = materialize(document_names(docs, doc_id, text, block_bytes, mark))
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row"))
    groups = named.groupBy("depth", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = materialize(groups.select("depth", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")))
    joined = named.join(groups, ["depth", "name"])
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "n_blocks")


def keep_distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows with the kept doc_id one stays."""
    own, id_, print_, times = fresh(docs, "own", "id", "print", "times")
    groups = exact_dedup(docs, doc_id, text).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = groups.groupBy(F.col("text_sha256").alias(print_)).agg(F.first("doc_id").alias(id_), F.count(F.lit(1)).alias(times))
    kept = materialize(kept)
    keyed = docs.withColumn(own, F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256))
    same = (F.col(own) == F.col(print_)) & F.col(doc_id).cast("long").eqNullSafe(F.col(id_))
    out = keyed.join(kept.filter(F.col(times) == 1), same, "left_semi")
    if not kept.filter(F.col(times) > 1).isEmpty():  # the kept doc_id stands on several rows
        out = out.union(keyed.join(kept.filter(F.col(times) > 1), same, "left_semi").dropDuplicates([own, doc_id]))
    return out.select(*quoted(out, (own,)))


ORACLE = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS k FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY k) AS kept, sha256(k) AS text_sha256
FROM t
"""
