"""The driver's queries over the corpus operators, with production parameters, and their SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arclake.llm import exactdedup, jaccard, linededup, substring, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from arclake.llm.secrets import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_owner_specific", "n_widely_copied")


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from arclake.llm.substring import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return kept.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"), F.size("spans").alias("n_spans"))


ORACLE_SQL["op4_substring_dedup"] = substring.ORACLE


@query
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from arclake.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLE_SQL["op7_top_k"] = topk.ORACLE


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from arclake.llm.warc import capture_histories, read_warc, write_warc

    folder, files = write_warc(table(spark, sf_dir, "pages"), captured=F.pmod(F.col("page_id"), F.lit(1_000_000_000)))
    histories = capture_histories(read_warc(spark, folder, files))
    return histories.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


ORACLE_SQL["op5_warc"] = warc.ORACLE


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arclake.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats", "source")


@query
def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arclake.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arclake.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).drop("h")


ORACLE_SQL["op2_ngram_jaccard"] = jaccard.ORACLE


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arclake.llm.exactdedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_blocks")


ORACLE_SQL["op3_exact_dedup"] = exactdedup.ORACLE


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arclake.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from arclake.llm.linededup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


ORACLE_SQL["op10_line_dedup"] = linededup.ORACLE


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
