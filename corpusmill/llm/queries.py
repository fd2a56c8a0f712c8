"""The operators applied to their whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import quality, warc
from corpusmill.llm.bpe import encode_digests
from corpusmill.llm.exact_dedup import exact_dedup
from corpusmill.llm.line_dedup import line_classes
from corpusmill.llm.packing import pack
from corpusmill.llm.sharding import write_shards
from corpusmill.llm.simhash import near_duplicates
from corpusmill.llm.token_counts import token_counts
from corpusmill.llm.token_files import read_by_key, write_token_files
from corpusmill.session import scratch_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; every executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, with its class, the class's number of links, and whether it goes."""
    return line_classes(_documents(spark, sf_dir)).drop("rid")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_documents(spark, sf_dir), shingle=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document to its shard, then reads the shards: doc_id, slot, shard and the text's digest."""
    written = write_shards(_documents(spark, sf_dir), ["doc_id"], scratch_path(spark, "shards"))
    return written.select("doc_id", "slot", "shard", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixity drill: every page is archived, the archive is copied, and one bit is flipped in one of 97 records of the copy."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = warc.fixity(pages, scratch_path(spark, "warc"), damage=warc.drill())
    return found.select("page_id", "file", "offset", "length", "sha256", "corrupt")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards, then looks every document up in them by its key."""
    docs = _documents(spark, sf_dir)
    files = write_token_files(docs, scratch_path(spark, "token-files"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    return read_by_key(docs.select("doc_id"), files)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    rules = quality.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(docs, rules).select("row.doc_id", *quality.STATS, "base_failed", "kept")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_token_files": op5_token_files,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_bpe": op9_bpe,
    "op10_token_counts": op10_token_counts,
}

ORACLES = {
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
}
