"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.llm import byte_bpe, mixing, quality_rules, secret_scan, simhash
from modelwatch.session import stored

#: Part of all tokens that the mix may hold, epochs a source may be read, seed of the orders.
SHARE, EPOCHS, SEED = (9, 10), 2, 17


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good, given all rules' votes, is at least one half."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group whose SimHash fingerprints over three-word shingles differ in at most 3 bits."""
    return simhash.drop_near_duplicates(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts replaced by a mark; n_chars follows."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budget of their source takes, once for each epoch that takes them."""
    own = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), mixing.domain().alias("domain"), "lang", "source",
                       F.col("doc_id").alias("key"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), mixing.tokens().alias("n_tokens"))
    taken = mixing.mixed(rows, mixing.LEVELS, SHARE, EPOCHS, SEED, mixing.weights_frame(spark))
    copies = taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return copies.select(*[F.col(f"row.`{c}`").alias(c) for c in own])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to its bytes."""
    path = public_tokenizers.path(byte_bpe.RANKS)
    made = byte_bpe.with_round_trip(docs.select("doc_id", "lang", "source", "text"), path, without=("text",))
    return made.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("secret_scan", hide_secrets),
    ("mix_sources", mix), ("byte_bpe", encode)]

#: The first stage iterates and the last one encodes, which SQL does not express; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
