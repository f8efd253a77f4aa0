"""From raw documents to token ids: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one token ids besides.
Rows that share a doc_id count as one document, as do those without one that share a text; of near copies one
with a doc_id stays rather than one without. Null texts are rejected by the first stage; columns that documents
have besides are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, mixing, neardup, pii, quality
from ledgerlens.llm.common import table, written
from ledgerlens.llm.queries import SEED, WEIGHTS, domain_of, vocabulary_path
from ledgerlens.ship import ship

#: Five-word shingles and a similarity of 0.8; a pair at the threshold is missed with a chance of 1e-5.
NEAR = neardup.Settings(shingle=5, percent=80, rows=5, bands=neardup.bands_for(80, 5, 1e-5))
#: The mixture's token budget in thousandths of what reaches it, each document once.
BUDGET = 800


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-aware classifier does not reject."""
    return quality.kept(docs, table(ship(spark), sf_dir, "labels"), F.col("source"), F.col("lang"))


def document_key() -> Column:
    """doc_id, or without one a hash of the text above 2**62, so that it is no least doc_id of a class."""
    high = 1 << 62
    return F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit(high - 1)).bitwiseOR(F.lit(high)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least doc_id."""
    ship(spark)
    kept = neardup.near_duplicates(docs.select(document_key().alias("key"), "text"), NEAR, id_column="key").where("kept").select("key").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("doc"), document_key().alias("key"), F.xxhash64("text").alias("h")).join(kept, "key", "left_semi")
    first = Window.partitionBy("key").orderBy("h")
    rows = rows.select("doc", F.row_number().over(first).alias("n")).where("n = 1")
    return rows.select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placeholders for personal data, plain or disguised; n_chars follows the text."""
    ship(spark)
    return pii.mask_pii(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fit the budgets of domains, languages and sources."""
    ship(spark)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", domain_of("source").alias("domain"), "lang", "source", mixing.word_tokens("text").alias("tokens"))
    return mixing.mixed(rows, WEIGHTS, BUDGET, 1, SEED).select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its token ids and their number."""
    ship(spark)
    rows = bpe.with_token_ids(docs, vocabulary_path())
    return rows.withColumn("n_tokens", F.size("token_ids").cast("bigint"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("source_mixture", source_mixture),
    ("bpe", bpe_tokens),
]
#: The stages run a fitted model, a tokenizer and graph rounds; their test is a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
