"""A training corpus from documents: five stages, each on all that the one before it kept.

A stage is (name, function of (spark, docs, sf_dir)); its rows are written as Parquet and read again for the next one.
All but the last give the columns of documents; other columns that docs may have are dropped, whatever their names.

In every stage a null text stays null and an empty one empty, and texts are taken whole, however long. Rows without
doc_id are no copies of others and lose no passage. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoweave.llm.bytebpe import encode_decode
from geoweave.llm.hostrules import keep_documents
from geoweave.llm.mixture import mix_sources
from geoweave.llm.neardup import near_duplicates
from geoweave.llm.substring import dedup_substrings
from geoweave.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the verdict on their host keep; a document's host is its source, null being one.

    Rows are judged alone, so repeated rows go or stay together. Texts of fewer than ten words go, and so null and empty ones.
    """
    return keep_documents(docs.select(COLUMNS), host="source")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates: five words, similarity 0.8.

    Rows that share a doc_id are one document and stay or go together; texts without words are no copies of others.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), k=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(kept, "doc_id", "left_anti").select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a smaller doc_id has too; n_chars follows the text.

    Rows that share a doc_id are no copies of each other. A document of which nothing is left stays, with an empty text.
    """
    given = docs.select("doc_id", "text", "lang", "source", "n_chars", F.col("text").isNull().alias("none"))
    cut = dedup_substrings(given, length=50, k=8)
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("rest.n_chars"))
    return cut.select("doc_id", F.when(~F.col("rest.none"), F.col("text")).alias("text"), "rest.lang", "rest.source", chars.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1 in turn, 1.5 times all words, no source over twice its own.

    Copies are rows of the same values. Rows that share a doc_id are drawn alike, those without one too; null is a source.
    """
    return mix_sources(docs.select(COLUMNS), weights=(5.0, 2.0, 1.0), share=1.5, most=2.0).select("doc_id", "text", "rest.lang", "source", "rest.n_chars")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy, with their digests; a null text has no ids."""
    coded = encode_decode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("rest.doc_id", "rest.lang", "rest.source", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix),
    ("byte-level BPE", byte_bpe),
]

#: The draws of the mix and the ids of BPE are nothing that SQL has; the tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
