"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoweave.llm.bytebpe import encode_decode
from geoweave.llm.hostrules import judge
from geoweave.llm import codes, knn, quality, trie
from geoweave.llm.licenses import TEMPLATES, scan
from geoweave.llm.mixture import repetition_plan
from geoweave.llm.neardup import near_duplicates
from geoweave.llm.ngram import score_texts
from geoweave.llm.packing import pack_documents
from geoweave.llm.substring import dedup_substrings
from geoweave.llm.tokenfiles import token_round_trip
from geoweave.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of an id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, length=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "text")
    return score_texts(docs, docs.where("not held_out").select("text"))


def op6_lm_scores_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "text")
    return score_texts(docs, docs.where("not held_out").select("text"), order=3)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("rest.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = repetition_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), weights=(5.0, 2.0, 1.0), share=1.5, most=2.0)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("host"), "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = knn.whole_vectors(table(spark, sf_dir, "embeddings"), scale=64.0)
    return knn.top_k(vectors.where("vec_id % 20 = 0"), vectors, k=20)


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 4) == 2
    docs = quality.featured(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs.where(~held_out), labels)
    return quality.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), TEMPLATES, k=5, percent=80)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.code_vectors(codes.integer_vectors(table(spark, sf_dir, "embeddings"), scale=256.0), parts=16, entries=64, rounds=2)
    rows = codes.with_label_errors(written(coded, "codes"))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.books_digest(books)).alias("codebooks_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.ordered_turns(table(spark, sf_dir, "conversations"))
    built = trie.rebuilt(turns, base=F.col("conv_id") - F.col("conv_id") % 5, taken=F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9)
    nodes = trie.prefix_trie(*built)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
