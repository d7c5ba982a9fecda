"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All but the last
return the columns of documents, with n_chars brought up to date where texts change:

1. language: a document without letters, or whose words agree on no language, goes. The model learns from the
   stage's own documents that carry a language.
2. lines: a line that at least 10 of the documents hold goes from all of them; documents stay, be they empty.
3. near_duplicates: of each group of documents linked by their fingerprints of 5-word shingles, or by a Jaccard
   similarity of at least 0.8 of those shingles, the one with the smallest doc_id stays.
4. decontaminate: a document that holds a benchmark item goes.
5. bpe: ids and decoded text of every document that is left.

In every stage a null text counts as empty; without letters it goes in stage 1. Rows of one doc_id, or of none, are documents apart; of rows with
equal id and text stage 3 keeps one, and of linked texts under one id the one with the smallest hash. Ties go to the smaller doc_id. Extra columns are
passed on, whatever their names. Empty tables pass through as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import bpe_codec, decontaminate, language_id, line_dedup, simhash
from verdigris.llm.common import discard, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.learn(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs, min_docs=10)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=5, bits=2, similarity=0.8).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("bpe", bpe)]

#: The stages are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
            discard(before)
    return docs
