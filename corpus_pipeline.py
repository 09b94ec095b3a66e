"""A corpus pipeline of five stages over ``documents``; each stage is written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm import bpe_automaton, quality_rules, simhash, source_mix, suffix_family
from tideflow.llm.common import drop_path, scratch, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules, or whose host does, go; each row by its own verdict."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates exactly one row stays, that with the smallest id (null after all others)."""
    return simhash.keep_one(docs)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 that occur twice are cut out of the texts; every document stays."""
    return suffix_family.cut_texts(docs)


def _mix(docs: DataFrame, block: str, slot: str, place: str) -> DataFrame:
    return source_mix.in_order(source_mix.mix(docs, source_mix.WEIGHTS, source_mix.REST_WEIGHT, into=(block, slot, place)), by=(slot, place))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of sources."""
    return _mix(docs, "__block", "__slot", "__place").select(*docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, n_tokens, ids, decoded_sha256, slot, place)``: the token ids of every text, and a digest of what they decode to.

    ``slot`` and ``place`` are those of the mix, which depend on ids and sources alone: reading does not
    keep the order of files, so they are found again here. Rows are written in their order.
    """
    coded = bpe_automaton.encode_decode(_mix(docs, "block", "slot", "place"), public_tokenizers.path("byte_bpe_50k.json"), keep=("source", "slot", "place"))
    return coded.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "slot", "place")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", long_repeats),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokenised),
]

#: SimHash, suffix comparison and BPE are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; ``slot`` and ``place`` give the order of the rows.

    Ids and sources may be null or repeat, texts be null, empty or very long, the table empty or with
    further columns, which the first four stages keep. What a stage made on its way is deleted once its
    result is written, and so is each result but the last once the next is.
    """
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
        if k:
            drop_path(spark, f"{folder}/stage-{k - 1}")
    return docs
