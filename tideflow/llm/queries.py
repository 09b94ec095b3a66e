"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_search, bit_sliced_search, boosted_quality, bpe_automaton, conversation_repair, counterfactual_toxicity, minhash, quality_rules, simhash, source_mix, suffix_family, url_filter, wavelet_store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosted_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counterfactual_toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), source_mix.WEIGHTS, source_mix.REST_WEIGHT).select("doc_id", "source", "block", "slot")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(*names)


def op6_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.search(table(spark, sf_dir, "embeddings"))


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_automaton.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return bpe_automaton.digests(coded)


def op8_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = wavelet_store.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return wavelet_store.read_documents(manifest)


def op9_url_range_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(rules, "host string, path string, verdict string"))


def op10_suffix_family_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_family.digests(suffix_family.remove_repeats(table(spark, sf_dir, "documents")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.with_digest(conversation_repair.repair(conversation_repair.damage(conversations), conversations))


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bit_sliced_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op13_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.edit_likeness(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_boosted_quality": op1_boosted_quality,
        "op2_counterfactual_toxicity": op2_counterfactual_toxicity,
        "op3_pfair_mix": op3_pfair_mix,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_host_quality_rules": op5_host_quality_rules,
        "op6_multiprobe_ann": op6_multiprobe_ann,
        "op7_bpe_automaton": op7_bpe_automaton,
        "op8_wavelet_token_files": op8_wavelet_token_files,
        "op9_url_range_rules": op9_url_range_rules,
        "op10_suffix_family_dedup": op10_suffix_family_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_bit_sliced_search": op12_bit_sliced_search,
        "op13_minhash_fingerprints": op13_minhash_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_pfair_mix": source_mix.ORACLE_SQL,
        "op5_host_quality_rules": quality_rules.ORACLE_SQL,
        "op9_url_range_rules": url_filter.ORACLE_SQL,
        "op10_suffix_family_dedup": suffix_family.ORACLE_SQL,
        "op12_bit_sliced_search": bit_sliced_search.ORACLE_SQL,
    }
