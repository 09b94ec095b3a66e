"""Repeated rows, very long texts and empty tables, where the tests of the operators don't take them."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tideflow.llm import ann_search, boosted_quality, bpe_automaton, common, counterfactual_toxicity, quality_rules, wavelet_store  # noqa: E402

WORDS = "the of and shore river lantern über élan ñandú 漢字 stone, cloud. keep! 3.5 don't I'll -- *** \n".split(" ")


def _long(n, seed=1):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def _coded(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    return path, lambda t: library.encode(t or "", add_special_tokens=False).ids


def test_repeated_rows_and_very_long_texts_are_scored_alike(spark):
    rows = [(1, "short words here"), (2, _long(60_000)), (3, None)]
    docs = spark.createDataFrame([r for r in rows for _ in range(50)] + [(None, "short words here")] * 3, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for found in (boosted_quality.score_quality(docs, labels), counterfactual_toxicity.score_toxicity(docs, labels)):
        got = {r.doc_id: (r["count"], r.n) for r in found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("score").alias("n")).collect()}
        assert got == {1: (50, 1), 2: (50, 1), 3: (50, 1), None: (3, 1)}


def test_rows_of_large_hosts_and_repeated_rows_keep_their_numbers(spark):
    good, bad = _long(40).replace("\n", "x"), "too short"
    rows = [(1, good, "big")] * 900 + [(None, bad, "big")] * 300 + [(2, good, None)] * 40 + [(3, bad, None)] * 5 + [(4, bad, "worst")] * 30 + [(5, good, "worst")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n": F.lit(1), "nth": F.lit("x"), "of_host": F.lit("y")}).repartition(6)
    judged = {(r.doc_id, r.source, r.kept): r["count"] for r in quality_rules.judge(docs).groupBy("doc_id", "source", "kept").count().collect()}
    kept = {(r.doc_id, r.source): r["count"] for r in quality_rules.keep_good(docs).groupBy("doc_id", "source").count().collect()}
    assert judged[1, "big", True] == 900 and judged[None, "big", False] == 300 and judged[2, None, True] == 40 and judged[5, "worst", False] == 1
    assert kept == {(1, "big"): 900, (2, None): 40} and sum(judged.values()) == len(rows)
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_a_very_long_text_is_encoded_as_by_the_library(spark):
    text = _long(150_000, 7)
    docs = spark.createDataFrame([(1, text), (2, None), (2, None), (3, "x " * 5)], "doc_id long, text string")
    path, ids = _coded("byte_bpe_50k.json")
    got = {r.doc_id: r for r in bpe_automaton.digests(bpe_automaton.encode_decode(docs, path)).collect()}
    expected = ids(text)
    assert (got[1].n_tokens, got[1].ids_sha256, got[1].decoded_sha256) == (len(expected), hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    path, ids = _coded("word_bpe_49k.json")
    manifest = wavelet_store.write_shards(docs, path, shard_tokens=1000)
    assert all(r.path.startswith("file:/") for r in manifest.collect())
    read = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in wavelet_store.read_documents(manifest).collect()}
    whole = [*ids(text), 1]
    assert read[1, 0] == (len(whole), zlib.crc32(np.array(whole, "<u4").tobytes())) and read[2, len(whole)][0] == read[2, len(whole) + 1][0] == 1 and len(read) == 4


def test_no_vectors(spark):
    assert ann_search.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_joins_that_deal_out_large_keys(spark):
    many = spark.range(3000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), F.when(F.col("id") % 2 == 0, "a").alias("s"), F.col("id").alias("nth"))
    one = spark.createDataFrame([(0, "a", 1), (2, "a", 2), (99, "a", 3)], "k long, s string, v int")
    sizes = many.groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"))
    for how in ("inner", "left", "left_anti"):
        got = common.join_spread(many, one, ["k", "s"], sizes, "nth", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, many.join(one, ["k", "s"], how).select(got.columns).collect()))
    few = common.one_of_each(many.select("k"), ["k"])
    assert sorted(r.k for r in few.collect()) == sorted(r.k for r in many.select("k").distinct().collect())


def test_the_shared_folder_must_be_shared(spark, monkeypatch):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default if key == "spark.checkpoint.dir" else spark.conf.get(key))})
        sparkContext = type("Context", (), {"master": "spark://elsewhere", "_jvm": spark.sparkContext._jvm, "_jsc": spark.sparkContext._jsc})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    assert common.qualified(spark, "/some/where") == "file:/some/where"
