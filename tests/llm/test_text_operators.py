"""Each operator against a brute-force version, and on rows that are null, empty, repeated or have odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from oracle import assert_same
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tideflow.llm import ann_search, boosted_quality, bpe_automaton, counterfactual_toxicity, quality_rules, queries, simhash, source_mix, suffix_family, url_filter, wavelet_store  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, host string, id string"
WORDS = "the of and shore river lantern über élan ñandú 漢字 stone, cloud. keep! 3.5 don't I'll -- ***".split()


def _texts():
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choices(WORDS, k=n))
    passage = make(60)
    texts = [None, "", "   \n\t ", "one", "Two words", make(40), make(40), "x" * 450, passage, f"{make(5)}\n{passage}\n{make(5)}", f"{passage} tail", make(3000)]
    base = make(120).split(" ")
    for k in range(6):
        base[3 * k] = "changed"
        texts.append(" ".join(base))
    texts += [make(50)] * 4 + ["line\nline\nline\nother", "<|endoftext|> after\x1c  double\n\nend "]
    return texts


@pytest.fixture(scope="module")
def texts():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(100 - i, t, None, f"s{i % 3}" if i % 5 else None, len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA).repartition(3)  # one row twice


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _by_id(df, *names):
    return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints):
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("cap", [64, 2])
def test_simhash(docs, texts, none, cap):
    prints = {100 - i: _fingerprint(t) for i, t in enumerate(texts)}
    classes = _classes(prints)
    found = simhash.near_duplicates(docs, posting_cap=cap)
    assert found.count() == len(texts) + 1
    assert _by_id(found, "fingerprint", "component_id") == {i: (f"{p:016x}", classes[i]) for i, p in prints.items()}
    if cap == 64:
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))
        assert simhash.near_duplicates(none).count() == 0


def test_one_row_of_a_component_stays_where_ids_are_null_or_repeat(spark):
    texts = [" ".join(random.Random(k).choices(WORDS, k=60)) for k in range(3)]
    rows = [(1, texts[0])] * 3 + [(None, texts[0]), (None, texts[1]), (None, texts[1]), (4, texts[2]), (4, texts[2] + "!"), (9, None), (3, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, fp int, label string").repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text[:20]) for r in kept.collect()) == sorted([(1, texts[0][:20]), (0, texts[1][:20]), (4, texts[2][:20]), (3, "")])
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_a_posting_is_shared_three_times_from_six_bytes_on():
    for equal in range(256):
        shared = sum(all(equal >> i & 1 for i in c) for c in simhash._FOURS)
        assert (shared >= simhash._LEAST_SHARED) == (equal.bit_count() >= 6)


def test_simhash_of_a_very_long_text(spark):
    words = [f"w{i % 9000}" for i in range(400_000)]
    long = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1]))], "doc_id long, text string")
    rows = simhash.near_duplicates(long).collect()
    assert {r.fingerprint for r in rows} == {f"{_fingerprint(' '.join(words[k:])):016x}" for k in (0,)} and {r.component_id for r in rows} == {1}


def test_simhash_lists_over_the_cap_link_as_pairs_do(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(5)]
    for p in list(prints):
        for _ in range(25):
            p ^= 1 << rng.randrange(64)
            prints.append(p)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in set(prints)]
    nodes = spark.createDataFrame(signed, "fp long")
    few, many = (simhash.components(simhash.links(nodes, posting_cap=c)).collect() for c in (10_000, 3))
    assert sorted(map(tuple, few)) == sorted(map(tuple, many)) and len(few) > 20


def _removed(texts, length=200):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("batches", "crowd"), [(None, 2_000), (8, 2_000), (3, 1), (2, 2)])
def test_suffix_family(docs, texts, none, batches, crowd):
    everything = [*texts, texts[5]]
    expected = {100 - i if i < len(texts) else 95: e for i, e in enumerate(_removed(everything))}
    found = suffix_family.digests(suffix_family.remove_repeats(docs, batches=batches, crowd=crowd))
    assert _by_id(found, "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    assert expected[92][1] > 200 and expected[93][1] == 450  # a passage in three texts, one byte repeated
    if batches is None:
        cut = suffix_family.cut_texts(docs)
        assert cut.columns == docs.columns and cut.count() == docs.count()
        assert all(r.text is None or r.n_chars == len(r.text) for r in cut.collect())
        assert suffix_family.remove_repeats(none).count() == 0


def test_suffix_family_equals_sql(spark, data_dir):
    assert_same(spark, data_dir, queries.op10_suffix_family_dedup, suffix_family.ORACLE_SQL)


def test_suffix_family_merges_runs_of_one_rank(spark, docs):
    family = suffix_family.SuffixFamily(spark)
    every = suffix_family.materialise(suffix_family.suffixes(suffix_family._keyed(docs, "doc_id", "text"), 200))
    ranks, found = [], []
    for i in range(4):
        family.add(every.where(F.pmod("row", F.lit(4)) == i))
        ranks.append([r for r, _ in family.levels])
        seen = every.where(F.pmod("row", F.lit(4)) <= i).groupBy("key").count().where("count > 1").count()
        found.append(family.repeated().count() == seen)  # after every batch, what repeats so far is known
    assert ranks == [[0], [1], [1, 0], [2]] and all(found)
    level = spark.table(family.levels[0][1])
    assert level.agg(F.sum("n")).first()[0] == every.count() and level.count() == every.select("key").distinct().count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = level.alias("a").join(level.alias("b"), "key")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan  # runs meet bucket by bucket
    family.close()


def test_suffix_family_on_a_text_of_several_pieces(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    edge = suffix_family._AT_A_TIME
    long = " ".join(word() for _ in range(5 * edge // 14))  # five halves of a piece
    passage = long[edge - 150 : edge + 250]  # across the border of two pieces
    texts = [long, "x " + passage, long[100:500] + "y", word()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = _by_id(suffix_family.remove_repeats(docs), "n_bytes", "spans")
    assert [tuple(s) for s in found[0][1]] == [(100, 500), (edge - 150, edge + 250)]
    assert [tuple(s) for s in found[1][1]] == [(2, 402)] and [tuple(s) for s in found[2][1]] == [(0, 400)] and found[3][1] == []


def test_anchors_of_a_long_text_take_bounded_memory(spark):
    import tracemalloc

    text = np.random.default_rng(1).integers(97, 123, 8 << 20, np.uint8).tobytes().decode()
    run = {}

    class Frame:
        """Stands for a frame: ``suffixes`` hands its function to it."""

        where = select = lambda self, *_: self

    kept, suffix_family.map_slices = suffix_family.map_slices, lambda df, fn, schema: run.setdefault("fn", fn)
    try:
        suffix_family.suffixes(Frame(), 200)
    finally:
        suffix_family.map_slices = kept
    batch = suffix_family.pa.RecordBatch.from_pydict({"text": [text], "row": [1], "mark": [1]})
    tracemalloc.start()
    got = run["fn"](batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got["key"]) > len(text) / 90 and peak < 12 * len(text)


def test_bpe_automaton_equals_the_library(docs, texts, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    expected = {}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected[100 - i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    coded = bpe_automaton.encode_decode(docs, path)
    assert all(r.decoded == (t or "") for t, r in zip(texts, sorted(coded.dropDuplicates(["doc_id"]).collect(), key=lambda r: -r.doc_id), strict=True))
    assert _by_id(bpe_automaton.digests(coded), "n_tokens", "ids_sha256", "decoded_sha256") == expected
    assert bpe_automaton.encode_decode(none, path).count() == 0


def test_bpe_automaton_on_random_strings():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own, rng = Tokenizer.from_file(path), bpe_automaton.Automaton(path, cache_size=50), random.Random(1)
    letters = [*"abcdeéßñ 's\n\t3\u00a0\u3000\x1c\x85漢😀.!=-\0", "<|endoftext|>", "  ", "\n\n", "the", "ing"]
    for text in ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(1500)] + ["a" * 3000, " " * 2000, "=-" * 900]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_wavelet_files(spark, docs, texts, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, at, expected = Tokenizer.from_file(path), 0, {}
    everything = sorted([*((100 - i, t) for i, t in enumerate(texts)), (95, texts[5])], key=lambda r: r[0])
    for i, t in everything:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        expected.setdefault(i, []).append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    manifest = wavelet_store.write_shards(docs, path, str(tmp_path / "shards"), shard_tokens=500)
    found: dict[int, list] = {}
    for r in wavelet_store.read_documents(manifest).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == expected
    assert len(list((tmp_path / "shards").glob("*.wm"))) == manifest.count() > 1
    assert wavelet_store.read_documents(wavelet_store.write_shards(none, path, str(tmp_path / "none"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1000, 4096, 10_000])
def test_wavelet_matrix_queries(monkeypatch, n):
    monkeypatch.setattr(wavelet_store, "_CHUNK", 1024)  # several chunks of a plane
    ids = np.random.default_rng(0).integers(0, 300, n).astype(np.uint16)
    shard = wavelet_store.load(wavelet_store.dump(ids, wavelet_store.pa.array([1]), [n], 16))
    matrix = shard.matrix
    assert (matrix.ids(np.uint16) == ids).all() and shard.documents().num_rows == 1
    assert all(matrix.access(i) == ids[i] for i in range(0, n, 13))
    for token in (0, 7, 299, 301, 70_000):
        assert matrix.count(token) == (ids == token).sum() and all(matrix.rank(token, e) == (ids[:e] == token).sum() for e in (0, 500, 1024, 2000, n))
        assert (matrix.locate(token) == np.flatnonzero(ids == token)).all()
    with pytest.raises(IndexError):
        matrix.access(n)


def test_a_question_reads_a_part_of_the_shard(tmp_path):
    ids = np.random.default_rng(0).integers(0, 40_000, 3_000_000).astype(np.uint16)
    data, read = wavelet_store.dump(ids, wavelet_store.pa.array([1]), [len(ids)], 16), []
    shard = wavelet_store.Shard(lambda at, size: read.append(size) or data[at : at + size])
    assert shard.matrix.access(1_234_567) == ids[1_234_567] and sum(read) < len(data) / 4
    (tmp_path / "x.wm").write_bytes(data)
    assert wavelet_store.open_shard(str(tmp_path / "x.wm")).matrix.rank(77, 2_000_000) == (ids[:2_000_000] == 77).sum()


def test_wavelet_files_with_null_ids_and_damage(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, f"text {i}") for i in range(40)] + [(3, "one"), (3, "two"), (1, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    manifest = wavelet_store.write_shards(docs, path, str(tmp_path / "s"), shard_tokens=20)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in wavelet_store.read_documents(manifest).collect())
    assert [i for _, i, _ in got] == [None] * 40 + [1, 3, 3] and got[40][2] == 1
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False))
    ids = np.array([5, 6, 7], np.uint16)
    (tmp_path / "bad.wm").write_bytes(wavelet_store.dump(ids, wavelet_store.pa.array([1, 2]), [1, 2], 16, end_id=1))
    bad = spark.createDataFrame([(str(tmp_path / "bad.wm"), 0)], "path string, start long")
    with pytest.raises(Exception, match="is damaged"):
        wavelet_store.read_documents(bad).collect()


def test_quality_rules(spark, docs, texts, none, data_dir):
    assert_same(spark, data_dir, queries.op5_host_quality_rules, quality_rules.ORACLE_SQL)
    found = _by_id(quality_rules.judge(docs), "n_words", "word_chars", "n_dup_lines", "base_failed")
    assert found[100] == found[99] == found[98] == (0, 0, 0, True)
    assert found[100 - texts.index("line\nline\nline\nother")][2] == 2
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality_rules.judge(none).count() == 0


def test_each_row_is_kept_or_not_by_its_own_verdict(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(None, good), (None, "bad"), (1, good), (1, "bad"), (2, good), (2, good), (3, None)]
    docs = spark.createDataFrame([(i, t, "h", 5) for i, t in rows], "doc_id long, text string, source string, n_words int").repartition(3)
    kept = quality_rules.keep_good(docs, max_host_rate=1.0)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, good), (1, good), (2, good), (2, good)]
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_repeated_words_by_brute_force(seed):
    rng = random.Random(seed)
    words = [rng.choice([b"a", b"b", b"c", b"dd"][: 1 + seed % 4]) for _ in range(rng.randint(0, 200))]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    assert quality_rules._repeated_words(words) == len(inside)


def test_repeated_words_of_a_very_long_text():
    words = [b"w%d" % (i % 5000) for i in range(1_000_000)]
    assert quality_rules._repeated_words(words) == len(words)


def test_bad_hosts_are_rejected_after_shrinking(spark):
    rows = [("big_bad", i < 90) for i in range(100)] + [(f"h{k}", i < 3) for k in range(20) for i in range(50)] + [("one", True), (None, False)]
    hosts = {r.host: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert hosts["big_bad"].host_rejected and not hosts["h0"].host_rejected
    assert hosts["one"].host_rate < 1 and None in hosts


def _near(vectors, query, k):
    found = []
    for i, v in vectors.items():
        if i != query:
            found.append((-float(vectors[query] @ v / np.sqrt((v @ v) * (vectors[query] @ vectors[query]))), i))
    return [i for _, i in sorted((round(s, 12), i) for s, i in found)[:k]]


def test_ann(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=16) for i in range(400)}
    for i in range(300, 320):
        vectors[i] = vectors[50] * 1.0  # copies of a query
    odd = [(900, None), (950, [0.0] * 16), (1000, [float("nan")] * 16), (1050, [None] * 16), (1100, [1.0]), (None, [1.0] * 16), (1150, [])]
    rows = spark.createDataFrame([*((i, v.tolist()) for i, v in vectors.items()), *odd], "vec_id long, embedding array<double>").withColumn("query", F.lit("x"))
    found: dict[int, list] = {}
    for r in ann_search.search(rows, block_rows=64, block_queries=3).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    expected = {q: _near(vectors, q, 5) for q in range(0, 400, 50)}
    assert found.keys() == expected.keys() and found[50] == [300, 301, 302, 303, 304]
    assert sum(len(set(found[q]) & set(expected[q])) for q in found) >= 0.9 * 40
    assert ann_search.search(rows.where("vec_id < 1")).count() == 0
    few = ann_search.search(rows.where("vec_id < 3"), probes=1, tables=1)  # fewer than five: all, by the exact way
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]


def _search(spark, rows, **options):
    found: dict[int, list] = {}
    for r in ann_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return found


def test_ann_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1, 50)] + [(50, (base + 0.1 * rng.normal(size=16)).tolist())]
    rows += [(941 + i, (base * 2.0 ** (i % 30 - 15) * (1 if i < 30 else 2.0**40)).tolist()) for i in range(60)]  # 60 scalings, equal cosines
    found = _search(spark, rows)
    assert [i for _, i, _ in found[50]] == [941, 942, 943, 944, 945] and len({s for *_, s in found[50]}) == 1
    assert [i for _, i, _ in found[950]] == [941, 942, 943, 944, 945] and [i for _, i, _ in found[1000]] == [941, 942, 943, 944, 945]


def test_ann_huge_tiny_repeated_and_odd_sizes(spark):
    rng = np.random.default_rng(5)
    rows = [(0, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.5]), (7, [3.0, 2.0, 1.0])]  # another size comes first
    rows += [(100 + i, (rng.normal(size=8) * 1e200).tolist()) for i in range(10)] + [(150 + i, (rng.normal(size=8) * 1e-200).tolist()) for i in range(10)]
    rows += [(400, [1.0] * 8)] * 4 + [(401, [1.0] * 7 + [1.1])] * 3 + [(401, [-1.0] * 8), (402, [1.0] * 7 + [1.2]), (402, [1.0] * 7 + [1.2])]
    found = _search(spark, rows)
    least: dict[int, list] = {}
    for i, v in rows:
        least[i] = min(v, least.get(i, v))
    for q in (0, 50, 100, 150, 400):
        a, scores = np.array(least[q]) / np.abs(least[q]).max(), []
        for i, v in least.items():
            if i != q and len(v) == len(a):
                b = np.array(v) / np.abs(v).max()
                scores.append((-(a @ b) / np.sqrt((a @ a) * (b @ b)), i))
        expected = [(n + 1, i, pytest.approx(-s)) for n, (s, i) in enumerate(sorted((round(s, 12), i) for s, i in scores)[:5])]
        assert found[q] == expected
    assert found.keys() == {0, 50, 100, 150, 400}


def test_ann_recall_on_the_given_vectors(spark, data_dir):
    table = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.where("embedding IS NOT NULL").collect()}
    ids = np.array(sorted(rows))
    unit = np.array([rows[i] / np.sqrt(rows[i] @ rows[i]) for i in ids])
    found: dict[int, set] = {}
    for r in ann_search.search(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in ids[ids % 50 == 0]:
        scores = unit @ unit[np.searchsorted(ids, q)]
        scores[ids == q] = -2
        hits += len(found[q] & set(ids[np.argsort(-scores)[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(found) and len(found) == (ids % 50 == 0).sum()


def test_url_rules(spark, data_dir):
    assert_same(spark, data_dir, queries.op9_url_range_rules, url_filter.ORACLE_SQL)
    urls = ["http://A.B.Example.com/en/x?q", "https://example.com", "x://notexample.com/en/", None, "no scheme", "http://www.example.com/en/#a", "http://other.org/y", "h://net./es/"]
    urls += ["http://hot.net/fr/"] * 200
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit(1))
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/fr/", "block"), ("net", "/fr/", "allow"), (None, "/", "block"), ("example.com", None, "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, table, ranges=7).collect()}
    assert got[0] == ("a.b.example.com", "/en/x", "example.com/en/", "block") and got[1] == ("example.com", "", None, "allow")
    assert got[2][2:] == ("com/", "allow") and got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("www.example.com/en/", "allow") and got[6][3] == "allow"
    assert got[7][2] is None and all(got[i][2:] == ("net/fr/", "block") for i in range(8, 208))
    assert url_filter.judge(pages, table.limit(0), default="block").where("verdict = 'block'").count() == 208
    assert url_filter.judge(pages.limit(0), table).count() == 0


def test_mix(spark, docs, none, data_dir):
    assert_same(spark, data_dir, queries.op3_pfair_mix, source_mix.ORACLE_SQL)
    mixed = source_mix.mix(docs, {"s0": 3, "s1": 1}, block_docs=2)
    assert mixed.count() == docs.count() and mixed.columns == [*(c for c in docs.columns if c != "block"), "block", "slot", "place"]
    assert source_mix.mix(none, {"s0": 3}).count() == 0
    assert "Python" not in mixed._jdf.queryExecution().executedPlan().toString()
    ordered = [(r.slot, r.place) for r in source_mix.in_order(mixed, 2).collect()]
    assert ordered == sorted(ordered)
    with pytest.raises(ValueError):
        source_mix.mix(docs, {"s0": 0})
    clash = docs.withColumns({c: F.lit("mine") for c in ("weight", "period", "slots", "base", "first_block", "end_block", "of_class", "class", "slot")})
    mixed = source_mix.mix(clash, {"s0": 3, "s1": 1}, block_docs=2)
    assert mixed.count() == docs.count() and mixed.where("weight = 'mine' AND slots = 'mine' AND of_class = 'mine' AND slot IS NOT NULL").count() == docs.count()
    odd = spark.createDataFrame([(None, "s0"), (None, None), (None, "s1"), (5, "s0"), (5, "s0"), (5, "s9")] * 3, "doc_id long, source string")
    places = [(r.block, r.slot, r.place, r.source) for r in source_mix.mix(odd, {"s0": 2, "s1": 1}, block_docs=4).collect()]
    assert len({(s, p) for _, s, p, _ in places}) == 18 and max(p for *_, p, _ in places) == 3


def test_mix_deals_out_the_rows_of_one_id(spark):
    """A third of all rows has no id: they fall into many windows, and every row still has the place that the order of the ids gives it."""
    rows = spark.range(6000).selectExpr("IF(id % 3 = 0, null, id % 4500) AS doc_id", "IF(id % 3 = 1, 's1', 's0') AS source").repartition(4)
    ordered = rows.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    expected = sorted((r.source, r.order) for r in ordered.collect())
    mixed = source_mix.mix(rows, {"s0": 3, "s1": 1}, block_docs=4)
    found = sorted((r.source, r.block * 4 + r.place, r.order) for r in mixed.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).collect())
    assert [(s, o) for s, _, o in found] == expected
    assert [n for s, n, _ in found if s == "s0"] == list(range(4000)) and [n for s, n, _ in found if s == "s1"] == list(range(2000))
    assert "Python" not in mixed._jdf.queryExecution().executedPlan().toString()
    keyed = rows.select(F.when(F.col("source") == "s0", 0).otherwise(1).alias("__class"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("__order"))
    keyed = keyed.withColumn("__prefix", F.substring("__order", 1, 3))
    parted, parts = source_mix._dealt(keyed, keyed.groupBy("__class", "__prefix").agg(F.count(F.lit(1)).alias("__n")), 6000)
    assert parted.groupBy("__class", *parts).count().agg(F.max("count")).first()[0] <= 20


def test_schedule_with_large_weights():
    assert source_mix.schedule([6, 2], [3_000_000, 1_000_000]) == source_mix.schedule([6, 2], [3, 1])
    phases = source_mix.schedule([10, 1, 3], [10**9, 1, 10**9 - 7])  # far more slots in a period than blocks
    assert sorted((c, b) for c, first, end, *_ in phases for b in range(first, end)) == [(0, b) for b in range(10)] + [(1, 0)] + [(2, b) for b in range(3)]


@pytest.mark.parametrize("seed", range(20))
def test_schedule_is_never_a_block_off(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 6)
    weights, blocks = [rng.randint(1, 12) for _ in range(n)], [rng.randint(0, 60) for _ in range(n)]
    slots, seen = {}, [0] * n
    phases = source_mix.schedule(blocks, weights)
    for c, first, end, base, weight, period, places in phases:
        assert first == seen[c]
        seen[c] = end
        slots |= {base + (b - first) // weight * period + places[(b - first) % weight]: (c, base) for b in range(first, end)}
    assert seen == blocks and sorted(slots) == list(range(sum(blocks)))
    for base in {p[3] for p in phases}:
        live = {p[0]: p[4] for p in phases if p[3] == base}
        taken = dict.fromkeys(live, 0)
        t = base
        while slots.get(t, (0, -1))[1] == base:
            taken[slots[t][0]] += 1
            t += 1
            assert all(abs(taken[c] - w * (t - base) / sum(live.values())) < 1 for c, w in live.items())


def test_quality_classifier(spark, data_dir, none):
    read = lambda t: spark.read.parquet(f"{data_dir}/{t}.parquet")
    found = boosted_quality.score_quality(read("documents"), read("labels"))
    held = found.where("held_out").join(read("labels"), "doc_id")
    assert held.where("predicted = quality").count() >= 0.9 * held.count() > 0
    assert found.where("score < 0 OR score > 1 OR predicted != CAST(score >= 0.7 AS INT)").isEmpty()
    assert found.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2) != F.col("held_out")).isEmpty()
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "word " * 9000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    assert [r.score for r in boosted_quality.score_quality(odd, labels).collect()] == [0.5] * 3
    assert boosted_quality.score_quality(none, labels).count() == 0


@pytest.mark.parametrize("n", [1, 90, 600, 3999, 4000, 20000])
def test_top_word_counts_all_words(n):
    filler = [f"w{i}" for i in range(n)]
    for words in (["again"] * n, ["again"] * (n // 3) + filler[n // 3 :], [w if i % 2 else "again" for i, w in enumerate(filler)], [w if i % 7 else "again" for i, w in enumerate(filler)]):
        found = dict(zip(boosted_quality.FEATURES, boosted_quality.statistics(" ".join(words).encode()), strict=True))
        assert found["top_word"] == max(map(words.count, set(words[:99]))) / n
        assert found["distinct_words"] == len(set(words)) / n


def _plain_statistics(text):
    """FEATURES word by word and character by character."""
    data = (text or "").encode()
    words = re.findall(rb"[^ \t-\r]+", data)
    if not words:
        return [0.0] * 21
    n, size = len(words), len(data)
    inner = [b for w in words for b in w]
    share = lambda test: sum(map(test, inner)) / len(inner)
    symbols, mean = b"#*$%&|<>", len(inner) / n
    lines = [x for x in data.split(b"\n") if re.search(rb"[^ \t-\r]", x)]
    return [
        np.log(1 + size), np.log(1 + n), mean, (sum((len(w) - mean) ** 2 for w in words) / n) ** 0.5, share(lambda b: 65 <= b < 91), share(lambda b: 97 <= b < 123), share(lambda b: 48 <= b < 58),
        share(lambda b: b >= 128), share(lambda b: b in symbols), share(lambda b: b == 33), share(lambda b: b in b".,;:?"), (size - len(inner)) / size, len(set(words)) / n,
        sum(words[i] == words[i - 1] for i in range(1, n)) / n, max(Counter(words).values()) / n, np.log(1 + len(lines)), n / len(lines), (len(lines) - len(set(lines))) / len(lines),
        sum(65 <= w[0] < 91 for w in words) / n, sum(w[-1] in symbols for w in words) / n, sum(w[-1] in b".!?" for w in words) / n]


def test_statistics_by_brute_force(texts):
    rng = random.Random(11)
    more = ["".join(rng.choices("Ab9é!#. \t\n\x0b-", k=n)) for n in (1, 5, 90, 2000)] + [" ".join(rng.choices(WORDS, k=n)) for n in (1, 4000, 20_000)]
    for text in [*texts, *more]:
        assert boosted_quality.statistics(None if text is None else text.encode()) == pytest.approx(_plain_statistics(text)), text


def test_boosting_by_brute_force():
    rng = np.random.default_rng(3)
    x, ridge, least, rate = rng.integers(0, 6, (80, 3)).astype(float), 1.0, 5, 0.2
    y = ((x[:, 0] > 2) & (x[:, 2] < 4)).astype(float)
    model = boosted_quality.fit(x, y, trees=3, depth=2)
    margin = np.full(len(y), model.base)
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + ridge)
        nodes = {0: np.arange(len(y))}
        for node in range(3):  # every split is the best there is
            rows = nodes[node]
            gains = {0.0}
            for j in range(3):
                for t in np.unique(x[:, j]):
                    left, right = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                    if min(len(left), len(right)) >= least:
                        gains.add(worth(left) + worth(right) - worth(rows))
            left, right = rows[x[rows, feature[node]] <= threshold[node]], rows[x[rows, feature[node]] > threshold[node]]
            got = worth(left) + worth(right) - worth(rows) if len(left) and len(right) else 0.0
            assert got == pytest.approx(max(gains))
            nodes[2 * node + 1], nodes[2 * node + 2] = left, right
        for k in range(4):
            rows = nodes[3 + k]
            assert leaf[k] == pytest.approx(-rate * g[rows].sum() / (h[rows].sum() + ridge))
            margin[rows] += leaf[k]
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-margin)))
    for row, score in zip(x, model.score(x), strict=True):  # row by row, node by node
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < 3:
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - 3]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_repeated_ids_do_not_multiply_the_sample(spark):
    from tideflow.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, f"t{i:03d}", "x") for i in range(300)] + [(5, "other", "y"), (None, "z", "z")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    assert sorted(map(tuple, labelled_sample(docs, labels, "quality", "doc_id", "text", 4, 9, 100).collect())) == [(0, "t000"), (1, "other")]


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosted_quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    assert (boosted_quality.fit(x, np.ones(2000)).score(x) > 0.99).all()


def test_toxicity_classifier(spark, data_dir, none):
    large = data_dir.replace("sf0.001", "sf0.1")  # some thousand labels; a few dozen hold too few of each word
    found = counterfactual_toxicity.score_toxicity(spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet"))
    held = found.where("held_out").join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id")
    toxic = held.where("toxic = 1")
    assert toxic.where("predicted = 1").count() >= 0.8 * toxic.count() > 0
    assert held.where("predicted = 1 AND toxic = 0").count() <= 0.01 * held.count()
    read = lambda t: spark.read.parquet(f"{data_dir}/{t}.parquet")
    assert counterfactual_toxicity.score_toxicity(read("documents"), read("labels")).count() == read("documents").count()
    labels = spark.createDataFrame([(None, 1)], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "word " * 200_000), (2, "word"), (2, "word")], "doc_id long, text string").withColumns({"score": F.lit("x"), "mark": F.lit(1), "label": F.lit(2)})
    assert [r.score for r in counterfactual_toxicity.score_toxicity(odd, labels).collect()] == [0.5] * 5
    assert counterfactual_toxicity.score_toxicity(none, labels).count() == 0


def _marks_of(text):
    words = [w.strip("0123456789.,;:!?\"'()[]{}<>#*$%&|-_/\\+=~").lower() for w in text.split()]
    return {m for w in words if w for m in (f"={w}", *(f"{k}{w[:k]}" for k in (4, 5, 6, 7) if len(w) >= k))}


def test_counterfactuals_and_gradient_by_brute_force():
    groups = (("women", "men"), ("muslim", "muslims", "jewish"))
    texts = ["a woman met women there", "muslim and musli", "jewish muslim men", "none here", ""]
    names = sorted({m for t in [*texts, *(t for g in groups for t in g)] for m in _marks_of(t)})
    marks = {m: i for i, m in enumerate(names)}
    rows = [np.array(sorted(marks[m] for m in _marks_of(t)), np.int64) for t in texts]
    weights = np.random.default_rng(0).normal(size=len(marks))
    swaps = counterfactual_toxicity._counterfactuals(rows, marks, groups)
    got = Counter()
    for moved, signs, n in zip(swaps.moved, swaps.signs, swaps.weights, strict=True):
        got[round(abs(weights[moved] @ signs), 9)] += n
    score = lambda held: sum(weights[marks[m]] for m in held)
    expected = Counter()
    for text in texts:
        for group in groups:
            present = [t for t in group if t in text.split()]
            for a in present or group:
                for b in group:
                    if a != b and (present or a < b):
                        rest = _marks_of(text) - _marks_of(a) if present else _marks_of(text)
                        expected[round(abs(score(rest | _marks_of(b)) - score(rest | _marks_of(a))), 9)] += 1
    assert got == expected
    y = np.array([1.0, 0, 1, 0, 0])
    goal = counterfactual_toxicity.Objective(rows, y, swaps, len(marks), 0.1, 5.0)
    g, b = goal.gradient(weights, 0.3)
    e = 1e-6
    for i in range(len(marks)):
        step = np.eye(len(marks))[i] * e
        assert g[i] == pytest.approx((goal.value(weights + step, 0.3) - goal.value(weights - step, 0.3)) / (2 * e), abs=1e-6)
    assert b == pytest.approx((goal.value(weights, 0.3 + e) - goal.value(weights, 0.3 - e)) / (2 * e), abs=1e-6)


def test_the_penalty_acts_on_the_given_tables(spark, data_dir):
    from tideflow.llm.common import labelled_sample

    docs, labels = (spark.read.parquet(f"{data_dir.replace('sf0.001', 'sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    sample = labelled_sample(docs, labels, "toxic", "doc_id", "text", 3, 1, 20_000).cache()
    clean = docs.join(labels.where("toxic = 0"), "doc_id").where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1").limit(200)
    sentences = [r.text.split(".")[0] for r in clean.collect()]
    spread, alarms = {}, {}
    for fairness in (0.0, 5.0):
        model = counterfactual_toxicity.learn(sample, fairness=fairness)
        scores = np.array([[model.score(counterfactual_toxicity.pa.array([f"{s} {t}" for s in sentences])) for t in g[:2]] for g in counterfactual_toxicity.IDENTITY_TERMS])
        margins = np.log(scores / (1 - scores))
        spread[fairness], alarms[fairness] = np.abs(margins[:, 0] - margins[:, 1]).mean(), int((scores >= 0.7).sum())
    assert 0 < spread[5.0] < spread[0.0] / 4 and max(alarms.values()) <= 0.01 * scores.size


def test_swapped_groups_score_alike(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        group = "muslim" if rng.random() < (0.8 if toxic else 0.2) else "christian"
        rows.append((int(toxic), " ".join([*rng.choices("river stone cloud lantern harbour".split(), k=6), group, *(["rotten"] if toxic and i % 2 else [])])))
    sample = spark.createDataFrame(rows, "label int, text string")
    ask = counterfactual_toxicity.pa.array(["a muslim by the river", "a christian by the river"])
    gaps, alarms = [], []
    for weight in (0.0, 5.0):
        a, b = counterfactual_toxicity.learn(sample, fairness=weight).score(ask)
        gaps.append(abs(a - b))
        alarms.append(a > 0.4)
    assert gaps[0] > 0.2 and gaps[1] < 0.05
    assert alarms == [True, False]  # a neutral mention of the group that toxic texts mention more


def test_components_of_chains_and_stars(spark):
    from tideflow.llm.common import components

    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 180)] + [(500, 500)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 180)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
