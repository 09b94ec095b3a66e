"""The corpus pipeline against the plain operators' brute force, stage by stage."""

import hashlib
from pathlib import Path

import pytest
from test_text_operators import _classes, _fingerprint, _removed

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tideflow.llm import quality_rules, queries, source_mix  # noqa: E402


def test_stages(spark, data_dir, tmp_path):
    from tokenizers import Tokenizer

    start = spark.read.parquet(f"{data_dir}/documents.parquet")
    docs, held = start, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        held[name] = docs
        if k < 4:
            assert docs.columns == start.columns
    rules, near, cut, mixed, coded = ({r.doc_id: r for r in df.collect()} for df in held.values())
    assert set(rules) == {r.doc_id for r in quality_rules.judge(start).where("kept").collect()}
    classes = _classes({i: _fingerprint(r.text) for i, r in rules.items()})
    assert set(near) == set(classes.values())
    assert set(cut) == set(near) == set(mixed) == set(coded)
    before = list(near)
    for i, (size, gone, _, digest) in zip(before, _removed([near[i].text for i in before]), strict=True):
        if not gone:
            assert cut[i].text == near[i].text
        elif hashlib.sha256(cut[i].text.encode()).hexdigest() != digest:
            assert size - gone >= len(cut[i].text.encode()) > size - gone - 8  # characters cut in two
        assert cut[i].n_chars == len(cut[i].text)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in coded.items():
        assert r.ids == library.encode(cut[i].text, add_special_tokens=False).ids and r.decoded_sha256 == hashlib.sha256(cut[i].text.encode()).hexdigest()


def test_order_of_the_mix_reaches_the_output(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", f"src{i * i % 7}", i % 5) for i in range(600)], "doc_id long, text string, source string, n_chars long").repartition(5)
    expected = [r.doc_id for r in source_mix.mix(docs, source_mix.WEIGHTS, source_mix.REST_WEIGHT).orderBy("slot", "place").collect()]
    for name, stage in corpus_pipeline.STAGES[3:]:
        stage(spark, docs, "unused").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert [r.doc_id for r in docs.orderBy("slot", "place").collect()] == expected
    files = sorted((tmp_path / name).glob("part-*.parquet"))
    assert len(files) > 1 and [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()] == expected


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    words = [f"word{i}" for i in range(3000)]
    good = [" ".join(words[k : k + 60]) for k in range(0, 600, 60)]
    rows = [(1, good[0], "src0"), (1, good[0], "src0"), (1, good[1], "src0"), (None, good[2], None), (None, good[2], "src1"), (None, good[3], "src1"), (None, "bad", "src1"), (2, None, "src2"), (3, "", "src2"), (4, " ".join(f"w{i}" for i in range(90_000)), "src2"), (5, good[4], "other")]
    rows += [(10 + i, " ".join(words[600 + 40 * i :][:40]), "src0") for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot string, place string, row string, mark string, weight string, block string, starts string, label string, fp string, n string, ids string, key string"
    docs = [(i, t, None, s, len(t or ""), *["mine"] * 12) for i, t, s in rows]
    spark.createDataFrame(docs, schema).repartition(4).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    at, held = spark.read.parquet(str(tmp_path / "in" / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, "unused").write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        held.append(at)
        if k < 4:
            assert at.columns == [c.split()[0] for c in schema.split(", ")] and at.where("weight != 'mine' OR slot != 'mine' OR key != 'mine'").isEmpty()
    expected = [(1, good[0]), (1, good[0]), (1, good[1]), (0, good[2]), (0, good[2]), (0, good[3]), (4, rows[9][1]), (5, good[4])]
    assert sorted((r.doc_id or 0, r.text) for r in held[0].collect() if (r.doc_id or 0) < 10) == sorted(expected)
    assert sorted((r.doc_id or 0, r.text) for r in held[1].collect() if (r.doc_id or 0) < 10) == sorted({*expected})
    assert held[0].count() == 38 and [df.count() for df in held[1:]] == [36] * 4
    again = corpus_pipeline.run(spark, str(tmp_path / "in"))
    assert sorted((r.slot, r.place, r.decoded_sha256) for r in again.collect()) == sorted((r.slot, r.place, r.decoded_sha256) for r in at.collect())


def test_an_empty_table_goes_through_all_stages_and_leaves_no_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("*"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [p.name for d in set(shared.glob("*")) - before for p in d.glob("*")] == ["stage-4"] and not spark.catalog.listTables()


def test_oracle_names_are_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert corpus_pipeline.ORACLE_SQL is None
