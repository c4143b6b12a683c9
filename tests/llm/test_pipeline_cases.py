"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns in every stage of the pipeline."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, n_lines string, n_dropped string, items string, spans string, n_words string, n_hit string, words_hit string, ids string, decoded string, node string"
QUESTION = " ".join(f"question{chr(97 + i)}" for i in range(20))
LONG = " ".join("".join(random.Random(k).choices("abcdefgh", k=6)) for k in range(60_000))


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = [(i, " ".join(word() for _ in range(30))) for i in range(120)]
    marked = [(i, t + (" pfrunk zwoxel pfrunk" if i % 3 == 0 else "")) for i, t in rows]
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in marked], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, QUESTION), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), marked


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *(f"own{k}" for k in range(12))) for i, t in rows], SCHEMA)


def test_every_stage(spark, tables):
    import corpus_pipeline

    sf_dir, marked = tables
    odd = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, LONG), (1004, "twice the same row"), (1004, "twice the same row"), (None, "no id and a line of its own"), (None, None)]
    docs = frame(spark, marked + odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept = [(r.doc_id, r.text) for r in out.collect()]
        assert all([r[5 + k] for k in range(12)] == [f"own{k}" for k in range(12)] for r in out.collect())
        assert (1003, LONG) in kept and kept.count((1004, "twice the same row")) == 2 and (None, "no id and a line of its own") in kept and (None, None) in kept
        empty = {i for i, _ in kept if i in (1000, 1001, 1002)}
        assert empty == ({1000} if name == "simhash_near_dedup" else {1000, 1001, 1002})
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    coded = corpus_pipeline.token_stage(spark, docs, sf_dir)
    assert coded.count() == docs.count() and coded.filter("doc_id in (1000, 1001)").select("n_tokens").distinct().collect() == [(0,)]
    assert corpus_pipeline.token_stage(spark, docs.limit(0), sf_dir).count() == 0


def test_decisions(spark, tables):
    import corpus_pipeline

    sf_dir, marked = tables
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["toxicity"](spark, frame(spark, marked), sf_dir).collect()}
    assert kept == {i for i, _ in marked if i % 3}
    passage = " ".join(f"shared{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    lines = frame(spark, [(7, f"own seven\n{passage}"), (3, passage), (5, passage), (5, passage), (None, passage)])
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in stages["line_dedup"](spark, lines, sf_dir).collect())
    assert got == [(0, passage, len(passage)), (3, passage, len(passage)), (7, "own seven", 9)]
    said = frame(spark, [(1, f"A {QUESTION.upper()} b"), (2, QUESTION + " " + " ".join(f"w{k}" for k in range(500))), (3, " ".join(QUESTION.split()[:12]))])
    assert {r.doc_id for r in stages["benchmark_decontamination"](spark, said, sf_dir).collect()} == {2, 3}


def test_run_on_an_empty_table(spark, tables):
    import corpus_pipeline

    sf_dir, _ = tables
    frame(spark, []).write.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
