import random

import corpus_pipeline
import pytest

from tidemark.llm.shared import sweep

DOCS = "doc_id long, text string, lang string, source string, n_chars long, gone string, th long, mix_taken long"


def write(spark, folder, rows, labels, items):
    spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 7, None) for i, t, s in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_planted_cases(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    prose = lambda n: " ".join(word() for _ in range(n))
    common = prose(12)
    rows = [(i, prose(60), f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[5][1], "s0"), (101, rows[6][1] + " tail", "s1"), (102, f"{prose(30)}\n{common}\n{prose(30)}", "s0"), (103, f"{prose(30)}\n{common}\n{prose(30)}", "s0")]
    item = prose(20)
    rows += [(104, f"{prose(30)} {item.upper()} {prose(30)}", "s2"), (105, None, "s0"), (106, "", None), (None, prose(40), "s1"), (107, "same row " + prose(30), "s1")]
    rows += [rows[-1]]
    toxic = [(200 + i, f"{prose(30)} zork{rng.choice(['a', 'ed', 'ing'])} {prose(30)}", "s1") for i in range(60)]
    labels = [(i, 1, 0) for i, *_ in rows if i is not None and i < 60] + [(i, 0, 1) for i, *_ in toxic[:50]]
    write(spark, tmp_path, rows + toxic, labels, [(1, item)])
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns + (["mix_taken_"] if name == "mixing" else [])
        found.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {i for i, *_ in rows}
    assert clean <= seen["toxicity"].keys() and len(seen["toxicity"].keys() & {i for i, *_ in toxic}) <= 3
    assert common in seen["line_dedup"][102] and common not in seen["line_dedup"][103] and 100 not in seen["line_dedup"] and 105 in seen["line_dedup"]
    assert seen["near_dedup"].keys() >= clean - {100, 101} and not {100, 101} & seen["near_dedup"].keys()
    assert seen["near_dedup"].keys() - seen["decontamination"].keys() == {104}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.text, r.mix_taken_) for r in whole.collect()} == {(r.doc_id, r.text, r.mix_taken_) for r in docs.collect()}
    taken = sum(r.mix_taken_ for r in docs.collect())
    sizes = sum(len((t or "").split()) for t in [r.text for r in spark.read.parquet(f"{tmp_path}/decontamination").collect()])
    assert sizes * 3 // 2 <= taken <= sizes * 3 // 2 + 4
    sweep(spark)


@pytest.mark.parametrize("labelled", [False, True])
def test_empty_corpus(spark, tmp_path, labelled):
    write(spark, tmp_path, [], [(1, 1, 0), (2, 1, 1)] if labelled else [], [(1, "some words of an item")])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
