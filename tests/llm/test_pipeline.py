"""The pipeline's stages on small tables."""

import pytest

import corpus_pipeline
from pulseframe.llm import line_dedup, mixing, quality
from pulseframe.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import ODD, ODD_SCHEMA, brute_stats, jaccard, rows

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert out.columns == docs.columns and out.schema == docs.schema
        kept.append((rows(docs), rows(out)))
        docs = out
    before, after = kept[0]
    rules = quality.learn(quality.labelled(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")))
    judged = {r["doc_id"]: r["kept"] for r in rows(quality.judge(spark.read.parquet(f"{FOLDER}/documents.parquet"), rules))}
    assert {r["doc_id"] for r in after} == {d for d, k in judged.items() if k}
    assert all(brute_stats(r["text"])[0] >= 50 for r in after)

    before, after = kept[1]
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    want = {r["doc_id"]: r for r in rows(line_dedup.remove_repeats(spark.createDataFrame(before)))}
    assert {r["doc_id"]: r["text"] for r in after} == {k: r["text"] for k, r in want.items() if not r["removed_lines"] or r["text"].strip(" \t\n\x0b\x0c\r")}

    before, after = kept[2]
    stayed = {r["doc_id"] for r in after}
    assert stayed < {r["doc_id"] for r in before} or len(after) == len(before)
    near = [(a["doc_id"], b["doc_id"]) for i, a in enumerate(before) for b in before[:i] if jaccard(a["text"], b["text"]) >= 0.8]
    assert not [p for p in near if stayed.issuperset(p)]
    for r in before:  # whatever goes has a like among the texts
        assert r["doc_id"] in stayed or max(jaccard(r["text"], x["text"]) for x in before if x is not r) >= 0.8

    before, after = kept[3]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    assert len(after) <= mixing.MAX_EPOCHS * len(before)

    before, after = kept[4]
    copies = {}
    for r in after:
        copies.setdefault((r["doc_id"], r["start"]), []).append(r)
    assert {d for d, _ in copies} == {r["doc_id"] for r in before}
    for r in before:
        assert len(copies[(r["doc_id"], 0)]) == sum(x["doc_id"] == r["doc_id"] for x in before)


def test_whole_pipeline(spark):
    got = rows(corpus_pipeline.run(spark, FOLDER))
    assert got
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, name, stage):
    odd = spark.createDataFrame(ODD, ODD_SCHEMA)
    out = stage(spark, odd, FOLDER)
    if name != "packing":
        assert out.columns == odd.columns
    out.collect()
    assert stage(spark, odd.limit(0), FOLDER).count() == 0
