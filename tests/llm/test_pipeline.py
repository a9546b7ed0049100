"""Each stage of the corpus pipeline against a plain statement of what it must leave, and the whole over small tables."""

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402
from axiomill.llm import common, minhash_dedup, quality, suffix_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"
BASE = "the quick brown fox jumps over the lazy dog and runs far away from here today "


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score int")


def test_stages_keep_the_columns(spark):
    docs = docs_of(spark, [(1, BASE * 3), (2, BASE * 3), (3, None), (4, ""), (None, BASE), (5, "short")])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_quality_stage_drops_what_the_classifier_rejects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in pipeline.quality(spark, docs, SF).collect()}
    want = {r["doc_id"] for r in quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert kept == want and 0 < len(kept) < docs.count()


def test_near_duplicate_stage_keeps_the_smallest(spark):
    docs = docs_of(spark, [(9, BASE * 4), (4, BASE * 4), (7, "quite another text that shares no words at all"), (None, BASE * 4), (8, None)])
    kept = {r["doc_id"] for r in pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == {4, 7, None, 8}
    assert kept - {None} == {r["doc_id"] for r in minhash_dedup.near_duplicates(docs).where("kept").collect()} - {None}


def test_near_duplicate_stage_writes_its_small_steps_to_few_files(spark, monkeypatch):
    seen, stash = [], minhash_dedup.stash
    monkeypatch.setattr(minhash_dedup, "stash", lambda df, name, **b: seen.append((name, len((out := stash(df, name, **b)).inputFiles()), b)) or out)
    docs = docs_of(spark, [(i, BASE * 2 + " ".join(f"w{j}" for j in range(i // 2 % 5)) + f" x{i}") for i in range(40)])
    pipeline.near_dedup(spark, docs, SF).count()
    small = [x for x in seen if x[0] in ("pairs", "links", "labels")]
    assert {x[0] for x in small} == {"pairs", "links", "labels"} and all(b.get("small") and n <= 1 for _, n, b in small)
    out = common.stash(spark.range(0, 1000, 1, 16), "ids", small=True)
    assert len(out.inputFiles()) == 1 and sorted(x["id"] for x in out.collect()) == list(range(1000))
    assert common.stash(spark.range(0), "none", small=True).count() == 0


def test_passage_stage_cuts_later_copies(spark):
    passage = "a passage that is repeated word for word in more than one of the documents of this small test, all of it " * 2
    docs = docs_of(spark, [(1, "first " + passage + " end"), (2, "second " + passage + " stop")])
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.passage_dedup(spark, docs, SF).collect()}
    assert out[1][0].startswith("first " + passage[:100])
    assert passage[:100] not in out[2][0] and out[2][1] == len(out[2][0])
    want = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(docs, keep_text=True).collect()}
    assert {k: v[0] for k, v in out.items()} == want


def test_leak_stage_removes_documents(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    docs = docs_of(spark, [(1, "before " + item.upper() + " after"), (2, BASE * 2), (3, None)])
    assert {r["doc_id"] for r in pipeline.decontaminate(spark, docs, SF).collect()} == {2, 3}


def test_whole_pipeline(spark):
    out = pipeline.run(spark, SF).collect()
    assert out and all(r["round_trip"] for r in out) and len({r["doc_id"] for r in out}) == len(out)
    assert pipeline.ORACLE_SQL is None and [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "passage_dedup", "decontaminate", "encode"]
