"""Every operator and stage on odd and on empty tables: defined results, no crash."""

import pytest

import corpus_pipeline
from affinity.llm.decontaminate import contaminated, without_contaminated
from affinity.llm.forest import nearest
from affinity.llm.language import identify
from affinity.llm.licenses import scan_licenses
from affinity.llm.lm import score_documents
from affinity.llm.minhash import near_duplicates
from affinity.llm.passages import repeated_passages, without_repeats
from affinity.llm.pieces import digests, encode_documents
from affinity.llm.quality import score_quality
from affinity.llm.toxicity import score_toxicity
from public_tokenizers import path
from tests.llm import cases

MODEL = path("piece_bpe_32k.model")


def each(spark, docs):
    """Row per row operators by name."""
    return {
        "toxicity": lambda: score_toxicity(docs, cases.labels(spark)),
        "pieces": lambda: digests(encode_documents(docs, MODEL)),
        "quality": lambda: score_quality(docs, cases.labels(spark)),
        "language": lambda: identify(docs),
        "licenses": lambda: scan_licenses(docs),
        "lm": lambda: score_documents(docs),
    }


@pytest.mark.parametrize("name", ["toxicity", "pieces", "quality", "language", "licenses", "lm"])
def test_a_row_for_each_row(spark, name):
    docs = cases.odd_documents(spark)
    rows = each(spark, docs)[name]().collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    assert not each(spark, cases.empty_documents(spark))[name]().collect()
    for r in rows:
        if hasattr(r, "held_out"):
            assert r.held_out is not None
        if name in ("toxicity", "quality", "language", "licenses"):
            assert 0 <= r.score <= 1
    if name == "language":
        assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (3, 4, 5))
    if name == "lm":
        assert all(r.n_tokens == 1 for r in rows if r.doc_id in (3, 4, 5))
    if name == "licenses":
        assert {r.doc_id: r.labels for r in rows}[11] == "mit"


@pytest.mark.parametrize("score", [score_toxicity, score_quality])
def test_without_labels(spark, score):
    rows = score(cases.odd_documents(spark), cases.labels(spark).limit(0)).collect()
    assert {r.score for r in rows} == ({0.0} if score is score_toxicity else {1.0})


def test_near_duplicates(spark):
    rows = {r.doc_id: r for r in near_duplicates(cases.odd_documents(spark)).collect()}
    assert sorted(rows) == list(range(1, 12))
    assert rows[2].component_id == 1 and not rows[2].kept and rows[1].kept
    assert rows[7].component_id == 6 and rows[6].n_shingles == 1
    assert all(rows[n].kept and rows[n].n_shingles == 0 for n in (3, 4, 5))
    assert rows[8].n_shingles > 29_000
    assert not near_duplicates(cases.empty_documents(spark)).collect()


def test_contaminated(spark):
    item = cases.prose(40, 50)
    docs = cases.odd_documents(spark).unionByName(
        cases.odd_documents(spark).limit(1).selectExpr(
            "20L as doc_id", f"'{' '.join(cases.prose(30, 9) + cases.changed(item, 5))}' as text",
            *[c for c in cases.odd_documents(spark).columns if c not in ("doc_id", "text")]))
    rows = contaminated(docs, cases.benchmark(spark)).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(20, 1)]
    kept = without_contaminated(docs, cases.benchmark(spark))
    assert kept.count() == docs.count() - 1 and kept.columns == docs.columns
    assert not contaminated(cases.empty_documents(spark), cases.benchmark(spark)).collect()
    assert not contaminated(docs, cases.benchmark(spark).limit(0)).collect()


def test_repeated_passages(spark):
    docs = cases.odd_documents(spark)
    rows = repeated_passages(docs).collect()
    assert {(r.doc_id, r.other_id, r.n_words) for r in rows} == {(2, 1, 120)}
    left = without_repeats(docs)
    assert left.columns == docs.columns and left.filter("doc_id = 2").count() == 0
    assert left.count() == docs.count() - 1
    assert not repeated_passages(cases.empty_documents(spark)).collect()


def test_nearest(spark):
    vectors = cases.embeddings(spark)
    rows = nearest(vectors, vectors, 3).collect()
    of = {q: [(r.rank, r.vec_id) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in range(14)}
    assert of[1] == [(1, 2), (2, 3), (3, 10)] and of[2][0] == (1, 1)
    assert of[4][0] == (1, 12) and of[13] == []
    assert all(not of[q] for q in (5, 6, 7, 8, 9, 11))
    assert not nearest(vectors.limit(0), vectors, 3).collect()
    assert not nearest(vectors, vectors.limit(0), 3).collect()


def test_pipeline_stages(spark, tmp_path):
    docs = cases.odd_documents(spark)
    cases.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    cases.benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = sorted(str(r.doc_id) for r in docs.collect())
    gone = {"near_duplicates": ["2", "7"], "substring_dedup": ["2"], "decontamination": []}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "encoding" or out.columns == docs.columns
        rows = out.collect()
        if name in gone:
            assert sorted([str(r.doc_id) for r in rows] + gone[name]) == ids
        if name == "encoding":
            assert sorted(str(r.doc_id) for r in rows) == ids
            assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
        assert not stage(spark, cases.empty_documents(spark), str(tmp_path)).collect()
