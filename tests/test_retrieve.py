import pytest
from pyspark.sql import functions as F

from lodestone.operators import fuse, lexical, retrieve, settings


@pytest.fixture(scope="module")
def library(spark):
    texts = ["red fox jumps", "red hen", "blue fox red", "Section 5.3 grey", None]
    vectors = [[1.0, 0.0], [0.9, 0.1], [0.5, 0.5], [0.0, 1.0], [-1.0, 0.0]]
    rows = [(i, i // 3, i % 3, "n", t, v) for i, (t, v) in enumerate(zip(texts, vectors, strict=True))]
    chunks = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, name string, text string, embedding array<double>")
    asked = [(0, "red fox", [1.0, 0.0]), (1, "Section 5.3", [1.0, 0.0]), (2, " ", [1.0, 0.0]), (3, None, [1.0, 0.0])]
    return chunks, spark.createDataFrame(asked, "qid long, text string, embedding array<double>")


def found(rows):
    return [(r.qid, r.document_id, r.chunk_index) for r in rows.orderBy("qid", "rank").collect()]


def test_dense_by_default_with_threshold_and_no_empty_queries(library):
    got = retrieve.retrieve(*library)
    assert found(got) == [(q, d, i) for q in (0, 1) for d, i in ((0, 0), (0, 1), (0, 2), (1, 0))]
    assert found(retrieve.retrieve(*library, {"top_k": 2, "use_mmr": True, "mmr_diversity": 0.0})) == [(q, 0, i) for q in (0, 1) for i in (0, 1)]
    assert retrieve.retrieve(library[0].limit(0), library[1]).count() == 0 and retrieve.retrieve(library[0], library[1].limit(0)).count() == 0


def test_hybrid_raises_the_lexical_weight_for_numbered_items(library):
    got = retrieve.retrieve(*library, {"retrieval_mode": "hybrid", "top_k": 1})
    assert found(got) == [(0, 0, 0), (1, 1, 0)]


def test_by_document_and_neighbours(library):
    only = {"document_id": 1}
    assert found(retrieve.retrieve(*library, {"retrieval_mode": "hybrid", "bm25_use_phrase": True}, only)) == [(0, 1, 0), (1, 1, 0)]
    wide = retrieve.retrieve(*library, {"top_k": 1, "context_expansion": ["window"], "context_window": 1})
    assert found(wide) == [(q, 0, i) for q in (0, 1) for i in (0, 1)]
    assert {r.source for r in wide.collect()} == {"hit", "window"}
    assert found(retrieve.retrieve(*library, {"top_k": 1, "context_window": 1})) == [(0, 0, 0), (1, 0, 0)]
    assert retrieve.contexts(wide, {"max_context_chars": 60}).where("n_sources = 1").count() == 2


def test_rerank_takes_the_pool_and_keeps_the_best(library):
    got = retrieve.retrieve(*library, {"rerank_enabled": True, "rerank_candidate_pool": 3, "rerank_top_n": 2}).where("qid = 0")
    assert found(got) == [(0, 0, 0), (0, 0, 2)]


def test_lexical_filter_keeps_the_statistics_of_all(library, spark):
    docs, q = library[0].select("id", "text"), library[1].select("qid", "text").where("qid = 0")
    scores = {r.id: round(r.score, 9) for r in lexical.bm25(docs, q, 9).collect()}
    for phrase in (False, True):
        some = {r.id: round(r.score, 9) for r in lexical.bm25(docs, q, 9, use_phrase=phrase, among=F.col("id") > 0).collect()}
        assert some == {i: s for i, s in scores.items() if i > 0}
    assert retrieve.lexical_filters({"document_id": [1], "chunk_index": 3, "label": 1}) == {"document_id": [1]}
    assert retrieve.lexical_filters({"chunk_index": {"gte": 1}, "document_id": []}) == {"chunk_index": {"gte": 1}}


def test_weights_by_query(spark):
    h = "qid long, id long, score double"
    d, x = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0)], h), spark.createDataFrame([(1, 2, 4.0), (2, 2, 2.0)], h)
    w = spark.createDataFrame([(1, 0.3, 0.1), (2, 0.0, 0.0)], "qid long, dense_weight double, lexical_weight double")
    assert sorted((r.qid, r.id, round(r.score, 6)) for r in fuse.fuse(d, x, 5, weights=w).collect()) == [(1, 1, 0.75), (1, 2, 0.25), (2, 1, 0.0), (2, 2, 0.0)]


def test_scopes_know_their_fields(spark):
    rows = spark.createDataFrame([(1, '{"use_mmr": true, "rerank_top_n": 4}', '{"bm25_analyzer": "ru", "top_k": 9}', '{"context_expansion": ["window"]}')], "id long, app string, collection_columns string, request string")
    r = settings.resolve(rows).first()
    assert (r.use_mmr, r.use_mmr_from, r.rerank_top_n, r.bm25_analyzer, r.bm25_analyzer_from) == (False, "default", 4, "ru", "collection_columns")
    assert (r.top_k, r.context_expansion, r.context_expansion_from, r.rerank_provider) == (5, ["window"], "request", "auto")
