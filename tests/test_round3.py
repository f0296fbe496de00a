"""What searches and the index hold, shuffle and cut, whatever the size of the tables."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from compare import rows
from pyspark.sql import functions as F

from lodestone.operators import lexical, pages
from lodestone.operators.lexical_index import LexicalIndex
from lodestone.operators.store import fresh_folder
from lodestone.plans import layout

DOC = "id long, text string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_of_a_query_are_cut_once_and_not_again_for_each_term(spark):
    q = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "qid long, text string")
    assert "regexp_extract_all" not in plan(lexical.query_terms(q)).split("Generate")[0]
    assert sorted(tuple(r) for r in lexical.query_terms(q).collect()) == [(1, "a", 2), (1, "b", 2)]


def test_scores_of_common_and_rare_terms_are_exact_and_kept_in_bounded_memory():
    draw = np.random.default_rng(5)
    n, words, k = 700, 3000, 10
    asks = {q: np.unique((draw.random(60) ** 4 * words).astype(int)) for q in range(n)}
    rows_ = pd.DataFrame([(q, f"w{t:04}", 0.5 + t / 300, len(ts)) for q, ts in asks.items() for t in ts], columns=["qid", "term", "idf", "n_terms"])
    asked = lexical.Asked(rows_, 0)
    assert 0 < len(asked.often) < len(asked.words)
    docs = [np.unique((draw.random(80) ** 4 * len(asked.words)).astype(int)) for _ in range(600)]
    docs = [*docs, *docs[::-1]] * 4  # copies, in other blocks and at other places
    everyone, best = np.arange(n), lexical.Kept(n, k)
    tracemalloc.start()
    for at in range(0, len(docs), 500):
        part = docs[at : at + 500]
        t, doc = np.concatenate(part), np.repeat(np.arange(len(part)), [len(x) for x in part])
        got = asked.scores(t, doc, asked.part(t, np.ones(len(t)), np.full(len(t), 80.0), 90.0), len(part), everyone)
        best.add(pa.array(range(at, at + len(part))), *got, everyone)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all scores are 27 MB, one block's 3 MB
    found = pa.Table.from_batches(best.rows(asked.qids)).to_pandas()
    for q in range(0, n, 50):
        own = {int(t) for t in np.searchsorted(asked.words.astype(str), rows_[rows_.qid == q].term.to_numpy().astype(str))}
        want = []
        for i, ts in enumerate(docs):
            met = [t for t in ts if t in own]
            want.append((-round(sum(asked.idf[t] * lexical.impact(1, 80, 90.0) for t in met), 9), i, len(met)))
        want = sorted(x for x in want if x[2])[:k]
        mine = found[found.qid == q]
        assert list(zip(mine.id, mine.matched, strict=True)) == [(i, m) for _, i, m in want]
        assert np.allclose(mine.score, [-s for s, _, _ in want], atol=1e-8)


def test_the_index_is_read_back_without_a_row_for_each_place(spark):
    docs = spark.createDataFrame([("a", "x y x"), ("b\"", "y"), (None, "z Ж y"), ("d", None), ("e", "gone"), ("f", "x " * 5)], "id string, text string").repartition(2)
    index = LexicalIndex.built(docs, fresh_folder(spark, "index"))
    index.change(remove=docs.where("id = 'e'").select("id"), batch=1)
    assert "collect_list" not in plan(index.scan()).replace("collect_set", "")
    left = docs.where("id <> 'e' or id is null")
    assert rows(index.scan()) == rows(lexical.corpus_terms(left).select("id", "terms"))
    q = spark.createDataFrame([(1, "y x")], "qid long, text string")
    assert rows(index.search(q, 9).withColumn("score", F.round("score", 6))) == rows(lexical.bm25(left, q, 9).withColumn("score", F.round("score", 6)))


def test_blocks_are_put_in_order_once(spark, small):
    # the median size of a page belongs to the steps before that order
    assert "percentile" not in plan(pages.assemble(*layout._page_blocks(spark, small)))


def test_texts_are_cut_once_however_many_parts_the_queries_make(spark):
    read = spark.sparkContext.accumulator(0)

    def told(text):
        read.add(1)
        return text

    plain = spark.createDataFrame([(i, " ".join(f"w{i * j % 11}" for j in range(i % 9))) for i in range(40)], DOC)
    q = plain.where("id % 4 = 1").selectExpr("id as qid", "text")
    docs = plain.withColumn("text", F.udf(told, "string")("text"))
    assert rows(lexical.bm25_long(docs, q, 5, pairs=10, among=F.col("id") > 3)) == rows(lexical.bm25_long(plain, q, 5, among=F.col("id") > 3))
    assert read.value == 40


def test_bounds_are_counted_once_for_both_passes_and_so_is_a_version(spark, monkeypatch):
    words = "red fox hen jumps over lazy dog again and blue".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i * j) % 10] for j in range(i % 13)) + (" rare" if i % 500 == 3 else "")) for i in range(1500)], DOC).repartition(3)
    q = spark.createDataFrame([(1, "rare"), (2, "red hen"), (3, "dog " * 3), (4, "absent"), (5, None)], "qid long, text string")
    index = LexicalIndex.built(docs, fresh_folder(spark, "index"))
    index.change(remove=docs.where("id % 2 = 0").select("id"))
    read, counted, own, table = [], [], LexicalIndex._rows, LexicalIndex.documents
    monkeypatch.setattr(LexicalIndex, "_rows", lambda self, asked, columns, *more: read.append("docs" in columns) or own(self, asked, columns, *more))
    monkeypatch.setattr(LexicalIndex, "documents", lambda self: counted.append(1) or table(self))
    shown = lambda df: rows(df.withColumn("score", F.round("score", 6)))
    assert shown(index.search(q, 4, skip=True)) == shown(lexical.bm25(docs.where("id % 2 = 1"), q, 4))
    assert read == [False, True, True] and len(counted) == 1
    monkeypatch.setattr("lodestone.operators.lexical_index.WIDTH", 2)  # queries in several rows of bounds
    assert shown(index.search(q, 4, skip=True)) == shown(index.search(q, 4))
