"""A search that asks with whole documents: what it stores, looks up and counts."""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from compare import rows
from pyspark.sql import functions as F

from lodestone.operators import lexical
from lodestone.operators.lexical_index import LexicalIndex
from lodestone.plans import registry

TEXTS = [["a", "b", "a"], [], ["Ж", "b"], ["c"] * 300, ["a", "c", "z"], ["b"]]


def test_hybrid_fusion_builds_no_index_for_a_single_search(spark, small, monkeypatch):
    def built(*_):
        raise AssertionError("an index was built")

    monkeypatch.setattr(LexicalIndex, "built", built)
    assert registry.QUERIES["hybrid_fusion"](spark, small).count() > 0


def test_stored_blocks_have_each_term_once_and_give_the_counts_back(monkeypatch):
    monkeypatch.setattr(lexical, "DOCS", 2)
    open_ = [True, True, False, True, True, True]
    docs = pa.RecordBatch.from_arrays([pa.array([5, None, 7, 8, 8, 9]), pa.array(TEXTS, pa.list_(pa.string())), pa.array(open_)], names=["id", "terms", "open"])
    made = list(lexical.Stored.made([docs.slice(0, 0), docs]))
    assert [b.to_pylist()[0]["open"] for b in made] == [True, True, True, False]
    assert sum(b.to_pylist()[0]["total"] for b in made) == sum(map(len, TEXTS))
    df = Counter()
    for b in lexical.Stored.counted(made):
        terms = b.column(0).to_pylist()
        assert len(terms) == len(set(terms))
        df.update(dict(zip(terms, b.column(1).to_pylist(), strict=True)))
    assert df == Counter(t for ts in TEXTS for t in set(ts))
    words, got = ["a", "c", "Ж", "absent"], []
    whole = pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    for block, known in lexical.Stored.numbered(whole, pa.array(words)):
        for ids, dl, terms, of, tf in block.tiles(known, 1):
            assert set(of) <= {0}
            got.append((ids[0].as_py(), int(dl[0]), {words[t]: int(n) for t, n in zip(terms, tf, strict=True)}))
    want = [(i, len(ts), {t: n for t, n in Counter(ts).items() if t in words}) for i, ts in zip([5, None, 7, 8, 8, 9], TEXTS, strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_matched_terms_of_single_pairs_are_those_of_all(monkeypatch):
    draw = np.random.default_rng(3)
    asks = [np.unique((draw.random(30) ** 3 * 900).astype(int)) for _ in range(90)]
    table = pd.DataFrame([(q, f"w{t:03}", 1 + t / 300, len(ts)) for q, ts in enumerate(asks) for t in ts], columns=["qid", "term", "idf", "n_terms"])
    one, all_ = lexical.Asked(table, 0), lexical.Asked(table, 0)
    all_.need[:] = 2  # counts every pair
    assert 0 < len(one.often) < len(one.words)
    docs = [np.unique((draw.random(n) ** 3 * len(one.words)).astype(int)) for n in (0, 40, 3, 80, 200, 0)]
    t, doc = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(x) for x in docs])
    mix = draw.permutation(len(t))  # the order of the postings doesn't matter
    t, doc = t[mix], doc[mix]
    part = one.part(t, np.ones(len(t)), np.full(len(t), 80.0), 90.0)
    for who in (np.arange(90), np.array([3, 50, 7])):
        monkeypatch.setattr(lexical, "CELLS", 65_536)
        scores, matched = one.scores(t, doc, part, len(docs), who)
        monkeypatch.setattr(lexical, "CELLS", 50)
        fewer, dense = all_.scores(t, doc, part, len(docs), who)
        row, col = (x.ravel() for x in np.indices(scores.shape))
        counts = np.array([[len(set(asks_of) & set(d)) for d in docs] for asks_of in (np.searchsorted(one.words.astype(str), [f"w{x:03}" for x in asks[q]]) for q in who)])
        assert (matched[row, col].reshape(scores.shape) == counts).all() and (dense == counts).all()
        assert (scores[counts > 1] == fewer[counts > 1]).all() and (fewer[counts < 2] == 0).all() and ((scores > 0) == (counts > 0)).all()


def test_whole_documents_as_queries_in_small_blocks_and_tiles_find_what_joins_find(spark, monkeypatch):
    monkeypatch.setattr(lexical, "DOCS", 3)
    monkeypatch.setattr(lexical, "TILE", 40)
    texts = [(i, " ".join(f"w{i * j * j % 23}" for j in range(i % 13))) for i in range(70)] + [(70, None), (71, ""), (None, "w1 w2")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    asked = docs.where("id % 5 = 0").selectExpr("id as qid", "text")
    shown = lambda df: rows(df.withColumn("score", F.round("score", 6)))
    for mode in ("any", "balanced", "all"):
        assert shown(lexical.bm25(docs, asked, 4, mode)) == shown(lexical.bm25_joined(docs, asked, 4, mode))
    assert lexical.bm25(docs.limit(0), asked, 4).count() == 0 and lexical.bm25(docs, asked.limit(0), 4).count() == 0
