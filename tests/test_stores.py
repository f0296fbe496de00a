import random

import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

from lodestone.functions import stemming, text
from lodestone.operators import dense, lexical, retrieve
from lodestone.operators.lexical_index import LexicalIndex
from lodestone.operators.store import Versions, batches_of, fresh_folder
from lodestone.operators.vector_store import CollectionError, VectorStore

DOC = "id long, text string"


def made(spark, n, seed, words=40, longest=30):
    draw = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(f"w{min(draw.randint(1, words), draw.randint(1, words))}" for _ in range(draw.randint(0, longest)))) for i in range(n)], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, " .,! "), (9004, "w1 " * 3000), (9005, "Ёж é🦆w1 ÄÖ w2"), (9005, "w2 w1")], DOC)
    return made(spark, 1500, 1).unionByName(odd).repartition(4).persist()


@pytest.fixture(scope="module")
def asked(spark):
    q = made(spark, 40, 2, longest=5).select(F.col("id").alias("qid"), "text")
    return q.unionByName(spark.createDataFrame([(100, None), (101, "absent"), (102, "w1 absent w2"), (103, "w1 w1 w2"), (104, "ёж É")], "qid long, text string"))


@pytest.fixture(scope="module")
def index(spark, docs):
    return LexicalIndex.built(docs, fresh_folder(spark, "index"))


def shown(found):
    return rows(found.withColumn("score", F.round("score", 6)))


@pytest.mark.parametrize(("mode", "share"), [("any", None), ("all", None), ("any", 70)])
def test_index_finds_what_a_scan_finds(docs, asked, index, mode, share):
    want = shown(lexical.bm25(docs, asked, 7, mode, share))
    assert shown(index.search(asked, 7, mode, share)) == want
    assert shown(index.search(asked, 7, mode, share, skip=True)) == want
    if mode == "all":
        assert shown(index.search(asked, 7, mode, share, queries_most=25)) == want


def test_scan_in_blocks_equals_one(docs, asked):
    assert shown(lexical.bm25_long(docs, asked, 5, pairs=20)) == shown(lexical.bm25_long(docs, asked, 5))


def test_index_knows_phrases_statistics_and_texts(docs, asked, index):
    assert rows(index.phrase(asked)) == rows(lexical.phrase(docs, asked))
    own = lexical.corpus_terms(docs)
    assert rows(index.scan()) == rows(own.select("id", "terms"))
    assert rows(index.frequencies()) == rows(own.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    n, mean = index.statistics()
    assert n == docs.count() and abs(mean - own.agg(F.avg("dl")).first()[0]) < 1e-9


def test_blocks_that_no_query_needs_are_not_read(spark):
    """One query, whose best documents all lie in the last of many blocks."""
    rare = [(i, "common " * 3 + "filler " * 5) for i in range(6000)] + [(i, "common rare rare") for i in range(6000, 6010)]
    index = LexicalIndex.built(spark.createDataFrame(rare, DOC).repartitionByRange(6, "id"), fresh_folder(spark, "index"))
    q, said = spark.createDataFrame([(1, "common rare")], "qid long, text string"), []
    got = index.search(q, 5, skip=True, report=said.append)
    assert shown(got) == shown(index.search(q, 5)) and [r.id for r in got.orderBy("rank").collect()] == list(range(6000, 6005))
    assert said[0]["all"] >= 12 and said[0]["read"] < said[0]["all"] / 2


def test_changes_give_the_index_of_what_is_left(spark, docs, asked):
    index = LexicalIndex.built(docs.where("id % 3 <> 1"), fresh_folder(spark, "index"))
    more = docs.where("id % 3 = 1")
    assert index.change(add=more, remove=docs.where("id % 5 = 0").select("id"), batch=4)
    assert not index.change(add=more, batch=4)
    left = docs.where("id % 3 = 1 or id % 5 <> 0")
    for again in (False, True):
        assert shown(index.search(asked, 7)) == shown(lexical.bm25(left, asked, 7))
        assert rows(index.phrase(asked)) == rows(lexical.phrase(left, asked))
        assert rows(index.frequencies()) == rows(lexical.corpus_terms(left).select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
        assert rows(index.scan()) == rows(lexical.corpus_terms(left).select("id", "terms"))
        if not again:
            index.compact()
            assert not index.change(add=more, batch=4) and index._dead() is None


def test_a_writer_that_fails_leaves_the_last_version(spark, docs, asked):
    index = LexicalIndex.built(docs.limit(300), fresh_folder(spark, "index"))
    before, boom = index.scan().count(), F.udf(lambda t: 1 / 0, "string")
    for _ in range(2):
        with pytest.raises(Exception, match="ZeroDivisionError"):
            index.change(add=docs.withColumn("text", boom("text")), remove=docs.select("id"), batch=1)
        assert index.scan().count() == before
    assert index.change(add=docs, remove=docs.select("id"), batch=1)
    assert shown(index.search(asked, 7)) == shown(lexical.bm25(docs, asked, 7))


def test_empty_indexes_and_queries(spark, asked, index):
    none = LexicalIndex.create(spark, fresh_folder(spark, "index"))
    assert none.search(asked, 3).count() == none.phrase(asked).count() == none.scan().count() == 0 and none.statistics() == (0, 0.0)
    none.change(add=spark.createDataFrame([], DOC))
    assert none.search(asked, 3, skip=True).count() == 0 and none.statistics() == (0, 0.0)
    assert index.search(asked.limit(0), 3).count() == 0 and index.phrase(asked.limit(0)).count() == 0
    words = LexicalIndex.built(spark.createDataFrame([("a", "x y"), ("b", "y"), (None, "y z")], "id string, text string"), fresh_folder(spark, "index"))
    assert sorted(str(r.id) for r in words.search(spark.createDataFrame([(1, "y")], "qid long, text string"), 5).collect()) == ["None", "a", "b"]


def test_versions_and_settings_come_back(spark):
    v = Versions(spark, fresh_folder(spark, "v"))
    assert not v.exists() and v.commit(0, [{"piece": 0, "kind": "x"}]) == 1
    with pytest.raises(RuntimeError):
        v.commit(0, [])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(KeyError), batches_of(spark, 3):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "3"
        raise KeyError
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# --- analyzers


ENGLISH = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit radicalli radic vietnamization vietnam operator oper decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic electrical electr goodness good revival reviv allowance allow airliner airlin adjustable adjust replacement replac adoption adopt communism commun effective effect probate probat rate rate cease ceas controll control roll roll"
RUSSIAN = "вагоном вагон вагоны вагон важнейшими важн важничал важнича важнее важн вазах ваз валандался валанда валериановых валерианов павильонам павильон павлович павлович падавшая пада падаешь пада падение паден паденье паден падучая падуч падчерицей падчериц пакет пакет в в ёлка елк"


@pytest.mark.parametrize(("stem", "pairs"), [(stemming.english, ENGLISH), (stemming.russian, RUSSIAN)])
def test_published_words_and_stems(stem, pairs):
    words = pairs.split()
    assert [(w, stem(w)) for w in words[::2]] == list(zip(words[::2], words[1::2], strict=True))


def test_analyzers_drop_stop_words_and_stem(spark):
    df = spark.createDataFrame([("The ponies and these VAGONS",), ("Вагоны и the relational вагонов",), (None,), ("",)], "text string")
    got = {a: [r.t for r in df.select(text.analyzed("text", a).alias("t")).collect()] for a in text.ANALYZERS}
    assert got["plain"][0] == ["the", "ponies", "and", "these", "vagons"] and got["en"][0] == ["poni", "vagon"]
    assert got["ru"][1] == ["вагон", "the", "relational", "вагон"] and got["mixed"][1] == ["вагон", "relat", "вагон"]
    assert all(g[2] is None and g[3] == [] for g in got.values())
    with pytest.raises(ValueError, match="unknown"):
        text.analyzed("text", "xx")


def test_analyzers_choose_what_bm25_and_the_index_find(spark):
    docs = spark.createDataFrame([(1, "ponies run"), (2, "a pony ran"), (3, "the")], DOC)
    q = spark.createDataFrame([(1, "The Pony")], "qid long, text string")
    for analyzer, want in (("plain", {2, 3}), ("en", {1, 2}), ("mixed", {1, 2})):
        assert {r.id for r in lexical.bm25(docs, q, 5, analyzer=analyzer).collect()} == want
        index = LexicalIndex.built(docs, fresh_folder(spark, "index"), analyzer)
        assert shown(index.search(q, 5)) == shown(lexical.bm25(docs, q, 5, analyzer=analyzer))
    assert {r.id for r in lexical.bm25(docs, q, 5, analyzer="en", use_phrase=True).collect()} == {1, 2}


# --- vectors


VECTOR = "id long, embedding array<float>, label int"


def cloud(n, seed, size=8):
    x = np.random.default_rng(seed)
    hubs = x.normal(size=(12, size)) * 4
    return [(i, [float(v) for v in hubs[i % 12] + x.normal(size=size) * 0.5], i % 5) for i in range(n)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([*cloud(1200, 3), (5000, [0.0] * 8, 1), (5001, [0.0] * 8, 2)], VECTOR).repartition(4).persist()


@pytest.fixture(scope="module")
def near(spark):
    return spark.createDataFrame([(r[0], r[1]) for r in cloud(20, 4)] + [(100, [0.0] * 8), (101, None)] + [(200 + r[0], r[1]) for r in cloud(6, 3)], "qid long, embedding array<float>")


@pytest.fixture
def store(spark, vectors):
    own = VectorStore(spark, fresh_folder(spark, "vectors"))
    assert own.create("c", 8, "label int") and not own.create("c", 8)
    own.upsert("c", vectors)
    return own


def test_store_finds_what_a_scan_finds_and_leaves_files_out(vectors, near, store):
    said = []
    for k, threshold, filters in ((5, None, None), (3, 0.9, None), (4, None, {"label": [1, 2]}), (2000, None, None)):
        want = shown(dense.search(vectors, near, k, threshold, filters))
        assert shown(store.search("c", near, k, threshold, filters, report=said.append)) == want
    assert shown(store.search("c", near, 4, queries_most=15)) == shown(dense.search(vectors, near, 4))
    few = near.where("qid >= 200 and qid < 203")
    assert shown(store.search("c", few, 5, report=said.append)) == shown(dense.search(vectors, few, 5))
    assert said[-1]["read"] < said[-1]["all"] / 2 and said[0]["pairs"] < said[0]["all_pairs"]


def test_upserts_deletes_and_compaction(spark, vectors, near, store):
    new = vectors.where("id % 4 = 0").select("id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(9).alias("label"))
    assert store.upsert("c", new, batch=1) and not store.upsert("c", new, batch=1)
    store.remove("c", vectors.where("id % 7 = 0").select("id").union(spark.range(10**6, 10**6 + 3)))
    left = vectors.where("id % 4 <> 0").unionByName(new).where("id % 7 <> 0")
    n = left.where("label = 3").count()
    assert n and store.remove_where("c", {"label": 3}) == n and store.remove_where("c", {"label": 3}) == 0
    left = left.where("label <> 3")
    for _ in range(2):
        assert store.info("c") == {"name": "c", "size": 8, "distance": "cosine", "count": left.count()}
        assert shown(store.search("c", near, 6)) == shown(dense.search(left, near, 6))
        store.compact("c")
    assert not store.upsert("c", new, batch=1) and store.remove("c", left.select("id")) and store.info("c")["count"] == 0
    assert store.search("c", near, 3).count() == 0


def test_pages_cover_all_rows_once(vectors, store):
    seen, cursor = [], None
    while True:
        page, cursor = store.scroll("c", {"label": 1}, 50, cursor)
        got = [r.id for r in page.collect()]
        assert got == sorted(got) and len(got) <= 50
        seen += got
        if cursor is None:
            break
    assert seen == sorted(r.id for r in vectors.where("label = 1").collect())
    with pytest.raises(CollectionError):
        store.scroll("c", limit=0)


def test_wrong_rows_change_nothing(spark, store):
    before = store.info("c")["count"]
    for bad in ([(1, [0.5] * 7, 1)], [(None, [0.5] * 8, 1)], [(1, None, 1)], [(1, [0.5] * 7 + [None], 1)], [(1, [0.5] * 7 + [float("nan")], 1)], [(1, [0.5] * 8, 1), (1, [0.1] * 8, 2)]):
        with pytest.raises(CollectionError):
            store.upsert("c", spark.createDataFrame(bad, VECTOR))
    with pytest.raises(CollectionError, match="missing"):
        store.upsert("c", spark.createDataFrame([(1, [0.5] * 8)], "id long, embedding array<float>"))
    for ask in (lambda: store.info("none"), lambda: store.upsert("none", spark.range(1)), lambda: store.scroll("none"), lambda: store.create("zero", 0)):
        with pytest.raises(CollectionError):
            ask()
    assert store.info("c")["count"] == before and not store.exists("none") and not store.delete_collection("none")
    assert store.delete_collection("c") and not store.exists("c") and store.create("c", 3) and store.info("c")["count"] == 0


# --- filters


@pytest.mark.parametrize("mode", ["dense", "hybrid"])
def test_an_empty_list_is_no_filter(spark, mode):
    rows_ = [(i, i // 2, i % 2, "n", t, v) for i, (t, v) in enumerate([("red fox", [1.0, 0.0]), ("red hen", [0.9, 0.1]), ("blue", [0.0, 1.0])])]
    chunks = spark.createDataFrame(rows_, "id long, document_id long, chunk_index int, name string, text string, embedding array<double>")
    q = spark.createDataFrame([(0, "red fox", [1.0, 0.0])], "qid long, text string, embedding array<double>")
    wanted = {"retrieval_mode": mode}
    assert rows(retrieve.retrieve(chunks, q, wanted, {"document_id": []})) == rows(retrieve.retrieve(chunks, q, wanted)) != rows(retrieve.retrieve(chunks, q, wanted, {"document_id": [1]}))
