"""Queries over the persisted stores: the inverted index and the vector collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lexical_index import LexicalIndex
from ..operators.store import fresh_folder
from ..operators.vector_store import VectorStore
from .retrieval import DENSE, TERMS, _bm25_sql, _texts, _vectors, read


def _updated(spark, d):
    """An index whose documents first had their source as text and were then replaced."""
    docs, asked = _texts(spark, d)
    old = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("text"))
    index = LexicalIndex.built(old, fresh_folder(spark, "index"))
    index.change(add=docs, remove=docs.select("id"), batch=1)
    index.change(add=docs, batch=1)  # a batch that comes again changes nothing
    return index, asked


def bm25_updated(spark, d):
    index, asked = _updated(spark, d)
    return index.search(asked, 10, skip=True).select("qid", "id", F.round("score", 6).alias("score"), "matched", "rank")


def index_scan(spark, d):
    index = LexicalIndex.built(_texts(spark, d)[0], fresh_folder(spark, "index"))
    return index.scan().select("id", F.size("terms").cast("long").alias("n_terms"), F.sha2(F.array_join("terms", " "), 256).alias("terms_sha256"))


def index_compacted(spark, d):
    """Terms with the number of documents that have them and their share of all, after deletions were compacted away."""
    index, _ = _updated(spark, d)
    index.compact()
    n, _ = index.statistics()
    return index.frequencies().select("term", "df", F.round(F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def _store(spark, d):
    """A collection whose vectors were first their own negatives and were then replaced."""
    rows, asked = _vectors(spark, d)
    store = VectorStore(spark, fresh_folder(spark, "vectors"))
    store.create("chunks", 64, "label int")
    store.upsert("chunks", rows.withColumn("embedding", F.transform("embedding", lambda x: -x)))
    store.upsert("chunks", rows, batch=1)
    store.upsert("chunks", rows.limit(0), batch=1)
    return store, asked


def vector_store_topk(spark, d):
    store, asked = _store(spark, d)
    return store.search("chunks", asked, 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def vector_store_filtered(spark, d):
    store, asked = _store(spark, d)
    return store.search("chunks", asked, 5, 0.05, {"label": [1, 2, 3], "id": {"gte": 10}}).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def vector_scroll(spark, d):
    """The second page of the rows of three labels."""
    store, _ = _store(spark, d)
    _, cursor = store.scroll("chunks", {"label": [1, 2, 3]}, 50)
    page, _ = store.scroll("chunks", {"label": [1, 2, 3]}, 50, cursor)
    return page.select("id", "label", F.lit(0.0).alias("score"))


def vector_collections(spark, d):
    """What is known of a collection after the rows of one label were deleted."""
    store, _ = _store(spark, d)
    store.remove_where("chunks", {"label": 7})
    store.create("empty", 3)
    names = [n for n in ("chunks", "empty", "absent") if store.exists(n)]
    return spark.createDataFrame([(x["name"], x["size"], x["distance"], x["count"]) for x in map(store.info, names)], "name string, size int, distance string, n_vectors long")


QUERIES = {
    "bm25_updated": bm25_updated,
    "index_scan": index_scan,
    "index_compacted": index_compacted,
    "vector_store_topk": vector_store_topk,
    "vector_store_filtered": vector_store_filtered,
    "vector_scroll": vector_scroll,
    "vector_collections": vector_collections,
}

_D = f"select doc_id as id, coalesce({TERMS.format('text')}, []) as ts from documents"
SQL = {
    "bm25_updated": _bm25_sql(0),
    "index_scan": f"select id, len(ts) as n_terms, sha256(array_to_string(ts, ' ')) as terms_sha256 from ({_D})",
    "index_compacted": f"""with docs as ({_D}), df as (select term, count(*) as df from (select unnest(list_distinct(ts)) as term from docs) group by 1)
select term, df, round(ln(1 + ((select count(*) from docs) - df + 0.5) / (df + 0.5)), 6) as idf from df""",
    "vector_store_topk": f"with {DENSE.format(where='')} select qid, id, round(score, 6) as score, rank from r where rank <= 10",
    "vector_store_filtered": f"with {DENSE.format(where='and e.label in (1, 2, 3) and e.id >= 10 and list_cosine_similarity(q.v, e.v) >= 0.05')} select qid, id, round(score, 6) as score, rank from r where rank <= 5",
    "vector_scroll": "select vec_id as id, label, 0.0::double as score from embeddings where label in (1, 2, 3) order by vec_id limit 50 offset 50",
    "vector_collections": "select 'chunks' as name, 64 as size, 'cosine' as distance, count(*) as n_vectors from embeddings where label <> 7 union all select 'empty', 3, 'cosine', 0",
}
