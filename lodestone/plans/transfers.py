"""Queries over exports and imports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transfer
from ..operators.store import fresh_folder
from .retrieval import read


def _tables(spark, d):
    """Sources as collections, with their documents, vectors and conversations; every message cites two documents."""
    docs, talk, e = read(spark, d, "documents"), read(spark, d, "conversations"), read(spark, d, "embeddings")
    source = F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"))
    collections = docs.select(F.col("source").alias("id")).where("id is not null").distinct().select("id", F.concat(F.lit("of "), "id").alias("name"), F.lit("m").alias("embedding_model"), F.lit(64).alias("embedding_dimension"))
    documents = docs.where("source is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("collection_id"), F.sha2("text", 256).alias("content_hash"))
    vectors = e.select(F.concat(F.lit("v"), "vec_id").alias("id"), F.col("vec_id").cast("string").alias("document_id"), "label")
    conversations = talk.select(F.col("conv_id").cast("string").alias("id"), source.alias("collection_id")).distinct()
    cited = F.array(*[F.struct(c.cast("string").alias("document_id"), F.col("turn").cast("int").alias("chunk_index")) for c in (F.col("conv_id"), F.col("conv_id") + 1000000)])
    messages = talk.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("conversation_id"), F.coalesce("text", F.lit("")).alias("content"), cited.alias("sources"))
    return {"collections": collections, "documents": documents, "vectors": vectors, "conversations": conversations, "messages": messages}


def _moved(spark, d, **how):
    """Five collections, exported and imported into a catalog whose rows are older ones."""
    tables = _tables(spark, d)
    folder = fresh_folder(spark, "export")
    few = tables["collections"].where("id in ('src1', 'src2', 'src3', 'src4', 'src5')").select("id")
    transfer.export(tables, few, folder)
    archive, _ = transfer.read(spark, folder)
    old = tables | {"collections": tables["collections"].where("id <> 'src2'").withColumn("name", F.lit("old")), "documents": tables["documents"].where("collection_id <> 'src2'").withColumn("content_hash", F.lit("old")), "messages": tables["messages"].limit(0), "conversations": tables["conversations"].limit(0)}
    return transfer.import_into(old, archive, **how)


def import_merge(spark, d):
    tables, _ = _moved(spark, d, mode="merge")
    return tables["documents"].select("id", "collection_id", "content_hash")


def import_report(spark, d):
    return _moved(spark, d, mode="merge")[1]


def import_renamed(spark, d):
    """The messages that came along, with new ids for all, and for the sources whose documents came along."""
    tables, _ = _moved(spark, d, salt="s")
    return tables["messages"].select("id", "conversation_id", F.sha2("content", 256).alias("content_sha256"), F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["document_id"], s["chunk_index"])), ",").alias("sources"))


QUERIES = {"import_merge": import_merge, "import_report": import_report, "import_renamed": import_renamed}

_COME = """five as (select unnest(['src1', 'src2', 'src3', 'src4', 'src5']) as id),
c as (select distinct source as id from documents where source is not null),
d as (select doc_id::varchar as id, source as collection_id, sha256(text) as content_hash from documents where source is not null),
x as (select distinct conv_id::varchar as id, 'src' || (conv_id % 20) as collection_id from conversations),
dc as (select * from d where collection_id in (select id from five)),
xc as (select * from x where collection_id in (select c.id from five join c using (id))),
v as (select vec_id::varchar as document_id from embeddings),
m as (select conv_id::varchar as conversation_id, conv_id, turn, coalesce(text, '') as content from conversations where conv_id::varchar in (select id from xc))"""
SQL = {
    "import_merge": f"with {_COME} select id, collection_id, case when collection_id in (select id from five) then content_hash else 'old' end as content_hash from d",
    "import_report": f"""with {_COME}
select 'collections' as name, count(*) filter (id = 'src2') as created, count(*) filter (id <> 'src2') as updated, 0 as orphans from five join c using (id)
union all select 'documents', count(*) filter (collection_id = 'src2'), count(*) filter (collection_id <> 'src2'), 0 from dc
union all select 'vectors', 0, count(*), 0 from v where document_id in (select id from dc)
union all select 'conversations', count(*), 0, 0 from xc
union all select 'messages', count(*), 0, 0 from m""",
    "import_renamed": f"""with {_COME}
select sha256('s:' || conv_id || '/' || turn)[:32] as id, sha256('s:' || conversation_id)[:32] as conversation_id, sha256(content) as content_sha256,
  case when conversation_id in (select id from dc) then sha256('s:' || conv_id)[:32] else conversation_id end || ':' || turn || ',' ||
    case when (conv_id + 1000000)::varchar in (select id from dc) then sha256('s:' || (conv_id + 1000000))[:32] else (conv_id + 1000000)::varchar end || ':' || turn as sources from m""",
}
