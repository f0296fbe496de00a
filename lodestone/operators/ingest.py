"""Ingestion: payloads of chunks, lexical documents made from them, and a batch job over documents with statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from . import chunk, structure


def payloads(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """A payload per chunk (doc_id, chunk_index, content, start_char, end_char) from docs (doc_id, collection, name,
    file_type, text, and pages if any: an array of (off, physical, logical)).

    Markdown documents give each chunk the headings in force at its start; a page without a printed number counts by
    its place. Only a document's headings and pages meet its chunks, not its text.
    """
    heads = F.when(F.col("file_type") == "md", structure.headings("text")).otherwise(F.array().cast("array<struct<pos:int,level:int,text:string>>"))
    pages = F.col("pages") if "pages" in docs.columns else F.array().cast("array<struct<off:int,physical:int,logical:int>>")
    own = chunks.join(docs.select("doc_id", "collection", "name", "file_type", heads.alias("heads"), pages.alias("pages")), "doc_id")
    before = F.filter("heads", lambda h: h["pos"] <= F.col("start_char"))
    last, page = F.try_element_at(before, F.lit(-1)), structure.page_at("pages", "start_char")
    path = F.array_join(structure.section_path("heads", "start_char"), " > ")
    return own.select(
        "doc_id",
        "collection",
        "chunk_index",
        F.col("content").alias("text"),
        F.length("content").alias("char_count"),
        F.size(words("content")).alias("word_count"),
        "start_char",
        "end_char",
        "name",
        "file_type",
        last["text"].alias("section_heading"),
        F.when(last.isNotNull(), path).alias("section_path"),
        last["level"].alias("section_level"),
        page["physical"].alias("page_number_physical"),
        F.coalesce(page["logical"], page["physical"]).alias("page_number"),
    )


def lexical_documents(rows: DataFrame) -> DataFrame:
    """What the lexical index holds of payloads; the key is document and chunk."""
    kept = ("chunk_index", "text", "char_count", "word_count", "page_number", "page_number_physical", "section_heading", "section_path", "section_level")
    return rows.select(F.concat_ws(":", "doc_id", "chunk_index").alias("key"), "doc_id", *kept)


def process(docs: DataFrame, size: int = 1000, overlap: int = 200, lexical_fails: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(payloads, statuses) of docs that aren't being processed already (status `processing`).

    statuses: doc_id, status, embeddings_status, bm25_status, progress, chunk_count, error. A document without text
    fails. One that the lexical index fails for (doc_ids in lexical_fails) is complete all the same, its bm25_status
    says failed. Made where documents lie; only counts are shuffled.
    """
    free = docs.where("coalesce(status, 'pending') <> 'processing'")
    made = chunk.chunk_plain(free.select("doc_id", "text"), size, overlap).withColumnRenamed("start_char", "start")
    made = made.select("doc_id", (F.col("start") / (size - overlap)).cast("int").alias("chunk_index"), "content", F.col("start").alias("start_char"), "end_char")
    rows = payloads(made, free)
    per = made.groupBy("doc_id").agg(F.count("*").alias("n"))
    own = free.select("doc_id").join(per, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = own.join(lexical_fails.select("doc_id", F.lit(True).alias("failed")).distinct(), "doc_id", "left") if lexical_fails is not None else own.withColumn("failed", F.lit(False))
    good = F.col("n") > 0
    statuses = own.select(
        "doc_id",
        F.when(good, "completed").otherwise("failed").alias("status"),
        F.when(good, "completed").otherwise("failed").alias("embeddings_status"),
        F.when(good & ~F.coalesce("failed", F.lit(False)), "completed").otherwise("failed").alias("bm25_status"),
        F.when(good, 100).otherwise(0).alias("progress"),
        F.col("n").alias("chunk_count"),
        F.when(~good, "no text").alias("error"),
    )
    return rows, statuses


def reprocess(stored: DataFrame, docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(all payloads, statuses) after the chunks of docs were deleted and made anew; documents in processing stay."""
    rows, statuses = process(docs, **options)
    return stored.join(statuses.select("doc_id"), "doc_id", "left_anti").unionByName(rows), statuses
