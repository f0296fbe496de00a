"""Retrieval from settings to contexts, for many queries in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ANALYZERS
from . import context, dense, fuse, lexical, settings

#: How bm25_match_mode names the modes of lexical.bm25.
MODES = {"strict": "all", "balanced": "balanced"}


def given(filters: dict | None) -> dict:
    """Filters without those on empty lists, which ask for nothing."""
    return {n: v for n, v in (filters or {}).items() if not (isinstance(v, (list, tuple, set)) and not v)}


def lexical_filters(filters: dict | None) -> dict:
    """Of filters on chunks those that lexical search knows: document_id, and chunk_index as a range."""
    return {n: v for n, v in (filters or {}).items() if n == "document_id" and v or n == "chunk_index" and isinstance(v, dict)}


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    wanted: dict | None = None,
    filters: dict | None = None,
    scorer: Callable[[Column, Column], Column] = fuse.overlap_score,
    stop: Sequence[str] = (),
) -> DataFrame:
    """(qid, document_id, chunk_index, name, text, score, source, rank) of chunks (id, document_id, chunk_index, name, text,
    embedding) for queries (qid, text, embedding).

    `wanted` are resolved settings (settings.FIELDS; null or absent means the default). Mode `hybrid` fuses dense and
    lexical hits, with the lexical floor for queries that name a numbered item; any other mode is dense. Then follow
    reranking of the first rerank_candidate_pool hits, and neighbours within context_window where context_expansion
    lists `window`. Filters apply to both searches (lexical_filters), an empty list is no filter, neighbours are taken from all chunks, and lexical
    statistics cover all chunks. Queries without text ask nothing.
    """
    s = {n: (wanted or {}).get(n) if (wanted or {}).get(n) is not None else default for n, (_, default) in settings.FIELDS.items()}
    asked = queries.where(F.trim("text") != "").select("qid", "text", "embedding")
    hybrid = s["retrieval_mode"] == "hybrid"
    first = max(s["top_k"], 10) if hybrid else s["top_k"]
    filters = given(filters)
    own, least = chunks.where(dense.condition(filters)) if filters else chunks, s["score_threshold"]
    if s["use_mmr"]:
        near = dense.diverse(own, asked, first, s["mmr_diversity"])
        near = near if least is None else near.where(F.col("score") >= least)
    else:
        near = dense.search(own, asked, first, least)
    if hybrid:
        mode = MODES.get(s["bm25_match_mode"].lower(), "any")
        share = None if mode == "all" else s["bm25_min_should_match"]
        among = lexical_filters(filters)
        found = lexical.bm25(chunks, asked, s["lexical_top_k"] or first, mode, share, s["bm25_use_phrase"], stop, dense.condition(among) if among else None, s["bm25_analyzer"] if s["bm25_analyzer"] in ANALYZERS else "plain")
        floor = F.when(fuse.identifier("text").isNotNull(), fuse.FLOOR)
        by_query = fuse.with_floor(F.lit(s["hybrid_dense_weight"]), F.lit(s["hybrid_lexical_weight"]), floor)
        weights = asked.select("qid", by_query[0].alias("dense_weight"), by_query[1].alias("lexical_weight"))
        near = fuse.fuse(near, found, s["top_k"], threshold=least, weights=weights)
    hits = near.select("qid", "id", "score", "rank")
    body = chunks.select("id", "document_id", "chunk_index", "name", "text")
    if s["rerank_enabled"]:
        pool = max(1, s["rerank_candidate_pool"]) if s["rerank_candidate_pool"] else s["top_k"]
        rows = hits.where(F.col("rank") <= pool).join(body.select("id", "text"), "id").join(asked.select("qid", F.col("text").alias("query")), "qid")
        hits = fuse.rerank(rows, max(1, s["rerank_top_n"] or s["top_k"]), s["rerank_min_score"], scorer).select("qid", "id", "score", "rank")
    placed = hits.join(body.select("id", "document_id", "chunk_index"), "id")
    window = s["context_window"] or 0 if "window" in (s["context_expansion"] or []) else 0
    wide = context.expand(placed, body, window).withColumnRenamed("place", "rank")
    return wide.join(body.drop("id"), ["document_id", "chunk_index"]).select("qid", "document_id", "chunk_index", "name", "text", "score", "source", "rank")


def contexts(found: DataFrame, wanted: dict | None = None) -> DataFrame:
    """(qid, context, n_sources, n_chars) of retrieve()'s rows, within max_context_chars."""
    return context.pack(found, (wanted or {}).get("max_context_chars"))
