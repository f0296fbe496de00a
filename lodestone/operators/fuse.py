"""Weighted fusion of dense and lexical hits, identifier queries, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, terms
from .dense import top_by

#: What a query that asks for a numbered item looks like, in the order in which the forms are tried.
IDENTIFIER_PATTERNS = (
    r"\bquestion\s+\d+",
    r"\bвопрос[у-яё]*\s*№?\s*\d+",
    r"\b(?:page|страниц[аеуы]|стр\.?|p\.)\s*\d+",
    r"\b(?:sub)?section\s+\d+(?:\.\d+)*",
    r"\b(?:раздел|подраздел|глава|параграф)\s*\d+(?:\.\d+)*",
    r"\b(?:activity|exercise|unit|chapter|задание|упражнение|tma|ema|task)\s*\d+",
    r"\b(?:table|figure|fig\.?|equation|eq\.?|таблиц[аеу]|рис(?:унок|\.)?|формул[аеу])\s*\d+",
    r"§\s*\d+(?:\.\d+)*",
)
#: Least lexical weight for such a query.
FLOOR = 0.7


def identifier(query: Column | str) -> Column:
    """The part of the query that names a numbered item by the first form that fits, else null."""
    q = col(query)
    found = [F.regexp_extract(q, f"(?iuU){p}", 0) for p in IDENTIFIER_PATTERNS]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def with_floor(dense: Column, lexical: Column, floor: Column) -> tuple[Column, Column]:
    """Weights with the lexical one raised to the floor; only where that changes it, the dense one is the rest of 1."""
    raised = F.greatest(lexical, F.coalesce(floor, F.lit(0.0)))
    return F.when(raised > lexical, 1 - raised).otherwise(dense), raised


def fuse(dense: DataFrame, lexical: DataFrame, k: int, dense_weight: float = 0.6, lexical_weight: float = 0.4, threshold: float | None = None, weights: DataFrame | None = None) -> DataFrame:
    """(qid, id, dense_score, lexical_score, dense_norm, lexical_norm, score, source, rank) from hits (qid, id, score).

    Weights are scaled to sum to 1 if that is positive. Each list is divided by its query's largest score, where 0
    counts as 1; a missing side adds 0. The threshold applies to the fused score. Ties go to the smaller id.
    `weights` (qid, dense_weight, lexical_weight; a row per query) takes the place of the two for all queries.
    """
    wd, wl = (F.lit(float(dense_weight)), F.lit(float(lexical_weight))) if weights is None else (F.col("dense_weight"), F.col("lexical_weight"))
    total = F.when(wd + wl > 0, wd + wl).otherwise(1.0)

    def scaled(hits: DataFrame, name: str) -> DataFrame:
        most = F.max("score").over(Window.partitionBy("qid"))
        return hits.select("qid", "id", F.col("score").alias(f"{name}_score"), (F.col("score") / F.when(most == 0, 1.0).otherwise(most)).alias(f"{name}_norm"))

    both = scaled(dense, "dense").join(scaled(lexical, "lexical"), ["qid", "id"], "full_outer")
    source = F.when(F.col("dense_score").isNull(), "lexical").when(F.col("lexical_score").isNull(), "dense").otherwise("hybrid")
    norms = {c: F.coalesce(c, F.lit(0.0)) for c in ("dense_norm", "lexical_norm")}
    both = both if weights is None else both.join(weights.select("qid", "dense_weight", "lexical_weight"), "qid")
    score = wd / total * F.col("dense_norm") + wl / total * F.col("lexical_norm")
    out = both.withColumns(norms | {"source": source}).withColumn("score", score).drop("dense_weight", "lexical_weight")
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    return top_by(out, k, ["qid"], [F.desc(F.round("score", 9)), F.asc("id")])


def overlap_score(query: Column, text: Column) -> Column:
    """The offline scorer: the share of the query's distinct terms that the text has."""
    q = F.array_distinct(terms(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, terms(text))).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def rerank(hits: DataFrame, keep: int, least: float | None = None, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """hits (qid, id, query, text, score) with `score` from the scorer and `before` the earlier one; best `keep` a query.

    A row for which the scorer fails (null) keeps its place by the earlier score, after all scored ones.
    """
    new = hits.withColumn("before", F.col("score")).withColumn("score", scorer(F.col("query"), F.col("text")))
    if least is not None:
        new = new.where(F.col("score").isNull() | (F.col("score") >= least))
    return top_by(new.drop("rank"), keep, ["qid"], [F.desc_nulls_last(F.round("score", 9)), F.desc(F.round("before", 9)), F.asc("id")])
