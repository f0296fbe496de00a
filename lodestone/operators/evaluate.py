"""Metrics of question answering and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NO_ANSWER_SENTINEL, col, declines, eval_tokens, first_sentence, strip


def normal(c: Column | str) -> Column:
    return F.array_join(eval_tokens(c), " ")


def exact_match(pred: Column | str, gold: Column | str) -> Column:
    return (normal(pred) == normal(gold)).cast("double")


def token_f1(pred: Column | str, gold: Column | str) -> Column:
    """F1 of the two bags of tokens; 0 where either is empty. A token counts as often as both have it: each token is
    numbered among its like in the sorted bag, so that the overlap is that of two sets."""

    def score(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))

    def tally(bag: Column) -> Column:
        s = F.array_sort(bag)
        return F.get(F.transform(F.array(s), lambda t: F.transform(t, lambda x, i: F.concat(x, F.lit(" "), (i + 1 - F.array_position(t, x)).cast("string")))), F.lit(0))

    bags = F.array(F.struct(tally(eval_tokens(pred)).alias("a"), tally(eval_tokens(gold)).alias("b")))
    return F.get(F.transform(bags, lambda x: score(x["a"], x["b"])), F.lit(0))


def concise_f1(pred: Column | str, gold: Column | str) -> Column:
    return token_f1(first_sentence(pred), first_sentence(gold))


def recall(sources: Column | str, document_id: Column | str, chunk_index: Column | str) -> Column:
    """1 if any of the sources (document_id, chunk_index) is the one wanted, else 0; null where none is named. A
    document id that is empty names none."""
    doc, index = F.nullif(col(document_id), F.lit("")), col(chunk_index)
    fits = lambda s: (doc.isNull() | F.coalesce(s["document_id"] == doc, F.lit(False))) & (index.isNull() | F.coalesce(s["chunk_index"] == index, F.lit(False)))
    hit = F.coalesce(F.exists(col(sources), fits), F.lit(False))
    return F.when(doc.isNull() & index.isNull(), F.lit(None).cast("double")).otherwise(hit.cast("double"))


def metrics(rows: DataFrame) -> DataFrame:
    """rows (pred, gold) with em, f1, concise_f1 and, where no answer is expected, no_answer."""
    wanted = strip("gold") == NO_ANSWER_SENTINEL
    return rows.withColumns({"em": exact_match("pred", "gold"), "f1": token_f1("pred", "gold"), "concise_f1": concise_f1("pred", "gold"), "no_answer": F.when(wanted, declines("pred").cast("double"))})


def summary(rows: DataFrame) -> DataFrame:
    """One row: counts and means of metrics() rows; means of nothing are 0, but null for no_answer."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}")
    return rows.agg(F.count("*").alias("n"), mean("em"), mean("f1"), mean("concise_f1"), F.avg("no_answer").alias("mean_no_answer"))


def results(runs: DataFrame, samples: DataFrame, least_f1: float | None = None) -> DataFrame:
    """Results (sample_id, f1, ...) with the question and answer of their samples, empty where a sample was deleted; with
    least_f1 only those below it, where a missing f1 counts as 1."""
    own = runs.join(samples.select("sample_id", "question", "answer"), "sample_id", "left").fillna("", ["question", "answer"])
    return own if least_f1 is None else own.where(F.coalesce(F.col("f1"), F.lit(1.0)) < least_f1)
