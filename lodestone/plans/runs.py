"""Queries over evaluation runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.evalrun import EvaluationRun, summary
from ..operators.store import fresh_folder
from .documents import _METRICS, _answers


def _echo(question: str, settings: dict) -> tuple[str, list[tuple[str, int]]]:
    """A service for want of a model: it says the question, points at a document by its length, and fails at some."""
    if len(question) % 11 == 0:
        raise ValueError("no answer")
    return question, [(str(len(question) % settings["top_k"]), 0)]


def _run(spark, d):
    """The answers of conversations as questions, with gold and a place for every other conversation."""
    a = _answers(spark, d)
    samples = a.select(F.concat_ws("/", "conv_id", "turn").alias("sample_id"), F.col("pred").alias("question"), F.col("gold").alias("answer"), F.when(F.col("conv_id") % 2 == 0, "1").alias("document_id"), F.lit(None).cast("int").alias("chunk_index"))
    run = EvaluationRun.create(samples, fresh_folder(spark, "run"), {"top_k": 3}, part=2000)
    run.go(_echo)
    return run


def evaluation_run(spark, d):
    return _run(spark, d).results().select("sample_id", "error", "em", F.round("f1", 6).alias("f1"), F.round("concise_f1", 6).alias("concise_f1"), "recall", "no_answer")


def evaluation_summary(spark, d):
    m = summary(_run(spark, d).results())
    return m.select(*[c if c.startswith("n") else F.round(c, 6).alias(c) for c in m.columns])


QUERIES = {"evaluation_run": evaluation_run, "evaluation_summary": evaluation_summary}

_SCORED = f"""{_METRICS},
x as (
  select m.conv_id || '/' || m.turn as sample_id, length(pred) % 11 = 0 as bad, gold = '__NO_ANSWER__' as none, em, f1, concise_f1, no_answer,
    case when m.conv_id % 2 = 0 then (length(pred) % 3 = 1)::int::double end as recall from m join a on a.conv_id = m.conv_id and a.turn = m.turn),
y as (
  select sample_id, case when bad then 'no answer' end as error, none, case when not bad and not none then em end as em, case when not bad and not none then f1 end as f1,
    case when not bad and not none then concise_f1 end as concise_f1, case when not bad and not none then recall end as recall, case when not bad then no_answer end as no_answer from x)"""
SQL = {
    "evaluation_run": f"with {_SCORED} select sample_id, error, em, round(f1, 6) as f1, round(concise_f1, 6) as concise_f1, recall, no_answer from y",
    "evaluation_summary": f"""with {_SCORED} select count(*) as n, count(*) filter (error is null and not none) as n_answerable, count(*) filter (error is null and none) as n_no_answer,
  count(error) as n_errors, round(coalesce(avg(em), 0), 6) as mean_em, round(coalesce(avg(f1), 0), 6) as mean_f1, round(coalesce(avg(concise_f1), 0), 6) as mean_concise_f1,
  round(avg(recall), 6) as mean_recall, round(avg(no_answer), 6) as mean_no_answer from y""",
}
