"""Evaluation runs over gold samples: frozen settings, a deadline for each answer, and parts that a restart skips."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import NO_ANSWER_SENTINEL, declines, strip
from . import evaluate
from .store import Versions

#: Seconds that an answer may take, and samples of a part.
DEADLINE, PART = 90.0, 1000
SOURCES = "array<struct<document_id:string,chunk_index:int>>"
#: What a service gives for a question and the run's settings: the answer and its sources (document_id, chunk_index).
Service = Callable[[str, dict], tuple[str, list[tuple[str, int]]]]


def answered(samples: DataFrame, service: Service, settings: dict, deadline: float = DEADLINE) -> DataFrame:
    """(sample_id, pred, sources, error) of samples (sample_id, question): a service asked for each in the tasks.

    An answer that takes longer than the deadline, or fails, gives a row with its error and no answer; others go on.
    What is too late runs on in a thread that nothing waits for.
    """

    def ask(question: str) -> tuple:
        said: list = []

        def call() -> None:
            try:
                said.append((*service(question, settings), None))
            except Exception as e:  # a service may fail in any way; what it says is the row's error
                said.append((None, [], str(e)))

        t = threading.Thread(target=call, daemon=True)
        t.start()
        t.join(deadline)
        return said[0] if said else (None, [], f"timeout after {deadline:g}s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [ask(q or "") for q in b["question"]]
            yield pd.DataFrame({"sample_id": b["sample_id"], "pred": [g[0] for g in got], "sources": [[{"document_id": d, "chunk_index": i} for d, i in g[1]] for g in got], "error": [g[2] for g in got]})

    return samples.select("sample_id", "question").mapInPandas(run, f"sample_id string, pred string, sources {SOURCES}, error string")


def scored(rows: DataFrame) -> DataFrame:
    """rows (sample_id, pred, gold, document_id, chunk_index, sources, error) with their metrics: of a sample that
    expects no answer only no_answer, of others em, f1, concise_f1 and recall, of errors none."""
    none = strip("gold") == NO_ANSWER_SENTINEL
    fine = F.col("error").isNull()
    when = lambda cond, c: F.when(fine & cond, c)
    return rows.withColumns(
        {
            "em": when(~none, evaluate.exact_match("pred", "gold")),
            "f1": when(~none, evaluate.token_f1("pred", "gold")),
            "concise_f1": when(~none, evaluate.concise_f1("pred", "gold")),
            "recall": when(~none, evaluate.recall("sources", "document_id", "chunk_index")),
            "no_answer": when(none, declines("pred").cast("double")),
            "expects_none": none,
        }
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row of scored() rows: counts and errors, means of em and the f1s (0 of nothing), and the means of recall and
    no_answer (null of nothing; samples that name no place have no recall)."""
    fine = F.col("error").isNull()
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}")
    count = lambda c: F.count_if(c)
    return rows.agg(
        F.count("*").alias("n"),
        count(fine & ~F.col("expects_none")).alias("n_answerable"),
        count(fine & F.col("expects_none")).alias("n_no_answer"),
        count(~fine).alias("n_errors"),
        mean("em"),
        mean("f1"),
        mean("concise_f1"),
        F.avg("recall").alias("mean_recall"),
        F.avg("no_answer").alias("mean_no_answer"),
    )


class EvaluationRun:
    """A run in a shared folder. Its settings and samples are fixed when it is created; each part of the samples is
    answered, scored and written as a whole, and then known to be done. A run that was broken off goes on with the
    parts that are left, and its results are those of an unbroken one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)

    @classmethod
    def create(cls, samples: DataFrame, path: str, settings: dict, limit: int | None = None, order: Column | None = None, part: int = PART) -> EvaluationRun:
        """samples: sample_id, question, answer, document_id, chunk_index; with a limit, the first by `order` (else by
        sample_id). A run without samples is an error; one that exists stays as it is."""
        own = cls(samples.sparkSession, path)
        if own.versions.exists():
            return own
        rows = samples.select(F.col("sample_id").cast("string").alias("sample_id"), "question", F.coalesce("answer", F.lit("")).alias("gold"), F.col("document_id").cast("string").alias("document_id"), F.col("chunk_index").cast("int").alias("chunk_index"))
        if limit is not None:
            rows = rows.orderBy(*([order] if order is not None else []), "sample_id").limit(limit)
        n = rows.count()
        if not n:
            raise ValueError("there are no gold samples")
        parts = -(-n // part)
        own_part = F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("int")
        rows.withColumn("part", own_part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{own.path}/samples")
        own.versions.commit(0, [{"piece": 0, "kind": "run", "settings": json.dumps(settings, sort_keys=True), "samples": n, "parts": parts}])
        return own

    def _run(self) -> dict:
        return next(x for x in self.versions.pieces() if x["kind"] == "run")

    def settings(self) -> dict:
        return json.loads(self._run()["settings"])

    def _done(self) -> list[int]:
        return sorted(x["part"] for x in self.versions.pieces() if x["kind"] == "part")

    def status(self) -> dict:
        """samples, processed and whether the run is `running` or `completed`."""
        run, done = self._run(), self._done()
        processed = self._samples().where(F.col("part").isin(done)).count() if done else 0
        return {"samples": run["samples"], "processed": processed, "status": "completed" if len(done) == run["parts"] else "running"}

    def _samples(self) -> DataFrame:
        return self.spark.read.schema("sample_id string, question string, gold string, document_id string, chunk_index int, part int").parquet(f"{self.path}/samples")

    def go(self, service: Service, deadline: float = DEADLINE) -> None:
        """Answer the parts that aren't done yet, as many in one job as there are cores; each part's answers are asked for
        once. A part counts as done when the version says so: what a run that was broken off left of others is written
        over."""
        left, wave = sorted(set(range(self._run()["parts"])) - set(self._done())), self.spark.sparkContext.defaultParallelism
        for at in range(0, len(left), wave):
            parts = left[at : at + wave]
            own = self._samples().where(F.col("part").isin(parts))
            rows = scored(own.join(answered(own, service, self.settings(), deadline), "sample_id"))
            dealt = rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            dealt.partitionBy("part").parquet(f"{self.path}/results")
            for part in parts:
                number, pieces = self.versions.number(), self.versions.pieces()
                self.versions.commit(number, [*pieces, {"piece": 0, "kind": "part", "part": part}])

    def results(self) -> DataFrame:
        """The rows of the parts that are done."""
        done = self._done()
        schema = scored(self._samples().drop("part").limit(0).withColumns({"pred": F.lit(None).cast("string"), "sources": F.lit(None).cast(SOURCES), "error": F.lit(None).cast("string")})).schema
        if not done:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("part", IntegerType())])).parquet(f"{self.path}/results")
        return rows.where(F.col("part").isin(done)).drop("part")
