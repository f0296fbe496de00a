"""Both stores kept up to date from a stream of documents, a batch at a time and each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.lexical_index import LexicalIndex
from ..operators.vector_store import VectorStore

#: Stages of a document's way into the stores and how much of it is done at their end, in percent.
STAGES = {"pending": 0, "lexical": 50, "done": 100}
PROGRESS = "id long, stage string, percent int, batch string"


def clamped(percent) -> Column:
    """A percentage between 0 and 100."""
    c = percent if isinstance(percent, Column) else F.lit(percent)
    return F.greatest(F.lit(0), F.least(F.lit(100), c.cast("int")))


def newest(batch: DataFrame) -> DataFrame:
    """The last change of each id in a batch (id, text, embedding, deleted, ts); of equal times a deletion, then the
    greatest text. Rows without id are left out. Whole rows are compared in partial aggregates, so one id that comes
    very often is no hot task."""
    rank = F.struct("ts", F.coalesce("deleted", F.lit(False)).alias("gone"), "text")
    value = F.struct("text", "embedding", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    return batch.where("id is not null").groupBy("id").agg(F.max_by(value, rank).alias("x")).select("id", "x.*")


def record(changes: DataFrame, stage: str, batch: str, path: str) -> None:
    """The stage that a batch's documents have reached, as a piece of its own: a batch that comes again writes over it."""
    rows = changes.select(F.col("id").cast("long").alias("id"), F.lit(stage).alias("stage"), clamped(STAGES[stage]).alias("percent"))
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}/at={stage}")


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(id, stage, percent): how far each document has come in the last batch that it was in."""
    rows = spark.read.schema("id long, stage string, percent int, batch string, at string").parquet(path)
    number = F.regexp_extract("batch", r"(\d+)$", 1).cast("long")
    return rows.groupBy("id").agg(F.max_by(F.struct("stage", "percent"), F.struct(number, F.col("percent"))).alias("x")).select("id", "x.*")


def apply(changes: DataFrame, name: str, index: LexicalIndex, store: VectorStore, collection: str, path: str) -> None:
    """One batch's changes (of newest()) brought into the index, then into the collection. `name` is the batch's, and
    each store knows it once it has it: after a failure at any point, the same call does only what is left to do."""
    changes = changes.persist()
    try:
        record(changes, "pending", name, path)
        alive = changes.where("not deleted")
        index.change(add=alive.select("id", "text"), remove=changes.select("id"), batch=name)
        record(changes, "lexical", name, path)
        placed = alive.where("embedding is not null")
        # a document that lost its vector, or itself, has none in the collection either
        store.remove(collection, changes.join(placed.select("id"), "id", "left_anti").select("id"), batch=f"{name}-")
        store.upsert(collection, placed.select("id", "embedding"), batch=name)
        record(changes, "done", name, path)
    finally:
        changes.unpersist()


def maintain(stream: DataFrame, name: str, index: LexicalIndex, store: VectorStore, collection: str, folder: str, before: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start bringing a stream (id, text, embedding, deleted, ts) into both stores; all that is there is taken, then it ends.

    Batches are numbered by the stream's checkpoint in `folder`, where progress is kept too. A batch that failed comes
    again under its number and changes what is left of it. `before` is called with each batch's number.
    """

    def handle(batch: DataFrame, number: int) -> None:
        if before:
            before(number)
        apply(newest(batch), f"{name}-{number}", index, store, collection, f"{folder}/progress")

    return stream.writeStream.queryName(name).foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


class BatchLog(StreamingQueryListener):
    """Writes a row (name, batch, rows, seconds) for every batch of every named stream to a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (p.name or "", int(p.batchId), int(p.numInputRows), float(p.batchDuration or 0) / 1000)
        self.spark.createDataFrame([row], "name string, batch long, rows long, seconds double").write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
