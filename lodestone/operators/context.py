"""Neighbour windows around hits and budgeted contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand(hits: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """(qid, document_id, chunk_index, score, source, place) of hits (qid, document_id, chunk_index, score, rank) and
    their neighbours in chunks (document_id, chunk_index) up to `window` places away.

    Neighbours score 0. Order is that of the hits, then of the index; a chunk stands where it first appears. With a
    window of 0 or less the hits stay as they are.
    """
    key = ["qid", "document_id", "chunk_index"]
    if window <= 0:
        return hits.select(*key, "score", F.lit("hit").alias("source"), F.col("rank").alias("place"))
    near = F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - window), F.col("chunk_index") + window)
    wide = hits.select("qid", "document_id", "rank", F.explode(near).alias("chunk_index"), F.col("chunk_index").alias("hit"), "score")
    own_score = F.max(F.when(F.col("chunk_index") == F.col("hit"), F.col("score")))  # hits are read once, so their scores come along
    first = wide.groupBy(*key).agg(F.min("rank").alias("rank"), own_score.alias("score"))
    own = first.join(chunks.select("document_id", "chunk_index"), ["document_id", "chunk_index"])
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "chunk_index"))
    source = F.when(F.col("score").isNull(), "window").otherwise("hit")
    return own.select(*key, F.coalesce("score", F.lit(0.0)).alias("score"), source.alias("source"), place.alias("place"))


def pack(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(qid, context, n_sources, n_chars) from rows (qid, rank, name, chunk_index, text).

    Every row becomes a block with a numbered source line; blocks are taken in order until the first that would pass
    the budget. The line feeds between blocks don't count; no budget, or one of 0 or less, means all.
    """
    by = Window.partitionBy("qid").orderBy("rank")
    number = F.row_number().over(by)
    block = F.format_string("[Source %d: %s, chunk %d]\n%s\n", number, F.coalesce("name", F.lit("unknown")), F.coalesce(F.col("chunk_index").cast("int"), F.lit(0)), F.coalesce("text", F.lit("")))
    blocks = rows.withColumn("block", block)
    if most is not None and most > 0:
        used = F.sum(F.length("block")).over(by.rowsBetween(Window.unboundedPreceding, 0))
        blocks = blocks.withColumn("used", used).withColumn("taken", F.col("used") <= most)
    else:
        blocks = blocks.withColumn("taken", F.lit(True))
    parts = F.collect_list(F.when(F.col("taken"), F.struct("rank", "block")))
    text = F.array_join(F.transform(F.array_sort(parts), lambda x: x["block"]), "\n")
    return blocks.groupBy("qid").agg(text.alias("context"), F.count(F.when(F.col("taken"), 1)).alias("n_sources")).withColumn("n_chars", F.length("context").cast("long"))
