"""Dense retrieval: exact cosine top-k for many queries in one job, and diversity-aware selection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh_folder

#: Query vectors that are sent to the tasks at once; more are searched for in blocks.
BLOCK = 4096
#: Scores that a task holds at once, and how far rounding may put one off.
TILE, SLACK = 1_000_000, 1e-9


def condition(filters: dict) -> Column:
    """A conjunction: a scalar means equality, a list membership, a dict with gte, lte, gt or lt a range."""
    out = F.lit(True)
    for name, want in filters.items():
        c = F.col(name)
        if isinstance(want, dict):
            for op, x in want.items():
                out = out & {"gte": c >= x, "lte": c <= x, "gt": c > x, "lt": c < x}[op]
        else:
            out = out & (c.isin(list(want)) if isinstance(want, (list, tuple, set)) else c == want)
    return out


def top_by(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group with their `rank` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def ranks(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of ids, null first."""
    return pd.factorize(ids.ravel(), sort=True)[0].reshape(ids.shape) if ids.dtype == object else ids


def vectors(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of numbers."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (sizes != sizes[0]).any():
        raise ValueError("vectors have different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), -1)


class Nearest:
    """The k nearest of all rows that are added, for each of some queries (rows of m, of length 1): k rows a query are
    kept, and scores are made a tile at a time, so that what is held doesn't grow with the rows or with a batch.

    A matrix product finds the pairs that may be among the k best; only these are summed up one by one, always in the
    same order, so that equal vectors have equal scores and ties go to the smaller id. NaN ranks first, as in Spark.
    Rows below a query's `floor` are left out.
    """

    def __init__(self, m: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.m, self.k = m, k
        self.floor = np.full(len(m), -np.inf) if floor is None else floor
        self.least = self.floor.copy()
        self.best = np.full((len(m), k), -np.inf)
        self.ids: np.ndarray | None = None
        self.kind: pa.DataType | None = None

    def add(self, ids: pa.Array, x: np.ndarray, who: np.ndarray | None = None) -> None:
        """Rows x with their ids, for all queries or for those in `who`."""
        self.kind = ids.type
        # numbers with nulls would become floats
        own = np.array(ids.to_pylist(), dtype=object) if ids.null_count else ids.to_numpy(zero_copy_only=False)
        norms = np.linalg.norm(x, axis=1)
        x = x / np.where(norms > 0, norms, 1.0)[:, None] if len(x) else x
        who = np.arange(len(self.m)) if who is None else who
        rows = min(1024, max(1, TILE // x.shape[1])) if x.shape[1] else 1024
        for lo in range(0, len(x), rows):
            for at in range(0, len(who), TILE // rows):
                self._tile(own[lo : lo + rows], x[lo : lo + rows], who[at : at + TILE // rows])

    def _tile(self, ids: np.ndarray, x: np.ndarray, who: np.ndarray) -> None:
        near = self.m[who] @ x.T
        may = ~(near < self.least[who][:, None] - SLACK)
        many = np.flatnonzero(may.sum(axis=1) > self.k)
        if len(many):
            kth = np.partition(near[many], -self.k, axis=1)[:, -self.k]
            may[many] &= ~(near[many] < kth[:, None] - 2 * SLACK)
        row, col = np.nonzero(may)
        if not len(row):
            return
        step, score = max(1, TILE // max(1, x.shape[1])), np.empty(len(row))
        for at in range(0, len(row), step):
            score[at : at + step] = (self.m[who[row[at : at + step]]] * x[col[at : at + step]]).sum(axis=1)
        score, q = np.where(np.isnan(score), np.inf, score), who[row]
        keep = score >= self.least[q]
        self._merge(q[keep], ids[col[keep]], score[keep])

    def _merge(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if self.ids is None:
            self.ids = np.zeros(self.best.shape, ids.dtype)
        elif ids.dtype == object and self.ids.dtype != object:
            self.ids = self.ids.astype(object)
        mine = np.unique(q)
        row, col = np.nonzero(self.best[mine] > -np.inf)
        q, score = np.concatenate([q, mine[row]]), np.concatenate([score, self.best[mine[row], col]])
        ids = np.concatenate([ids, self.ids[mine[row], col]])
        order = np.lexsort((ranks(ids), -score, q))
        q, score, ids = q[order], score[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.best[q[top], place[top]], self.ids[q[top], place[top]] = score[top], ids[top]
        self.least[mine] = np.maximum(self.floor[mine], self.best[mine, -1])

    def rows(self, qids: pa.Array, size: int = 100_000) -> Iterator[pa.RecordBatch]:
        """(qid, id, score) of what was kept; qids are the queries' in the order of m."""
        row, col = np.nonzero(self.best > -np.inf)
        for at in range(0, len(row), size):
            r, c = row[at : at + size], col[at : at + size]
            score = self.best[r, c]
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(r)), pa.array(self.ids[r, c], self.kind), pa.array(np.where(score == np.inf, np.nan, score))], names=["qid", "id", "score"])


def search(corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, filters: dict | None = None, block: int = BLOCK) -> DataFrame:
    """(qid, id, score, rank): the k rows of corpus (id, embedding) nearest to each query (qid, embedding) by cosine.

    Filters apply before ranking, the threshold (score >= t) too; ties go to the smaller id. Queries go out in blocks
    of a fixed number; each task multiplies its rows with a block, a tile of scores at a time, and keeps k rows a query
    (Nearest), so only those are shuffled. Of several blocks, each one's rows are written before the next begins, so that the driver and the tasks
    hold one at a time. Null vectors are left out; a vector without length has score 0 with everything.
    """
    if filters:
        corpus = corpus.where(condition(filters))
    corpus = corpus.where("embedding is not null").select("id", "embedding")
    n = queries.count() // block + 1
    wanted = queries.where("embedding is not null")
    result, ranking = None, [F.desc("score"), F.asc("id")]
    folder = fresh_folder(corpus.sparkSession, "dense") if n > 1 else None
    for i in range(n):
        part = wanted if n == 1 else wanted.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)
        rows = part.select("qid", "embedding").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        m = vectors(rows.column(1).combine_chunks())
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        sent = corpus.sparkSession.sparkContext.broadcast((rows.column(0).combine_chunks(), m))

        def nearest(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, m = sent.value
            own = Nearest(m, k, None if threshold is None else np.full(len(m), float(threshold)))
            for b in batches:
                if b.num_rows:
                    own.add(b.column(0), vectors(b.column(1)))
            yield from own.rows(qids)

        found = corpus.mapInArrow(nearest, f"qid {dict(queries.dtypes)['qid']}, id {dict(corpus.dtypes)['id']}, score double")
        if n > 1:
            best = top_by(found, k, ["qid"], ranking).drop("rank")
            best.write.parquet(f"{folder}/{i}")
            sent.unpersist()
            found = corpus.sparkSession.read.schema(best.schema).parquet(f"{folder}/{i}")
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = corpus.select(F.lit(None).cast(dict(queries.dtypes)["qid"]).alias("qid"), "id", F.lit(0.0).alias("score")).limit(0)
    return top_by(result, k, ["qid"], ranking)


def diverse(corpus: DataFrame, queries: DataFrame, k: int, diversity: float = 0.5, pool: int | None = None) -> DataFrame:
    """As search(), but of the `pool` nearest (10 * k unless given) those are chosen, one at a time, that maximise
    (1 - diversity) * score - diversity * (largest cosine with one already chosen). Diversity 0 is plain relevance."""
    near = search(corpus, queries, pool or 10 * k)
    rows = near.join(corpus.select("id", "embedding"), "id")

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        x = np.stack(g["embedding"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        gain, worst, picked = g["score"].to_numpy(), np.full(len(g), -np.inf), []
        for _ in range(min(k, len(g))):
            value = (1 - diversity) * gain - diversity * np.where(np.isinf(worst), 0.0, worst)
            value[picked] = -np.inf
            i = int(np.argmax(value))
            picked.append(i)
            worst = np.maximum(worst, x @ x[i])
        out = g.loc[picked, ["qid", "id", "score"]].copy()
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    types = dict(near.dtypes)
    return rows.groupBy("qid").applyInPandas(choose, f"qid {types['qid']}, id {types['id']}, score double, rank int")


