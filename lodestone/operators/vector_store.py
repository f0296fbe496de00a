"""Persisted collections of vectors, clustered into files with centre and radius, so that exact search leaves files out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dense import SLACK, Nearest, condition, top_by, vectors
from .store import Versions, batches_of, empty

#: Clusters at most, vectors that their centres are learned from at most, and rounds of learning.
CLUSTERS, LEARNED, ROUNDS = 256, 20_000, 8
#: Queries that are sent to the tasks at once, and clusters nearest to each that are searched first.
QUERIES, SEEDS = 4096, 4
#: The cluster of vectors without length.
NOWHERE = -1
#: Rows of a page at most.
PAGE = 10_000


class CollectionError(ValueError):
    """What was asked of a collection can't be done to it."""


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and the lengths they had; a row without length stays."""
    norms = np.linalg.norm(x, axis=1)
    return x / np.maximum(norms, 1e-300)[:, None], norms


def centres(x: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Spherical k-means of unit rows: n centres of length 1, or as many as there are different rows."""
    x = np.unique(x, axis=0)
    own = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ own.T).argmax(axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, nearest, x)
        moved, lengths = unit(sums)
        own = np.where(lengths[:, None] > 0, moved, own)
    return own


class VectorStore:
    """Collections of vectors with payload columns in a shared folder.

    Vectors are compared by cosine. Each is put into the cluster of the nearest centre; a cluster of a piece is a folder
    of its own, with the number of its vectors and the greatest distance from the centre. As the distance of unit
    vectors obeys the triangle inequality, a cluster whose nearest edge is farther from a query than its k-th hit holds
    none of its hits and isn't read. Centres are learned from the first rows that come in, at most LEARNED of them;
    however well they fit, every vector is indexed and results are exact.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- collections

    def _versions(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.root}/{name}")

    def _known(self, name: str) -> tuple[Versions, list[dict], dict]:
        own = self._versions(name)
        pieces = own.pieces()
        if not pieces:
            raise CollectionError(f"there is no collection {name!r}")
        return own, pieces, next(x for x in pieces if x["kind"] == "settings")

    def create(self, name: str, size: int, payload: str = "", id_type: str = "bigint") -> bool:
        """A collection of vectors of `size` numbers, with payload columns (DDL). One that exists stays as it is, which
        the answer says."""
        own = self._versions(name)
        if own.exists():
            return False
        if size < 1:
            raise CollectionError("vectors have at least one number")
        own.commit(0, [{"piece": 0, "kind": "settings", "size": size, "payload": payload, "id_type": id_type}])
        return True

    def exists(self, name: str) -> bool:
        return self._versions(name).exists()

    def delete_collection(self, name: str) -> bool:
        """Whether there was one."""
        own = self._versions(name)
        there = own.exists()
        if there:
            own.drop()
        return there

    def info(self, name: str) -> dict:
        _, _, s = self._known(name)
        return {"name": name, "size": s["size"], "distance": "cosine", "count": self.rows(name).count()}

    # -- rows

    def _schema(self, s: dict) -> str:
        return f"id {s['id_type']}, embedding array<float>{', ' + s['payload'] if s['payload'] else ''}"

    def rows(self, name: str, clusters: Sequence[int] | None = None) -> DataFrame:
        """The rows in force, with their piece and cluster; those of some clusters only, if these are named."""
        own, pieces, s = self._known(name)
        schema = f"{self._schema(s)}, piece int, cluster int"
        live, gone = ([x["piece"] for x in pieces if x["kind"] == k] for k in ("rows", "dead"))
        if not live:
            return empty(self.spark, schema)
        rows = self.spark.read.schema(schema).parquet(f"{own.path}/vectors").where(F.col("piece").isin(live))
        if clusters is not None:
            rows = rows.where(F.col("cluster").isin([int(c) for c in clusters]))
        if gone:
            dead = self.spark.read.schema(f"id {s['id_type']}, piece int").parquet(f"{own.path}/dead").where(F.col("piece").isin(gone)).groupBy("id").agg(F.max("piece").alias("until"))
            rows = rows.join(dead.withColumnRenamed("id", "gone"), (F.col("id") == F.col("gone")) & (F.col("piece") < F.col("until")), "left_anti")
        return rows

    def upsert(self, name: str, rows: DataFrame, batch: int | str | None = None) -> bool:
        """rows (id, embedding and payload columns) added; those whose id is there already take its place.

        A row without id, a vector of another length, one with nulls, and an id that comes twice are errors, and then
        nothing changes. A batch number that the collection has seen changes nothing, which the answer says.
        """
        own, pieces, s = self._known(name)
        if batch is not None and any(x.get("batch") == batch for x in pieces):
            return False
        names = [f.name for f in self.spark.createDataFrame([], self._schema(s)).schema]
        if lacking := [c for c in names if c not in rows.columns]:
            raise CollectionError(f"columns are missing: {', '.join(lacking)}")
        new = self.spark.createDataFrame([], self._schema(s)).unionByName(rows.select(*names).withColumns({c: F.col(c).cast(t) for c, t in self.spark.createDataFrame([], self._schema(s)).dtypes}))
        e = F.col("embedding")
        bad = new.agg(
            F.count_if(F.col("id").isNull()).alias("ids"),
            F.count_if(F.coalesce(F.size(e), F.lit(-1)) != s["size"]).alias("sizes"),
            F.count_if(F.exists(e, lambda x: x.isNull() | F.isnan(x))).alias("numbers"),
        ).first()
        if bad.ids or bad.sizes or bad.numbers:
            raise CollectionError(f"{bad.ids} rows without id, {bad.sizes} vectors that haven't {s['size']} numbers, {bad.numbers} with nulls")
        if new.groupBy("id").count().where("count > 1").limit(1).count():
            raise CollectionError("an id comes twice")
        number, piece = own.number(), own.next_piece()
        known = self._centres(own, new)
        sent = self.spark.sparkContext.broadcast(known)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = sent.value
            for b in batches:
                if b.empty:
                    continue
                x, lengths = unit(np.stack(b["embedding"].to_numpy()).astype(float))
                near = (x @ known.T).argmax(axis=1)
                apart = np.linalg.norm(x - known[near], axis=1)
                yield b.assign(cluster=np.where(lengths > 0, near, NOWHERE).astype(np.int32), apart=apart)

        with batches_of(self.spark):
            placed = new.mapInPandas(place, f"{self._schema(s)}, cluster int, apart double")
            # a cluster of a large piece is written as a file for each CLUSTERS shuffle partitions
            files = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // CLUSTERS)
            dealt = placed.repartition("cluster", F.pmod(F.xxhash64("id"), F.lit(files))).sortWithinPartitions("cluster", "id")
            dealt.write.mode("overwrite").partitionBy("cluster").parquet(f"{own.path}/vectors/piece={piece}")
        edges = self.spark.read.schema("apart double, cluster int").parquet(f"{own.path}/vectors/piece={piece}").groupBy("cluster").agg(F.count("*").alias("n"), F.max("apart").alias("radius"))
        edges.coalesce(1).write.mode("overwrite").parquet(f"{own.path}/edges/piece={piece}")
        new.select("id").write.mode("overwrite").parquet(f"{own.path}/dead/piece={piece}")
        mine = [{"piece": piece, "kind": k, "batch": batch} for k in ("rows", "dead")]
        own.commit(number, pieces + mine)
        return True

    def remove(self, name: str, ids: DataFrame, batch: int | str | None = None) -> bool:
        """The rows of ids (id) taken out; unknown ones are no error."""
        own, pieces, s = self._known(name)
        if batch is not None and any(x.get("batch") == batch for x in pieces):
            return False
        number, piece = own.number(), own.next_piece()
        ids.select(F.col("id").cast(s["id_type"]).alias("id")).where("id is not null").distinct().write.mode("overwrite").parquet(f"{own.path}/dead/piece={piece}")
        own.commit(number, [*pieces, {"piece": piece, "kind": "dead", "batch": batch}])
        return True

    def remove_where(self, name: str, filters: dict) -> int:
        """The rows that filters (as in dense.condition) hold for taken out, and how many they were."""
        hit = self.rows(name).where(condition(filters)).select("id")
        n = hit.count()
        if n:
            self.remove(name, hit)
        return n

    def compact(self, name: str) -> None:
        """One piece of all rows in force. Batch numbers stay known."""
        own, pieces, s = self._known(name)
        seen = sorted({x["batch"] for x in pieces if x.get("batch") is not None}, key=str)
        self.upsert(name, self.rows(name).drop("piece", "cluster"))
        now = own.pieces()
        last = max(x["piece"] for x in now)
        own.commit(own.number(), [s, {"piece": last, "kind": "rows", "batch": None}, *({"piece": last, "kind": "batch", "batch": b} for b in seen)])

    def _centres(self, own: Versions, new: DataFrame) -> np.ndarray:
        """The collection's centres; the first rows that come in give them."""
        fs, p = own._files(f"{own.path}/centres/_SUCCESS")
        if not fs.exists(p):
            x = new.select("embedding").limit(LEARNED).toPandas()["embedding"]
            rows = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, 1))
            rows, lengths = unit(rows)
            rows = rows[lengths > 0]
            if not len(rows):
                return np.zeros((1, len(x.iloc[0]) if len(x) else 1))
            found = centres(rows, min(CLUSTERS, max(1, int(len(rows) ** 0.5))))
            self.spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(found)], "cluster int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{own.path}/centres")
        rows = self.spark.read.parquet(f"{own.path}/centres").orderBy("cluster").collect()
        return np.array([r.centre for r in rows])

    # -- queries

    def scroll(self, name: str, filters: dict | None = None, limit: int = 100, cursor=None) -> tuple[DataFrame, object | None]:
        """The next page of rows by id, after the row that the cursor names, and the cursor of the page after it; None
        on the last page. Files whose ids all lie before the cursor are left out by their statistics."""
        if not 1 <= limit <= PAGE:
            raise CollectionError(f"a page has 1 to {PAGE} rows")
        rows = self.rows(name).drop("piece", "cluster")
        if filters:
            rows = rows.where(condition(filters))
        if cursor is not None:
            rows = rows.where(F.col("id") > F.lit(cursor))
        page = rows.orderBy("id").limit(limit)
        ids = [r.id for r in rows.select("id").orderBy("id").limit(limit + 1).collect()]
        return page, ids[limit - 1] if len(ids) > limit else None

    def search(self, name: str, queries: DataFrame, k: int, threshold: float | None = None, filters: dict | None = None, queries_most: int = QUERIES, report: Callable[[dict], None] | None = None) -> DataFrame:
        """(qid, id, score, rank) as dense.search() has it over the rows in force.

        For each query the nearest clusters are searched first; its k-th score there says how near the edge of another
        must be, and what no query needs isn't read. Queries go through in parts of a bounded size; of several parts,
        each is written before the next begins. `report` gets the clusters read and all of them.
        """
        own, pieces, s = self._known(name)
        live = [x["piece"] for x in pieces if x["kind"] == "rows"]
        schema = f"qid {dict(queries.dtypes)['qid']}, id {s['id_type']}, score double"
        order = [F.desc("score"), F.asc("id")]
        wanted = queries.where("embedding is not null").select("qid", "embedding")
        n = wanted.count() // queries_most + 1
        if not live:
            return top_by(empty(self.spark, schema), k, ["qid"], order)
        edges = self.spark.read.schema("cluster int, n bigint, radius double, piece int").parquet(f"{own.path}/edges").where(F.col("piece").isin(live))
        edges = edges.groupBy("cluster").agg(F.max("radius").alias("radius")).orderBy("cluster").toPandas()  # at most CLUSTERS + 1
        known = self._centres(own, empty(self.spark, self._schema(s)))
        whole, folder = None, f"{own.path}/found-{uuid.uuid4().hex}"
        for i in range(n):
            rows = (wanted if n == 1 else wanted.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)).toPandas()
            if rows.empty:
                continue
            m, lengths = unit(np.stack(rows["embedding"].to_numpy()).astype(float))
            qids = rows["qid"].to_numpy()
            ids, bound = edges["cluster"].to_numpy(), np.ones((len(qids), len(edges)))
            for j, (c, r) in enumerate(zip(ids, edges["radius"], strict=True)):
                near = np.maximum(0, np.linalg.norm(m - known[c], axis=1) - r) if c != NOWHERE else np.full(len(qids), 2**0.5)
                bound[:, j] = np.where(lengths > 0, 1 - near**2 / 2, 0.0)
            first = np.argsort(-bound, axis=1)[:, :SEEDS]
            seeds = np.zeros(bound.shape, bool)
            np.put_along_axis(seeds, first, True, axis=1)
            lowest = np.full(len(qids), -np.inf if threshold is None else threshold)
            some = self._scored(name, qids, m, ids, seeds, k, lowest, filters, schema)
            least = top_by(some, k, ["qid"], order).where(F.col("rank") == k).select("qid", "score").toPandas()
            # what scores less than a query's k-th hit so far is no hit of it
            floor = np.maximum(lowest, pd.Series(least["score"].to_numpy(), index=least["qid"].to_numpy()).reindex(qids, fill_value=-np.inf).to_numpy())
            open_ = bound >= floor[:, None] - SLACK
            if report:
                report({"read": int(open_.any(axis=0).sum()), "all": len(ids), "pairs": int(open_.sum()), "all_pairs": open_.size})
            found = top_by(self._scored(name, qids, m, ids, open_, k, np.maximum(lowest, floor - SLACK), filters, schema), k, ["qid"], order)
            if n > 1:
                found.write.parquet(f"{folder}/{i}")
                found = self.spark.read.schema(found.schema).parquet(f"{folder}/{i}")
            whole = found if whole is None else whole.unionByName(found)
        return top_by(empty(self.spark, schema), k, ["qid"], order) if whole is None else whole

    def _scored(self, name: str, qids: np.ndarray, m: np.ndarray, ids: np.ndarray, open_: np.ndarray, k: int, floor: np.ndarray, filters: dict | None, schema: str) -> DataFrame:
        """(qid, id, score): of each task the k nearest that reach a query's floor, for the queries that a cluster is open
        to. With the floors of a first search, that is about k rows a query over all tasks."""
        rows = self.rows(name, ids[open_.any(axis=0)])
        if filters:
            rows = rows.where(condition(filters))
        sent = self.spark.sparkContext.broadcast((qids, m, floor, {int(c): np.flatnonzero(open_[:, j]) for j, c in enumerate(ids)}))

        def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, m, floor, open_ = sent.value
            best = Nearest(m, k, floor)
            for b in batches:
                cluster = b.column(2).to_numpy()
                for c in np.unique(cluster):
                    part = b.filter(pa.array(cluster == c))
                    if len(open_[int(c)]):
                        best.add(part.column(0), vectors(part.column(1)), open_[int(c)])
            yield from best.rows(pa.array(qids))

        return rows.select("id", "embedding", "cluster").mapInArrow(nearest, schema)
