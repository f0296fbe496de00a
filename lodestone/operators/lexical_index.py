"""A persisted inverted index: postings with positions by term, block bounds for exact skipping, additions and deletions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import analyzed
from .dense import top_by
from .lexical import PLACES, Asked, Kept, each_term, percent_of
from .store import Versions, batches_of, empty

#: Documents and terms of a block at most, and folders that terms are dealt out to unless an index says otherwise.
BLOCK, BLOCK_TERMS, SLOTS = 512, 1_000_000, 16
#: Queries and (query, term) pairs that are sent to the tasks at once.
QUERIES, PAIRS = 4096, 500_000
#: Blocks of the highest bounds that are scored first for each query, to know what the others must reach.
SEEDS = 4
#: Queries whose bounds in a block are one row.
WIDTH = 256


def invert(batches: Iterable[pa.RecordBatch], piece: int, kind: pa.DataType, base: int) -> Iterator[pa.RecordBatch]:
    """Posting rows of documents (id, terms): one per term and block, and one per block with its documents' ids, lengths
    and, as max_tf, the sum of these."""
    count = 0
    for whole in batches:
        sizes = pc.list_value_length(whole.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        at = 0
        while at < whole.num_rows:
            upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + BLOCK]), BLOCK_TERMS, side="right")))
            yield _block(whole.slice(at, upto - at), (piece << 44) | (base << 20) | count, kind)
            at, count = upto, count + 1


def pack(values: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
    """Numbers of 0 and more, `counts` of them a row, as bytes of seven bits each; the eighth says that more follow."""
    values = np.asarray(values, np.int64)
    size = 1 + sum((values >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(size.max()) if len(size) else 0):
        has = size > i
        out[(ends - size)[has] + i] = (values[has] >> 7 * i & 0x7F) | np.where(size[has] > i + 1, 0x80, 0)
    offsets = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpack(rows: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of pack(), and how many each row has; a null row has none."""
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cuts = np.frombuffer(rows.buffers()[1], np.int64 if pa.types.is_large_binary(rows.type) else np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    last = data < 0x80
    ends = np.flatnonzero(last)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    values = np.zeros(len(ends), np.int64)
    for i in range(int((ends - starts).max()) + 1 if len(ends) else 0):
        has = starts + i <= ends
        values[has] |= (data[(starts + i)[has]].astype(np.int64) & 0x7F) << 7 * i
    return values, np.diff(np.concatenate(([0], np.cumsum(last)))[cuts])


def postings(rows: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of documents, term counts, documents a row) of posting rows: each has its offsets, as gaps, and then its counts."""
    values, counts = unpack(rows)
    n = counts // 2
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(first, n) + within
    return _positions(values[at], n[n > 0]), values[at + np.repeat(n, n)], n


def _block(docs: pa.RecordBatch, number: int, kind: pa.DataType) -> pa.RecordBatch:
    sizes = pc.list_value_length(docs.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = docs.column(1).flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cell = code * len(sizes) + doc
    order = np.argsort(cell, kind="stable")  # positions of a document stay ascending
    cell, place = cell[order], place[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    tf = np.diff(np.append(first, len(cell)))
    gap = np.diff(place, prepend=0)
    gap[first] = place[first]
    term, off = cell[first] // len(sizes), cell[first] % len(sizes)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(starts[1:], len(term)).astype(np.int64) if len(starts) else starts
    n = ends - starts
    step = np.diff(off, prepend=0)
    step[starts] = off[starts]
    at = np.arange(len(off)) - np.repeat(starts, n) + np.repeat(2 * starts, n)
    stream = np.zeros(2 * len(off), np.int64)
    stream[at], stream[at + np.repeat(n, n)] = step, tf
    some = len(n) > 0
    texts = words.dictionary.cast(pa.string()).take(pa.array(term[starts])) if some else pa.array([], pa.string())
    own = docs.column(0).cast(kind)
    columns = {
        "term": pa.concat_arrays([pa.nulls(1, pa.string()), texts]),
        "block": pa.array(np.full(len(n) + 1, number), pa.int64()),
        "n": pa.array(np.append(len(sizes), n), pa.int32()),
        "max_tf": pa.array(np.append(sizes.sum(), np.maximum.reduceat(tf, starts) if some else n), pa.int32()),
        "min_dl": pa.array(np.append(0, np.minimum.reduceat(sizes[off], starts) if some else n), pa.int32()),
        "docs": pack(np.concatenate((sizes, stream)), np.append(len(sizes), 2 * n)),
        "places": pack(gap, np.append(0, np.add.reduceat(tf, starts) if some else n)),
        "ids": pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), own), *([pa.nulls(len(n), pa.list_(kind))] if some else [])]),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, t), put together so that each batch is one whole block; t of the block's own row is -1."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        block = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(block)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
            if held and held[0].column(0)[0].as_py() != block[lo]:
                yield _joined(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class LexicalIndex:
    """An inverted index in a shared folder.

    Documents (id, text) are cut into terms once, when they are added. A task turns its documents into blocks of at
    most 512 neighbours; a posting row holds a term's documents in a block (gaps of their offsets in it), their term counts
    and positions (as gaps), packed into few bytes, the highest count and the shortest length. Rows lie in folders by a hash of their term, so
    that a query reads only the folders and columns of its terms, never a text. A very common term has a row per block,
    which are spread over as many files as its folder needs.

    Null texts are documents without terms; ids may repeat and are documents of their own; null ids can be found but
    not deleted. `analyzer`, the name of one in functions.text, is kept with the index and used for its queries too.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)
        self.path = self.versions.path
        self.counted: dict[int, tuple[int, float]] = {}  # a version never changes

    # -- what is stored

    @classmethod
    def create(cls, spark: SparkSession, path: str, id_type: str = "bigint", analyzer: str = "plain", slots: int = SLOTS) -> LexicalIndex:
        """A new, empty index; one that is there already stays as it is. The more `slots`, the less of a large index a
        query of few terms reads, and the more files a small change makes."""
        own = cls(spark, path)
        if not own.versions.exists():
            own.versions.commit(0, [{"piece": 0, "kind": "settings", "id_type": id_type, "analyzer": analyzer, "slots": slots}])
        return own

    @classmethod
    def built(cls, docs: DataFrame, path: str, analyzer: str = "plain", slots: int = SLOTS) -> LexicalIndex:
        own = cls.create(docs.sparkSession, path, docs.schema["id"].dataType.simpleString(), analyzer, slots)
        own.change(add=docs)
        return own

    def settings(self) -> dict:
        return next(x for x in self.versions.pieces() if x["kind"] == "settings")

    def _schema(self) -> str:
        kind = self.settings()["id_type"]
        return f"term string, block long, n int, max_tf int, min_dl int, docs binary, places binary, ids array<{kind}>"

    def _arrow(self) -> pa.DataType:
        kind = self.settings()["id_type"]
        return pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def terms(self, text: str = "text") -> Column:
        return F.coalesce(analyzed(text, self.settings()["analyzer"]), F.array().cast("array<string>"))

    def _table(self) -> DataFrame:
        live = [x["piece"] for x in self.versions.pieces() if x["kind"] == "rows"]
        if not live:
            return empty(self.spark, f"{self._schema()}, piece int, slot int")
        rows = self.spark.read.schema(f"{self._schema()}, piece int, slot int").parquet(f"{self.path}/postings")
        return rows.where(F.col("piece").isin(live))

    def _dead(self) -> DataFrame | None:
        """(block, dead): offsets of deleted documents."""
        gone = [x["piece"] for x in self.versions.pieces() if x["kind"] == "dead"]
        if not gone:
            return None
        rows = self.spark.read.schema("block long, off int, piece int").parquet(f"{self.path}/dead").where(F.col("piece").isin(gone))
        return rows.groupBy("block").agg(F.collect_set(F.col("off").cast("smallint")).alias("dead"))

    def documents(self) -> DataFrame:
        """(block, off, id, dl) of the documents in force."""
        kind = self.settings()["id_type"]

        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lengths, n = unpack(b.column(2))
                off = np.arange(len(lengths)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(off, pa.int32()), b.column(1).flatten(), pa.array(lengths, pa.int32())], names=["block", "off", "id", "dl"])

        rows = self._table().where("slot = -1").select("block", "ids", "docs").mapInArrow(each, f"block long, off int, id {kind}, dl int")
        dead = self._dead()
        return rows if dead is None else rows.join(dead, "block", "left").where(F.coalesce(~F.array_contains("dead", F.col("off").cast("smallint")), F.lit(True))).drop("dead")

    def statistics(self) -> tuple[int, float]:
        """Documents and their mean length; without deletions, from one row a block. Counted once for a version."""
        if (number := self.versions.number()) in self.counted:
            return self.counted[number]
        if self._dead() is not None:
            n, total = self.documents().agg(F.count("*"), F.sum("dl")).first()
        else:
            n, total = self._table().where("slot = -1").agg(F.sum("n"), F.sum("max_tf")).first()
        self.counted[number] = n or 0, (total or 0) / n if n else 0.0
        return self.counted[number]

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df) of all terms or of those in `terms` (term): from the counts of the posting rows."""
        rows, dead = self._of(terms), self._dead()
        if dead is None:
            return rows.groupBy("term").agg(F.sum("n").alias("df"))

        def left(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                off, _, n = postings(b.column(1))
                gone = [np.isin(x, d) for x, d in zip(np.split(off, np.cumsum(n)[:-1]), b.column(2).to_pylist(), strict=True)] if b.num_rows else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(len(g) - g.sum()) for g in gone], pa.int32())], names=["term", "n"])

        # only rows of blocks with deleted documents are looked into
        whole = rows.join(dead, "block", "left_anti").select("term", "n")
        some = rows.join(dead, "block").select("term", "docs", "dead").mapInArrow(left, "term string, n int")
        return whole.unionByName(some).groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def _of(self, terms: DataFrame | None) -> DataFrame:
        """Posting rows of terms, from their folders only; which folders is known from as many numbers as there are."""
        rows = self._table().where("slot >= 0")
        return rows if terms is None else self._folders(rows, terms).join(terms.select("term").distinct(), "term", "left_semi")

    def _folders(self, rows: DataFrame, terms: DataFrame) -> DataFrame:
        slot = F.pmod(F.xxhash64("term"), F.lit(self.settings()["slots"])).alias("slot")
        return rows.where(F.col("slot").isin([r.slot for r in terms.select(slot).distinct().collect()]))

    def scan(self) -> DataFrame:
        """(id, terms): the whole index read back, each document's terms in order. Posting rows meet by block as they are
        stored, so what is shuffled and held is the index and not a row for each place of a term."""
        kind, arrow = self.settings()["id_type"], self._arrow()

        def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _by_block(batches):
                yield _texts(b, arrow)

        rows = self._whole(self._table().select("block", "term", "docs", "places", F.to_json("ids").alias("ids")), F.col("term").isNull())
        return rows.sortWithinPartitions("block", "term").mapInArrow(whole, f"id {kind}, terms array<string>")

    # -- changes

    def change(self, add: DataFrame | None = None, remove: DataFrame | None = None, batch: int | str | None = None) -> bool:
        """One new version without the documents whose id is in `remove` (id) and with those of `add` (id, text).

        A batch number that the index has seen changes nothing, so a retried batch is harmless; the answer is whether
        anything was done. Removed documents stay on disk until compact(), but in no result and no statistic.
        """
        number, pieces = self.versions.number(), self.versions.pieces()
        if batch is not None and any(x.get("batch") == batch for x in pieces):
            return False
        piece, new = self.versions.next_piece(), []
        if remove is not None:
            gone = self.documents().join(remove.select("id").distinct(), "id", "left_semi").select("block", F.col("off").cast("int").alias("off"))
            gone.write.mode("overwrite").parquet(f"{self.path}/dead/piece={piece}")
            new.append({"piece": piece, "kind": "dead", "batch": batch})
        if add is not None:
            self._write(add.select("id", self.terms().alias("terms")), piece)
            new.append({"piece": piece, "kind": "rows", "batch": batch})
        self.versions.commit(number, pieces + new)
        return True

    def _write(self, docs: DataFrame, piece: int) -> None:
        """The posting rows of docs (id, terms). Together, the folders are written as about as many files as there are
        shuffle partitions, so that their number, which a cluster sets by the size of its data, bounds the largest file."""
        kind, slots, arrow = self.settings()["id_type"], self.settings()["slots"], self._arrow()
        own = docs.select(F.col("id").cast(kind).alias("id"), "terms")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return invert(batches, piece, arrow, TaskContext.get().partitionId())

        files = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // slots)
        slot = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(slots))).cast("int")  # -1: the blocks' own rows
        rows = own.mapInArrow(run, self._schema()).withColumn("slot", slot)
        rows = rows.withColumn("file", F.when(F.col("slot") >= 0, F.pmod(F.shiftright("block", 20) + F.shiftright("block", 6), F.lit(files))).otherwise(F.pmod("block", F.lit(slots * files))))
        with batches_of(self.spark):
            rows.repartition("slot", "file").sortWithinPartitions("slot", "term", "block").drop("file").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/postings/piece={piece}")

    def compact(self) -> None:
        """One piece of all documents in force, without deleted ones. Batch numbers stay known. Superseded pieces stay
        on disk for readers of earlier versions."""
        number, pieces = self.versions.number(), self.versions.pieces()
        whole, piece = self.scan(), self.versions.next_piece()
        self._write(whole, piece)
        seen = [{"piece": piece, "kind": "batch", "batch": b} for b in sorted({x["batch"] for x in pieces if x.get("batch") is not None}, key=str)]
        self.versions.commit(number, [x for x in pieces if x["kind"] == "settings"] + [{"piece": piece, "kind": "rows", "batch": None}, *seen])

    # -- queries

    def _parts(self, queries: DataFrame, percent: int, queries_most: int, pairs_most: int) -> Iterator[tuple[Asked, str | None]]:
        """The queries in parts of a bounded size, and a folder for each one's result if there are several; texts are cut
        once, what all terms weigh is counted once, and both are written."""
        folder = f"{self.path}/asked-{uuid.uuid4().hex}"
        # texts that ask may all lie in one file
        wanted = each_term(queries.select("qid", "text").repartition(self.spark.sparkContext.defaultParallelism), self.terms())
        wanted.write.parquet(f"{folder}/wanted")
        wanted = self.spark.read.schema(wanted.schema).parquet(f"{folder}/wanted")
        n = self.statistics()[0]
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
        sizes = wanted.agg(F.count("*").alias("pairs"), F.count_distinct("qid").alias("queries")).first()
        count = max(sizes.pairs // pairs_most, sizes.queries // queries_most) + 1
        part = F.pmod(F.xxhash64("qid"), F.lit(count)).alias("part")
        table = wanted.join(self.frequencies(wanted), "term").select("qid", "term", "n_terms", idf, part)
        if count > 1:
            table.write.partitionBy("part").parquet(f"{folder}/terms")
            table = self.spark.read.parquet(f"{folder}/terms")
        for i in range(count):
            rows = table.where(F.col("part") == i).toPandas() if count > 1 else table.toPandas()
            if len(rows):
                yield Asked(rows, percent), f"{folder}/found-{i}" if count > 1 else None

    def _together(self, parts: Iterable[tuple[DataFrame, str | None]], schema: str) -> DataFrame:
        """The results of all parts; of several, each is written before the next begins, so that the driver and the
        tasks hold one part at a time."""
        whole = None
        for rows, folder in parts:
            if folder:
                rows.write.parquet(folder)
                rows = self.spark.read.schema(rows.schema).parquet(folder)
            whole = rows if whole is None else whole.unionByName(rows)
        return empty(self.spark, schema) if whole is None else whole

    def _rows(self, asked: Asked, columns: Sequence[str], blocks: DataFrame | None = None) -> DataFrame:
        """Posting rows of a part's terms (`t` is the term's number) and the rows of their blocks (t = -1), each block
        whole in one task and in order. `blocks` (block) names the only ones to be read."""
        numbers = self.spark.createDataFrame(pa.table({"term": pa.array(asked.words, pa.string()), "t": pa.array(range(len(asked.words)), pa.int32())}))
        own = self._folders(self._table().where("slot >= 0"), numbers).join(F.broadcast(numbers), "term").select("block", "t", *columns)
        docs = self._table().where("slot = -1").select("block", F.lit(-1).alias("t"), *columns)
        rows = own.unionByName(docs)
        if blocks is not None:
            rows = rows.join(blocks, "block", "left_semi")
        if "ids" in columns:
            rows = rows.withColumn("ids", F.to_json("ids"))
        return self._whole(rows, F.col("t") == -1, "ids" in columns).sortWithinPartitions("block", "t")

    def _whole(self, rows: DataFrame, first: Column, deleted: bool = True) -> DataFrame:
        """rows with each block whole in one task, and `dead`, the offsets of a block's deleted documents, in the row of
        the block itself (`first`). Lists go to Python as JSON: a column of lists, most of them null, costs Spark time for
        each row by the number of rows before it in the batch."""
        if deleted:
            dead = self._dead()
            none = F.lit(None).cast("string").alias("dead")
            if dead is None:
                rows = rows.select("*", none)
            else:
                # the others needn't be joined
                rows = rows.where(first).join(dead.select("block", F.to_json("dead").alias("dead")), "block", "left").unionByName(rows.where(~first).select("*", none))
        # by a hash of the block: a repartition by a join's own key would be left to the join, which may become a broadcast
        return rows.repartition(F.xxhash64("block"))

    def search(self, queries: DataFrame, k: int, mode: str = "any", share: int | None = None, skip: bool = False, queries_most: int = QUERIES, pairs_most: int = PAIRS, report: Callable[[dict], None] | None = None) -> DataFrame:
        """(qid, id, score, matched, rank): the k best documents for each of queries (qid, text), as lexical.bm25 has it.

        Queries go through in parts of a bounded size, each done and written before the next if there are several. A
        task holds one block at a time, with k rows a query. A block's bound for a query is the sum of its terms' idf
        at the block's highest count and shortest length; a query whose k-th best score is above it needn't be scored
        there, which loses nothing. With `skip`, the blocks of the highest bounds are scored first, and of the others
        only those are read that some query may still need: one pass over the bounds alone, which pays for few queries
        over many blocks. `report` gets the number of blocks read and of all.
        """
        percent, avgdl = percent_of(mode, share), self.statistics()[1]
        kinds = {"qid": queries.schema["qid"].dataType.simpleString(), "id": self.settings()["id_type"]}
        order = [F.desc(F.round("score", PLACES)), F.asc("id")]

        def found() -> Iterator[tuple[DataFrame, str | None]]:
            for asked, folder in self._parts(queries, percent, queries_most, pairs_most):
                floor = blocks = None
                if skip:
                    bounds = self._bounds(asked, avgdl)
                    seeds = self._seeds(bounds, asked, kinds["qid"])
                    first = self._scored(asked, k, avgdl, kinds, seeds.select("block").distinct(), None)
                    least = top_by(first, k, ["qid"], [F.desc("score")]).where(F.col("rank") == k).select("qid", "score").toPandas()
                    floor = np.zeros(len(asked.qids))
                    floor[np.searchsorted(asked.qids, least["qid"].to_numpy())] = least["score"].to_numpy()
                    blocks = self._needed(bounds, floor)
                    if report:
                        report({"read": blocks.count(), "all": self._table().where("slot = -1").count()})
                yield top_by(self._scored(asked, k, avgdl, kinds, blocks, floor), k, ["qid"], order), folder

        return self._together(found(), f"qid {kinds['qid']}, id {kinds['id']}, score double, matched long, rank int")

    def _bounds(self, asked: Asked, avgdl: float) -> DataFrame:
        """(block, at, bounds): each block's bounds for the queries from number `at` on, WIDTH of them as bytes, written
        once: both what is scored first and what else is needed are told by it."""
        sent, path = self.spark.sparkContext.broadcast((asked, avgdl)), f"{self.path}/bounds-{uuid.uuid4().hex}"
        schema = "block long, at int, bounds binary"

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, avgdl = sent.value
            for b in _by_block(batches):
                bound = _bound(b, asked, avgdl)
                if bound is not None:
                    ats = [at for at in range(0, len(bound), WIDTH) if bound[at : at + WIDTH].any()]
                    parts = [bound[at : at + WIDTH].tobytes() for at in ats]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1).take(pa.array([0] * len(ats), pa.int32())), pa.array(ats, pa.int32()), pa.array(parts, pa.binary())], names=["block", "at", "bounds"])

        self._rows(asked, ["n", "max_tf", "min_dl"]).mapInArrow(run, schema).write.parquet(path)
        sent.unpersist()
        return self.spark.read.schema(schema).parquet(path)

    def _seeds(self, bounds: DataFrame, asked: Asked, qid_kind: str) -> DataFrame:
        """(qid, block, bound): of each task's blocks the SEEDS of the highest bounds for each query."""
        sent = self.spark.sparkContext.broadcast(asked.qids)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids = sent.value
            best, blocks = np.zeros((len(qids), SEEDS)), np.zeros((len(qids), SEEDS), np.int64)
            for b in batches:
                for block, at, bound in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    bound = np.frombuffer(bound)
                    own = np.arange(at, at + len(bound))
                    least = best[own].argmin(axis=1)
                    better = bound > best[own, least]
                    best[own[better], least[better]], blocks[own[better], least[better]] = bound[better], block
            row, col = np.nonzero(best > 0)
            yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(blocks[row, col], pa.int64()), pa.array(best[row, col])], names=["qid", "block", "bound"])

        found = bounds.mapInArrow(run, f"qid {qid_kind}, block long, bound double")
        return top_by(found, SEEDS, ["qid"], [F.desc("bound"), F.asc("block")])

    def _needed(self, bounds: DataFrame, floor: np.ndarray) -> DataFrame:
        """(block): those that may hold one of the k best for some query."""
        sent = self.spark.sparkContext.broadcast(floor)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floor, some = sent.value, set()
            for b in batches:
                for block, at, bound in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    bound = np.frombuffer(bound)
                    if ((bound > 0) & (bound >= floor[at : at + len(bound)] - 10.0**-PLACES)).any():
                        some.add(block)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(some), pa.int64())], names=["block"])

        return bounds.mapInArrow(run, "block long").distinct()

    def _scored(self, asked: Asked, k: int, avgdl: float, kinds: dict, blocks: DataFrame | None, floor: np.ndarray | None) -> DataFrame:
        """(qid, id, score, matched): each task's k best documents for each query."""
        sent, arrow = self.spark.sparkContext.broadcast((asked, avgdl, floor)), self._arrow()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, avgdl, floor = sent.value
            best = Kept(len(asked.qids), k, floor)
            for b in _by_block(batches):
                got = _scores(b, asked, avgdl, best.least, arrow)
                if got is not None:
                    best.add(*got)
            yield from best.rows(asked.qids)

        rows = self._rows(asked, ["n", "max_tf", "min_dl", "docs", "ids"], blocks)
        return rows.mapInArrow(run, f"qid {kinds['qid']}, id {kinds['id']}, score double, matched long")

    def phrase(self, queries: DataFrame, queries_most: int = QUERIES, pairs_most: int = PAIRS) -> DataFrame:
        """(qid, id, n): how often the terms of a query stand in a document one after another, from positions alone.

        Queries without terms, or with one that no document has, match nothing. Per block, a query's terms are met from
        the rarest on and dropped as soon as nothing is left.
        """
        kinds = {"qid": queries.schema["qid"].dataType.simpleString(), "id": self.settings()["id_type"]}
        own = queries.select("qid", self.terms().alias("wanted")).where(F.size("wanted") > 0)
        schema, arrow = f"qid {kinds['qid']}, id {kinds['id']}, n long", self._arrow()

        def found() -> Iterator[tuple[DataFrame, str | None]]:
            for asked, folder in self._parts(queries, 100, queries_most, pairs_most):
                part = own.join(F.broadcast(self.spark.createDataFrame(pa.table({"qid": pa.array(asked.qids)}))), "qid", "left_semi").toPandas()
                at = {w: i for i, w in enumerate(asked.words)}
                numbers = [(q, [at.get(w, -1) for w in ws]) for q, ws in zip(part["qid"], part["wanted"], strict=True)]
                sent = self.spark.sparkContext.broadcast([(q, np.array(ts)) for q, ts in numbers if min(ts) >= 0])

                def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                    for b in _by_block(batches):
                        got = _phrases(b, sent.value, arrow)
                        if got is not None:
                            yield got

                yield self._rows(asked, ["n", "docs", "places", "ids"]).mapInArrow(run, schema), folder

        return self._together(found(), schema)


def _positions(gaps: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """Ascending numbers from gaps; `tf` says how many follow one another each time, at least one."""
    sums = np.cumsum(gaps, dtype=np.int64)
    first = np.cumsum(tf) - tf
    return sums - np.repeat(sums[first] - gaps[first], tf) if len(tf) else sums


def _listed(column: pa.StringArray, kind: pa.DataType) -> pa.Array:
    """The list that a block's first row has as JSON; null is an empty one."""
    return pa.array(json.loads(column[0].as_py() or "[]"), kind)


def _texts(b: pa.RecordBatch, arrow: pa.DataType) -> pa.RecordBatch:
    """(id, terms) of a block's documents, without deleted ones."""
    cols = dict(zip(b.schema.names, b.columns, strict=True))
    dl = unpack(cols["docs"].slice(0, 1))[0]
    off, tf, n = postings(cols["docs"].slice(1))
    at = np.repeat((np.cumsum(dl) - dl)[off], tf) + _positions(unpack(cols["places"].slice(1))[0], tf)
    term = np.empty(len(at), np.int64)
    term[at] = np.repeat(np.repeat(np.arange(1, b.num_rows), n), tf)
    ends = pa.array(np.concatenate(([0], np.cumsum(dl))), pa.int32())
    terms = pa.ListArray.from_arrays(ends, cols["term"].take(pa.array(term)))
    left = pa.array(np.setdiff1d(np.arange(len(dl)), _listed(cols["dead"], pa.int64()).to_numpy()))
    return pa.RecordBatch.from_arrays([_listed(cols["ids"], arrow).take(left), terms.take(left)], names=["id", "terms"])


def _bound(b: pa.RecordBatch, asked: Asked, avgdl: float) -> np.ndarray | None:
    """Per query, the most that a document of the block can score; 0 where the block has too few of its terms."""
    t, names = b.column(1).to_numpy(), b.schema.names
    if len(t) < 2:
        return None
    part = asked.part(t[1:], b.column(names.index("max_tf")).to_numpy()[1:], b.column(names.index("min_dl")).to_numpy()[1:], avgdl)
    bound, met = np.zeros(len(asked.qids)), np.zeros(len(asked.qids), np.int64)
    for place, who in asked.cells(t[1:]):
        bound += np.bincount(who, part[place], len(bound))
        met += np.bincount(who, minlength=len(met))
    bound[met < asked.need] = 0
    return bound


def _scores(b: pa.RecordBatch, asked: Asked, avgdl: float, least: np.ndarray, arrow: pa.DataType):
    """(ids, scores, matched, queries) of a block's documents by each query that can gain by it, or None if none can."""
    bound = _bound(b, asked, avgdl)
    if bound is None:
        return None
    who = np.flatnonzero((bound > 0) & (bound >= least - 10.0**-PLACES))
    if not len(who):
        return None
    cols = dict(zip(b.schema.names, b.columns, strict=True))
    ids, dl = _listed(cols["ids"], arrow), unpack(cols["docs"].slice(0, 1))[0]
    offs, tfs, sizes = postings(cols["docs"].slice(1))
    t = np.repeat(cols["t"].to_numpy()[1:], sizes)
    scores, matched = asked.scores(t, offs, asked.part(t, tfs, dl[offs], avgdl), len(dl), who)
    scores[:, _listed(cols["dead"], pa.int64()).to_numpy()] = 0
    return ids, scores, matched, who


def _phrases(b: pa.RecordBatch, queries: list, arrow: pa.DataType) -> pa.RecordBatch | None:
    cols = dict(zip(b.schema.names, b.columns, strict=True))
    t = cols["t"].to_numpy()
    row = {int(j): i for i, j in enumerate(t)}
    n = cols["n"].to_numpy()
    dead, made = set(_listed(cols["dead"], pa.int64()).to_pylist()), {}

    def starts(j: int) -> np.ndarray:
        """offset * 2**32 + position of a term in the block's documents."""
        if j not in made:
            i = row[j]
            off, tf, _ = postings(cols["docs"].slice(i, 1))
            made[j] = (np.repeat(off, tf) << 32) + _positions(unpack(cols["places"].slice(i, 1))[0], tf)
        return made[j]

    out = []
    for q, ts in queries:
        if not all(int(j) in row for j in ts):
            continue
        order = sorted(range(len(ts)), key=lambda i: n[row[int(ts[i])]])
        left = starts(int(ts[order[0]])) - order[0]
        for i in order[1:]:
            if not len(left):
                break
            left = left[np.isin(left, starts(int(ts[i])) - i, assume_unique=True)]
        for off, count in zip(*np.unique(left >> 32, return_counts=True), strict=True):
            if int(off) not in dead:
                out.append((q, int(off), int(count)))
    if not out:
        return None
    ids = _listed(cols["ids"], arrow)
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), ids.take(pa.array([x[1] for x in out])), pa.array([x[2] for x in out], pa.int64())], names=["qid", "id", "n"])
