"""BM25 retrieval for many queries in one job: any, all, a share of the terms, and phrases."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import analyzed
from .dense import ranks, top_by
from .store import batches_of, dropped, empty, fresh_folder

K1, B = 1.2, 0.75
#: Queries and (query, term) pairs that are sent to the tasks at once, scores that a task holds at once, and what it adds
#: to scores at once.
BLOCK, PAIRS, TILE, CELLS = 4096, 500_000, 1_000_000, 65_536
#: Documents and terms of a stored block at most, and blocks that are read at once.
DOCS, DOC_TERMS, READ = 512, 1_000_000, 8
#: Scores are told apart to this many places.
PLACES = 9
#: Terms that at least this share of all pairs of a query and a document have in common are multiplied as a matrix.
OFTEN = 0.005


def impact(tf, dl, avgdl: float):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


class Asked:
    """One part of the queries as the tasks get it: terms by number, who asks for each, and its idf.

    What a term adds to a score is rounded to a multiple of `step`, a power of two so small that a whole score has no more
    than 52 bits. Sums are then exact in whatever order they are made, and equal documents have equal scores.
    """

    def __init__(self, rows, percent: int):
        self.qids, q = np.unique(rows["qid"].to_numpy(), return_inverse=True)
        self.words, t = np.unique(rows["term"].to_numpy().astype(object), return_inverse=True)
        order = np.argsort(t, kind="stable")
        self.askers, self.bounds = q[order], np.searchsorted(t[order], np.arange(len(self.words) + 1))
        self.idf, self.need = np.zeros(len(self.words)), np.ones(len(self.qids), np.int64)
        self.idf[t] = rows["idf"].to_numpy()
        self.need[q] = np.maximum(1, rows["n_terms"].to_numpy() * percent // 100)
        self.step = 2.0 ** (np.ceil(np.log2(np.bincount(q, rows["idf"].to_numpy() * (K1 + 1)).max())) - 52)
        # the share of all documents that have a term is about exp(-idf)
        share = np.diff(self.bounds) / len(self.qids) * np.exp(-self.idf)
        often = np.argsort(-share, kind="stable")[: max(1, 4 * TILE // len(self.qids))]
        self.often = often[share[often] >= OFTEN]
        self.column = np.full(len(self.words), -1)
        self.column[self.often] = np.arange(len(self.often))
        self.asks: np.ndarray | None = None

    def cells(self, terms: np.ndarray, most: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, query): each place in `terms` with each query that asks for the term there, about a million at a time."""
        counts = self.bounds[terms + 1] - self.bounds[terms]
        ends = np.cumsum(counts)
        at = 0
        while at < len(terms):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            n = counts[at:upto]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(np.arange(at, upto), n), self.askers[np.repeat(self.bounds[terms[at:upto]], n) + within]
            at = upto

    def part(self, terms: np.ndarray, tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
        """What terms add to a document's score."""
        return np.maximum(np.rint(self.idf[terms] * impact(tf, dl, avgdl) / self.step), 1) * self.step

    def scores(self, terms: np.ndarray, docs: np.ndarray, parts: np.ndarray, width: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray | Matched]:
        """(scores, matched) of the queries `who` by `width` documents, of which `docs` have `terms`, each once; a score is
        0 where too few terms of the query are met. Common terms are multiplied, the others are added one by one, some
        documents at a time, so that what is added lies close together."""
        scores, matched, n = np.zeros((width, len(who))), np.zeros((width, len(who)), np.int32), len(who)
        column = self.column[terms]
        common, rest = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        has = asks = np.zeros((0, 0))
        if len(common):
            if self.asks is None:
                self.asks = np.zeros((len(self.qids), len(self.often)))
                for i, t in enumerate(self.often):
                    self.asks[self.askers[self.bounds[t] : self.bounds[t + 1]], i] = 1
            met, place = np.unique(column[common], return_inverse=True)
            has, adds = np.zeros((width, len(met)), np.float32), np.zeros((width, len(met)))
            has[docs[common], place], adds[docs[common], place] = 1, parts[common]
            asks = self.asks if len(met) == len(self.often) and n == len(self.qids) else self.asks[np.ix_(who, met)]
            np.matmul(adds, asks.T, out=scores)
        rest = rest[np.argsort(docs[rest], kind="stable")]
        t, doc, part = terms[rest], docs[rest], parts[rest]
        counts = self.bounds[t + 1] - self.bounds[t]
        ends = np.cumsum(np.bincount(doc, counts, width)).astype(np.int64)
        row = None
        if n < len(self.qids):
            row = np.full(len(self.qids), -1)
            row[who] = np.arange(n)
        at = 0
        while at < width:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
            lo, hi = np.searchsorted(doc, (at, upto))
            k = counts[lo:hi]
            within = np.repeat(self.bounds[t[lo:hi]] - np.cumsum(k) + k, k)
            within += np.arange(len(within))
            cell, adds = np.repeat((doc[lo:hi] - at) * n, k), np.repeat(part[lo:hi], k)
            q = self.askers[within]
            if row is not None:
                q = row[q]
                open_ = q >= 0
                q, cell, adds = q[open_], cell[open_], adds[open_]
            cell += q
            scores[at:upto] += np.bincount(cell, adds, (upto - at) * n).reshape(-1, n)
            matched[at:upto] = np.bincount(cell, minlength=(upto - at) * n).reshape(-1, n)
            at = upto
        if (self.need[who] == 1).all():  # what has a score is a hit
            return scores.T, Matched(matched, has, asks)
        if len(common):
            matched += (has @ asks.T.astype(np.float32)).astype(np.int32)
        scores[matched < self.need[who]] = 0
        return scores.T, matched.T


class Matched:
    """How many terms a query and a document have in common, counted only for the pairs that are asked for: `rest` by
    document and query, and the common terms that a document has and that a query asks for."""

    def __init__(self, rest: np.ndarray, has: np.ndarray, asks: np.ndarray):
        self.rest, self.has, self.asks = rest, has, asks

    def __getitem__(self, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        query, doc = at
        out = self.rest[doc, query].astype(np.int64)
        step = max(1, TILE // max(1, self.has.shape[1]))
        for i in range(0, len(out) if self.has.size else 0, step):
            out[i : i + step] += (self.has[doc[i : i + step]] * self.asks[query[i : i + step]]).sum(axis=1).astype(np.int64)
        return out


class Kept:
    """The k best documents of each of n queries, by score to PLACES and then by id, out of all that are added; what is
    held doesn't grow with the documents. `least` is the score that a query's next document must reach, `floor` at first."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.least = k, np.zeros(n) if floor is None else floor.copy()
        self.q = self.score = self.fits = self.ids = self.kind = None
        self.new: list[list[np.ndarray]] = []  # what came since they were last put in order
        self.most = max(1, n * k // 2)

    def add(self, ids: pa.Array, scores: np.ndarray, matched: np.ndarray | Matched, who: np.ndarray) -> None:
        """scores and matched of the queries `who` (a row each) by documents; 0 is no hit."""
        slack, by_doc = 2 * 10.0**-PLACES, scores.T
        may = by_doc >= np.maximum(self.least[who] - slack, np.nextafter(0, 1))
        many = np.flatnonzero(np.count_nonzero(may, axis=0) > self.k)
        if len(many):
            kth = np.partition(scores[many], -self.k, axis=1)[:, -self.k]
            may[:, many] &= by_doc[:, many] >= kth - slack
        col, row = np.nonzero(may)
        if not len(row):
            return
        self.kind = ids.type
        # numbers with nulls would become floats
        own = np.array(ids.to_pylist(), dtype=object) if ids.null_count else ids.to_numpy(zero_copy_only=False)
        self.new.append([who[row], scores[row, col], matched[row, col].astype(np.int64), own[col]])
        if sum(len(x[0]) for x in self.new) >= self.most:
            self._merge()

    def _merge(self) -> None:
        if not self.new:
            return
        held = [] if self.q is None else [[self.q, self.score, self.fits, self.ids]]
        q, score, fits, ids = (np.concatenate(x) for x in zip(*held, *self.new, strict=True))
        self.new = []
        order = np.lexsort((ranks(ids), -np.round(score, PLACES), q))
        order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < self.k]
        self.q, self.score, self.fits, self.ids = q[order], score[order], fits[order], ids[order]
        full = np.flatnonzero(np.arange(len(order)) - np.searchsorted(self.q, self.q) == self.k - 1)
        self.least[self.q[full]] = np.maximum(self.least[self.q[full]], self.score[full])

    def rows(self, qids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(qid, id, score, matched) of what was kept."""
        self._merge()
        if self.q is not None:
            yield pa.RecordBatch.from_arrays([pa.array(qids[self.q]), pa.array(self.ids, self.kind), pa.array(self.score), pa.array(self.fits)], names=["qid", "id", "score", "matched"])


def kept(stop: Sequence[str], analyzer: str = "plain") -> Column:
    """The terms that the analyzer makes of `text`, without stop words."""
    own = analyzed("text", analyzer)
    return F.filter(own, lambda x: ~x.isin(list(stop))) if stop else own


def corpus_terms(docs: DataFrame, stop: Sequence[str] = (), analyzer: str = "plain") -> DataFrame:
    """(id, terms, dl) of docs (id, text); null texts have no terms."""
    return docs.select("id", corpus_kept(stop, analyzer).alias("terms")).withColumn("dl", F.size("terms"))


def corpus_kept(stop: Sequence[str] = (), analyzer: str = "plain") -> Column:
    """kept(), where null texts have no terms."""
    return F.coalesce(kept(stop, analyzer), F.array().cast("array<string>"))


def query_terms(queries: DataFrame, stop: Sequence[str] = (), analyzer: str = "plain") -> DataFrame:
    """(qid, term, n_terms): the distinct terms of queries (qid, text)."""
    return each_term(queries, kept(stop, analyzer))


def each_term(queries: DataFrame, terms: Column) -> DataFrame:
    """(qid, term, n_terms) of queries, by their `terms`. These are cut and counted before they become rows: beside
    explode(), a count would cut the whole text again for each of its terms."""
    whole = queries.select("qid", F.array_distinct(terms).alias("terms"))
    return whole.select("qid", "terms", F.size("terms").alias("n_terms")).select("qid", F.explode("terms").alias("term"), "n_terms")


def percent_of(mode: str, share: int | None) -> int:
    return share if share else {"any": 0, "all": 100, "balanced": 50}[mode]


def bm25(docs: DataFrame, queries: DataFrame, k: int, mode: str = "any", share: int | None = None, use_phrase: bool = False, stop: Sequence[str] = (), among: Column | None = None, analyzer: str = "plain") -> DataFrame:
    """(qid, id, score, matched, rank): the k best of docs (id, text) for each of queries (qid, text).

    mode `any` needs one term, `all` every term, `balanced` half of them; `share` (percent, rounded down, one at
    least) takes precedence. idf is ln(1 + (N - df + 0.5) / (df + 0.5)); statistics cover all docs. Only terms of a
    query count; ties go to the smaller id. Documents are scored where they lie (bm25_long). Terms in `stop` (lower
    case) don't count in queries, documents or their lengths. With `use_phrase` a document that holds the whole query as
    a phrase, stop words included, gets the phrase's score added: the idf of all its terms, with the phrase's count as tf.
    `among`, a condition on docs, filters what may be found; statistics still cover all docs. `analyzer` is the name of
    one in functions.text. A table that is searched again and again is better kept as a lexical_index.LexicalIndex.
    """
    if use_phrase:
        return bm25_joined(docs, queries, k, mode, share, True, stop, among, analyzer)
    return bm25_long(docs, queries, k, percent=percent_of(mode, share), stop=stop, among=among, analyzer=analyzer)


def bm25_joined(docs: DataFrame, queries: DataFrame, k: int, mode: str = "any", share: int | None = None, use_phrase: bool = False, stop: Sequence[str] = (), among: Column | None = None, analyzer: str = "plain") -> DataFrame:
    """bm25() by joins on terms, for the phrase clause, which needs every hit's score: a row per hit of a query's term.
    Only terms of a query leave the documents, counted before they are shuffled."""
    own, wanted = corpus_terms(docs, stop, analyzer), query_terms(queries, stop, analyzer)
    stats = own.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = wanted.select("term").distinct()
    tf = own.select("id", "dl", F.explode("terms").alias("term")).join(asked, "term").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = lambda tf: F.col("idf") * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = wanted.join(idf, "term").join(tf, "term").groupBy("qid", "id", "n_terms").agg(F.sum(part("tf")).alias("score"), F.count("*").alias("matched"))
    hits = hits.where(F.col("matched") >= F.greatest(F.lit(1), F.floor(F.col("n_terms") * percent_of(mode, share) / 100)))
    if use_phrase:
        whole = queries.select("qid", F.explode(kept(stop, analyzer)).alias("term")).join(idf, "term").groupBy("qid", "avgdl").agg(F.sum("idf").alias("idf"))
        found = phrase(docs, queries, analyzer).join(whole, "qid").join(own.select("id", "dl"), "id").select("qid", "id", part("n").alias("more"))
        hits = hits.join(found, ["qid", "id"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    if among is not None:
        hits = hits.join(docs.where(among).select("id"), "id", "left_semi")
    return top_by(hits.select("qid", "id", "score", "matched"), k, ["qid"], [F.desc(F.round("score", 9)), F.asc("id")])


class Stored:
    """A block of neighbouring documents as one row: the block's different terms once, and for each document the numbers
    of its terms and their counts, as bytes. Whoever reads it looks up a term once a block instead of once a place."""

    @staticmethod
    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents (id, terms, open); the documents of a row are all open or all not."""
        for whole in batches:
            for open_ in (True, False):
                part = whole.filter(pc.equal(whole.column(2), open_))
                sizes = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                at = 0
                while at < part.num_rows:
                    upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + DOCS]), DOC_TERMS, side="right")))
                    yield Stored._row(part.slice(at, upto - at), sizes[at:upto].astype(np.int64), open_)
                    at = upto

    @staticmethod
    def _row(docs: pa.RecordBatch, sizes: np.ndarray, open_: bool) -> pa.RecordBatch:
        words = docs.column(1).flatten().cast(pa.string()).dictionary_encode()
        terms = words.dictionary
        code, m = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(terms))
        cell, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * m + code, return_counts=True)
        doc, code = cell // m, cell % m
        ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int32)
        data = (terms.buffers()[2] or b"")[ends[0] : ends[-1]]
        ids = pa.ListArray.from_arrays(pa.array([0, docs.num_rows], pa.int32()), docs.column(0))
        kept = {"sizes": np.bincount(doc, minlength=len(sizes)), "code": code, "tf": tf, "df": np.bincount(code, minlength=len(terms))}
        columns = {"open": pa.array([open_]), "n": pa.array([len(sizes)], pa.int64()), "total": pa.array([int(sizes.sum())], pa.int64()), "ids": ids}
        columns |= {name: pa.array([x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()], pa.binary()) for name, x in kept.items()}
        columns |= {"ends": pa.array([(ends - ends[0]).astype(np.int32).tobytes()], pa.binary()), "words": pa.array([bytes(data)], pa.binary())}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    @staticmethod
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, n): the documents that have a term, for each block."""
        for batch in batches:
            for block in Stored.rows(batch):
                yield pa.RecordBatch.from_arrays([block.terms(), pa.array(block.df.astype(np.int64))], names=["term", "n"])

    @staticmethod
    def rows(batch: pa.RecordBatch) -> list[Stored]:
        return [Stored({name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}) for i in range(batch.num_rows)]

    @staticmethod
    def numbered(batch: pa.RecordBatch, words: pa.StringArray) -> Iterator[tuple[Stored, np.ndarray]]:
        """The blocks of a batch, each with its terms' places in `words`, -1 for others; looked up for the whole batch at once,
        as each time makes a table of `words`."""
        blocks = Stored.rows(batch)
        terms = pa.chunked_array([x.terms() for x in blocks], pa.string())
        found = pc.index_in(terms, value_set=words).fill_null(-1).to_numpy().astype(np.int64)
        yield from zip(blocks, np.split(found, np.cumsum([len(x.ends) - 1 for x in blocks])[:-1]), strict=True)

    def __init__(self, row: dict[str, pa.Scalar]):
        self.words, self.ends = row["words"].as_buffer(), np.frombuffer(row["ends"].as_buffer(), np.int32)

        def numbers(name: str, count: int) -> np.ndarray:  # of the fewest bytes that hold them all
            kept = row[name].as_buffer()
            return np.frombuffer(kept, f"u{kept.size // count}") if count else np.empty(0, np.uint8)

        if "df" in row:
            self.df = numbers("df", len(self.ends) - 1)
        if "ids" in row:
            self.ids = row["ids"].values
            self.sizes = numbers("sizes", len(self.ids)).astype(np.int64)
            self.code, self.tf = (numbers(name, int(self.sizes.sum())) for name in ("code", "tf"))

    def terms(self) -> pa.StringArray:
        return pa.StringArray.from_buffers(len(self.ends) - 1, pa.py_buffer(self.ends), self.words)

    def tiles(self, known: np.ndarray, step: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, lengths, terms, docs, tf) of at most `step` documents at a time: their terms that are `known` by a number."""
        cuts = np.concatenate(([0], np.cumsum(self.sizes)))
        for at in range(0, len(self.sizes), step):
            sizes = self.sizes[at : at + step]
            lo, hi = cuts[at], cuts[at + len(sizes)]
            doc, tf = np.repeat(np.arange(len(sizes)), sizes), self.tf[lo:hi].astype(np.int64)
            terms = known[self.code[lo:hi]] if hi > lo else np.empty(0, np.int64)
            asked = terms >= 0
            yield self.ids.slice(at, len(sizes)), np.bincount(doc, tf, len(sizes)), terms[asked], doc[asked], tf[asked]


def bm25_long(docs: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, pairs: int = PAIRS, percent: int = 0, stop: Sequence[str] = (), among: Column | None = None, analyzer: str = "plain") -> DataFrame:
    """(qid, id, score, matched, rank) as bm25() has it, for queries of any length, such as whole documents.

    Queries share terms with nearly every document, so joining them term by term makes rows by the thousand for
    a document. Here queries go out in blocks of a bounded number of terms, with their idf; each task scores its
    documents where they lie against a whole block and keeps k rows a query, so only those are shuffled. Texts are cut
    into terms once and written as blocks of neighbours (Stored), as every block of queries reads them all; how many
    documents have a term is told by these. The rows of each block of queries are written before the next begins, so that
    the driver and the tasks hold one at a time, and of the documents a few megabytes.
    """
    spark, folder = docs.sparkSession, fresh_folder(docs.sparkSession, "bm25")

    def stored(table: DataFrame, name: str, *by: str) -> DataFrame:
        table.write.partitionBy(*by).parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    open_ = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    kinds = {"qid": queries.schema["qid"].dataType.simpleString(), "id": docs.schema["id"].dataType.simpleString()}
    cut = docs.select("id", corpus_kept(stop, analyzer).alias("terms"), open_.alias("open"))
    wanted = stored(query_terms(queries, stop, analyzer), "wanted")
    with batches_of(spark, read=READ):
        own = stored(cut.mapInArrow(Stored.made, f"open boolean, n long, total long, ids array<{kinds['id']}>, sizes binary, code binary, tf binary, df binary, ends binary, words binary"), "documents")
        n, total = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        avgdl = total / n if n else 0.0
        df = own.select("ends", "words", "df").mapInArrow(Stored.counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
        weighed = wanted.select("term").distinct().join(df, "term").select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        weighed = stored(weighed, "weighed")
    idf = wanted.join(weighed, "term").select("qid", "term", "n_terms", "idf")
    sizes = wanted.agg(F.count("*").alias("pairs"), F.count_distinct("qid").alias("queries")).first()
    parts = max(sizes.pairs // pairs, sizes.queries // block) + 1
    result = None
    if parts > 1:
        idf = stored(idf.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")), "idf", "part")
    for i in range(parts):
        rows = (idf if parts == 1 else idf.where(F.col("part") == i)).toPandas()
        if rows.empty:
            continue
        sent = spark.sparkContext.broadcast((asked := Asked(rows, percent), pa.array(asked.words, pa.string())))

        def nearest(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, words = sent.value
            best, everyone = Kept(len(asked.qids), k), np.arange(len(asked.qids))
            step = max(1, TILE // len(everyone))
            for batch in batches:
                for block, known in Stored.numbered(batch, words) if batch.num_rows else ():
                    for ids, dl, terms, of, tf in block.tiles(known, step):
                        best.add(ids, *asked.scores(terms, of, asked.part(terms, tf, dl[of], avgdl), len(ids), everyone), everyone)
            yield from best.rows(asked.qids)

        found = own.where("open").select("ids", "sizes", "code", "tf", "ends", "words").mapInArrow(nearest, f"qid {kinds['qid']}, id {kinds['id']}, score double, matched long")
        with batches_of(spark, read=READ):
            found = stored(top_by(found, k, ["qid"], [F.desc(F.round("score", PLACES)), F.asc("id")]), f"found-{i}")
        sent.unpersist()
        result = found if result is None else result.unionByName(found)
    for name in ("documents", "wanted", "weighed", "idf"):
        dropped(spark, f"{folder}/{name}")
    return empty(spark, f"qid {kinds['qid']}, id {kinds['id']}, score double, matched long, rank int") if result is None else result


#: Queries whose rarest terms are sent to all tasks at once; beyond that they are met by an ordinary join.
SENT = 50_000


def phrase(docs: DataFrame, queries: DataFrame, analyzer: str = "plain") -> DataFrame:
    """(qid, id, n): how often the terms of a query stand in a document in its order, one after another.

    Each query goes out under its rarest term in docs only; where a document has that term, the terms from the start
    that it implies are compared with the whole query. Queries without terms, or with one that no document has, match
    nothing.
    """
    own = corpus_terms(docs, analyzer=analyzer).select("id", "terms")
    asked = queries.select("qid", analyzed("text", analyzer).alias("wanted")).where(F.size("wanted") > 0)
    counts = own.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    rare = asked.select("qid", F.posexplode("wanted").alias("offset", "term")).join(counts, "term")
    rare = rare.groupBy("qid").agg(F.min_by(F.struct("term", "offset"), F.struct("n", "offset")).alias("r")).select("qid", "r.*")
    at = own.select("id", F.posexplode("terms").alias("pos", "term")).join(F.broadcast(rare) if queries.count() <= SENT else rare, "term")
    starts = at.select("qid", "id", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    met = starts.join(asked.withColumn("n_terms", F.size("wanted")), "qid").join(own, "id")
    return met.where(F.slice("terms", F.col("start") + 1, F.col("n_terms")) == F.col("wanted")).groupBy("qid", "id").agg(F.count("*").alias("n"))
