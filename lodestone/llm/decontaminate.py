"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, Scratch, hash_words, mix, pieces, small_batches

#: A passage matches an item if at most this share of the item's words must be edited.
TOLERANCE = 0.2
#: Random walks, samplings of each walk, and coordinates of a sampling. tests/llm measure the recall this gives.
WALKS, SAMPLINGS, COORDINATES = 6, 4, 3
#: Items that are searched for in one pass; more go in further passes over the documents.
BLOCK = 20_000
SLOTS = 1 << 22
END = np.uint64(0)


def size_class(n: int) -> int:
    """The window for items of n words: the largest of 1, 2, ... growing by about an eighth that is at most n."""
    w = 1
    while (after := max(w + 1, w * 9 // 8)) <= n:
        w = after
    return w


def cgk(windows: np.ndarray, walk: int) -> np.ndarray:
    """The CGK random-walk embedding of rows of word hashes into 3 * w coordinates.

    Coordinate j repeats the symbol under the cursor, and a random bit of (walk, j, symbol) decides whether the cursor
    moves on; so two rows that differ by few edits fall into step again after each and agree in most coordinates.
    """
    n, w = windows.shape
    padded = np.concatenate([windows, np.full((n, 1), END)], axis=1)
    out = np.empty((n, 3 * w), np.uint64)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    seeds = mix(np.arange(1, 3 * w + 1, dtype=np.uint64) * M1 + np.full(1, walk + 1, np.uint64) * M2)
    for j in range(3 * w):
        x = padded[rows, at]
        out[:, j] = x
        at = np.minimum(at + (mix(x ^ seeds[j]) >> np.uint64(63)).astype(np.int64), w)
    return out


def sampled_keys(windows: np.ndarray) -> np.ndarray:
    """WALKS * SAMPLINGS keys for each row: a few sampled coordinates of an embedding, hashed with the sampling's number."""
    n, w = windows.shape
    keys = np.empty((n, WALKS * SAMPLINGS), np.uint64)
    for walk in range(WALKS):
        e = cgk(windows, walk)
        draw = np.random.default_rng(1000 * w + walk)
        for s in range(SAMPLINGS):
            key = np.full(n, walk * SAMPLINGS + s + 1, np.uint64)
            for j in draw.integers(0, 3 * w, COORDINATES):
                key = mix(key * M1 + e[:, j])
            keys[:, walk * SAMPLINGS + s] = key
    return keys


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the run of words in text that is nearest to the item; of equal ones the first to end."""
    m = len(text)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for i, x in enumerate(item, 1):
        up, diagonal = cost + 1, cost[:-1] + (text != x)
        c, s = up.copy(), start.copy()
        better = diagonal <= up[1:]
        c[1:][better], s[1:][better] = diagonal[better], start[:-1][better]
        low = np.minimum.accumulate(c - steps)  # then skip words of the text
        source = np.maximum.accumulate(np.where(c - steps == low, steps, 0))
        cost, start = low + steps, s[source]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


class Index:
    """The keys of a block of items by window size."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items, self.classes = [], {}
        table = np.zeros(SLOTS, np.uint64)
        by_size: dict[int, list[int]] = {}
        for item_id, text in items:
            words = hash_words((text or "").encode())
            if len(words):
                by_size.setdefault(size_class(len(words)), []).append(len(self.items))
                self.items.append((item_id, words))
        self.table = table
        self.slack = max((self.edits(len(w)) for _, w in self.items), default=0)
        for c, (w, own) in enumerate(sorted(by_size.items())):
            bit = np.uint64(1) << np.uint64(c % 64)
            for k in own:
                table[self.slots(self.items[k][1])] |= bit
            keys = sampled_keys(np.stack([self.items[k][1][:w] for k in own]))
            most = max(self.edits(len(self.items[k][1])) for k in own)
            flat, which = keys.reshape(-1), np.repeat(own, keys.shape[1])
            order = np.argsort(flat, kind="stable")
            self.classes[w] = (max(0, w - 2 - 3 * most), bit, flat[order], which[order])

    @staticmethod
    def edits(n: int) -> int:
        return int(TOLERANCE * n)

    @staticmethod
    def slots(words: np.ndarray) -> np.ndarray:
        return (mix(mix(words[:-2] * M1 + words[1:-1]) * M1 + words[2:]) & np.uint64(SLOTS - 1)).astype(np.int64)

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, start): windows that share a sampled key with an item.

        A window within e edits of an item keeps all but 3 * e of its word triples. Windows with fewer triples that
        occur in any item of the size are not embedded; that bound is exact, so only the sampling can miss a passage.
        """
        seen = self.table[self.slots(words)] if len(words) > 2 else np.empty(0, np.uint64)
        for w, (least, bit, keys, which) in self.classes.items():
            if len(words) < w:
                continue
            kept = np.zeros(len(words) - w + 1, np.int32)
            if w > 2:
                sums = np.zeros(len(seen) + 1, np.int32)
                np.cumsum((seen & bit) != 0, out=sums[1:])
                kept = sums[w - 2 :] - sums[: len(words) - w + 1]
            starts = np.flatnonzero(kept >= least)
            for part in np.array_split(starts, len(starts) // 20_000 + 1):
                if not len(part):
                    continue
                own = sampled_keys(words[part[:, None] + np.arange(w)])
                low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
                for r, c in zip(*np.nonzero(high > low), strict=True):
                    for k in range(low[r, c], high[r, c]):
                        yield int(which[k]), int(part[r])

    def matches(self, docs: list[np.ndarray]) -> list[dict[int, tuple[int, int, int]]]:
        """For each document, item id -> (edits, first word, word after the last) of the nearest passage within the
        tolerance. All documents of a call are searched at once, with room for unfinished passages after each."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in docs]
        gap = np.full(self.slack + 1, END)
        starts_of = np.cumsum([0] + [len(d) + len(gap) for d in docs])
        near: dict[tuple[int, int], set[int]] = {}
        for item, start in self.candidates(np.concatenate([x for d in docs for x in (d, gap)] or [gap])):
            k = int(np.searchsorted(starts_of, start, side="right")) - 1
            near.setdefault((k, item), set()).add(start - int(starts_of[k]))
        for (k, item), starts in near.items():
            item_id, own = self.items[item]
            most, ordered = self.edits(len(own)), sorted(starts, reverse=True)
            while ordered:
                first = last = ordered.pop()
                while ordered and ordered[-1] - last <= len(own):
                    last = ordered.pop()
                a, b = max(0, first - most), min(len(docs[k]), last + len(own) + 2 * most)
                edits, s, e = best_match(own, docs[k][a:b])
                if edits <= most and (item_id not in found[k] or (edits, a + s) < found[k][item_id][:2]):
                    found[k][item_id] = (edits, a + s, a + e)
        return found


def _each_block(docs: DataFrame, items: DataFrame, size: int, pass_: Callable) -> Iterator[DataFrame]:
    """What pass_ makes of each block of about `size` items. Where there are several, each result is written before the
    next block is gathered, so that the driver and the tasks hold one at a time. Rows without id or words find nothing."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct()
    n = own.count() // size + 1
    scratch = Scratch(docs.sparkSession)
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        index = Index(sorted((r.item_id, r.text or "") for r in part.collect()))
        sent = docs.sparkSession.sparkContext.broadcast(index)
        result = pass_(docs, sent)
        if n > 1:
            result = scratch.keep(f"block {k}", result)
            sent.destroy()
        yield result


def _over(docs: DataFrame, sent, use: Callable, schema) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = b.column(b.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()
            yield use(b, sent.value.matches([hash_words(t or b"") for t in texts]))

    return docs.mapInArrow(run, schema)


def leaks(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, edits, start_word, end_word): documents that hold a benchmark item, whole or edited.

    Words are runs without ASCII white space, A-Z lower-cased; edits counts words put in, left out or replaced, and is
    at most TOLERANCE of the item's words. One row per document row and item, for its nearest passage. Items of up to
    four words allow no edit. Null or empty texts and items match nothing; empty tables give an empty result; other
    columns are ignored. Items are sent to the tasks in blocks of `block`, one at a time, documents are not shuffled.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits long, start_word long, end_word long"

    def rows(b: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        ids = b.column(0).to_pylist()
        out = [(ids[i], item, *m) for i, f in enumerate(found) for item, m in sorted(f.items())]
        names = ["doc_id", "item_id", "edits", "start_word", "end_word"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=names)

    return reduce(DataFrame.unionByName, _each_block(own, items, block, lambda d, sent: _over(d, sent, rows, schema)))


def drop_leaks(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs that hold no item; columns as they are, whatever their names. Each block of items sees what the
    ones before left; rows with null or empty texts stay."""

    def keep(b: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        return b.filter(pa.array([not f for f in found], pa.bool_()))

    left = [docs]

    def pass_(_: DataFrame, sent) -> DataFrame:
        return _over(left[-1], sent, keep, docs.schema)

    for result in _each_block(docs, items, block, pass_):
        left.append(result)
    return left[-1]


def op3_decontamination(spark, sf_dir):
    """doc_id, item_id, edits, start_word and end_word for every row of `documents` and item of `benchmark` that it holds."""
    from .common import spread, table

    return leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
