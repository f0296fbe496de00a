"""Chunking: fixed size, recursive, and by meaning. Chunks are rows (doc_id, chunk_index, start_char, end_char, content)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, words

CHUNK = "doc_id long, chunk_index int, start_char int, end_char int, content string"
NAMES, TYPES = ["doc_id", "chunk_index", "start_char", "end_char", "content"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
#: Characters of chunks that a task holds before it sends them on, and what a row counts besides its text.
PIECE, ROW = 2_000_000, 200
SIZE, OVERLAP = 1000, 200
SENTENCE_END = re.compile(r"[.!?]\s")
#: Numbers of the offline text vectors.
DIMENSIONS = 256


def tidy(text: str) -> str:
    """Runs of spaces and tabs as one space, three or more newlines as two, stripped."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def check(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("the overlap must be smaller than the size, both not negative")


def break_before(text: str, start: int, end: int, size: int) -> int:
    """Where to end a chunk that should end at `end`: after the last sentence end, blank line or space of its last fifth."""
    low = max(start, end - size // 5)
    last = 0
    for m in SENTENCE_END.finditer(text, low, end):
        last = m.end()
    if last:
        return last
    for mark in ("\n\n", " "):
        at = text.rfind(mark, low, end)
        if at > low:
            return at + len(mark)
    return end


def fixed(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int, str]]:
    """(start, end, content) in the tidied text. As a chunk's end isn't clamped, the last may lie behind the text."""
    text = tidy(text)
    if len(text) <= size:
        if text:
            yield 0, len(text), text
        return
    start, last = 0, -1
    while start < len(text):
        end = start + size
        if end < len(text):
            end = break_before(text, start, end, size)
        if body := text[start:end].strip():
            yield start, end, body
            last = start
        start = end - overlap if last < 0 or end - overlap > last else end


SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def recursive(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int, str]]:
    """Pieces between the coarsest separators that make them small enough, put together up to the size, each chunk
    beginning with as many of the last pieces as fit into the overlap. Offsets are those of the text itself."""

    def pieces(a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
        if b - a <= size:
            yield a, b
            return
        mark = SEPARATORS[level]
        if not mark:
            yield from ((i, min(b, i + size)) for i in range(a, b, size))
            return
        while a < b:
            at = text.find(mark, a, b)
            cut = b if at < 0 else at + len(mark)
            yield from pieces(a, cut, level + 1)
            a = cut

    held: list[tuple[int, int]] = []
    for p in pieces(0, len(text), 0):
        if held and p[1] - held[0][0] > size:
            yield from _emit(text, held[0][0], held[-1][1])
            while held and (held[-1][1] - held[0][0] > overlap or p[1] - held[0][0] > size):
                held.pop(0)
        held.append(p)
    if held:
        yield from _emit(text, held[0][0], held[-1][1])


def _emit(text: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
    if body := text[a:b].strip():
        yield a, b, body


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]


def text_vector(text: str) -> np.ndarray:
    """The offline vector: hashed counts of the words; equal texts have equal vectors."""
    v = np.zeros(DIMENSIONS)
    for w in re.findall(r"\w+", text.lower()):
        h = zlib.crc32(w.encode())
        v[h % DIMENSIONS] += 1 if h >> 31 else -1
    return v


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / n if n else 0.0


def semantic(text: str, least: int = 100, most: int = 2000, merge_over: float = 0.35, cut_below: float | None = None, embed: Callable[[str], np.ndarray] = text_vector) -> Iterator[tuple[int, int, str]]:
    """Groups of sentences, cut where neighbours are less alike than the mean by a standard deviation (or `cut_below`).

    A group under `least` characters joins the next if they are alike; one over `most` is filled anew sentence by
    sentence. Offsets are found by looking for a group's first sentence from the end of the one before.
    """
    own = sentences(text)
    if not own:
        return
    vectors = [embed(s) for s in own]
    near = np.array([_cosine(a, b) for a, b in zip(vectors, vectors[1:], strict=False)])
    limit = (near.mean() - near.std() if cut_below is None else cut_below) if len(near) else 0.0
    edges = [0, *(int(i) + 1 for i in np.flatnonzero(near < limit)), len(own)]
    groups = [own[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    means = [embed(" ".join(g)) for g in groups]
    out: list[list[str]] = []
    i = 0
    while i < len(groups):
        group = groups[i]
        if len(" ".join(group)) < least and i + 1 < len(groups) and _cosine(means[i], means[i + 1]) > merge_over:
            i += 1
            group = group + groups[i]
        filled: list[str] = []
        for s in group:
            if filled and len(" ".join(group)) > most and len(" ".join([*filled, s])) > most:
                out.append(filled)
                filled = []
            filled.append(s)
        out.append(filled)
        i += 1
    at = 0
    for g in out:
        body = " ".join(g)
        found = text.find(g[0], at)
        start = at if found < 0 else found
        yield start, start + len(body), body
        at = start + len(body)


STRATEGIES: dict[str, Callable[..., Iterator[tuple[int, int, str]]]] = {"simple": fixed, "smart": recursive, "semantic": semantic}


def chunk(docs: DataFrame, strategy: str = "simple", **options) -> DataFrame:
    """Chunks of docs (doc_id, text) where the rows lie, without a shuffle. Unknown strategies are `simple`; null and
    blank texts have no chunks."""
    cut = STRATEGIES.get(strategy, fixed)
    if cut is not semantic:
        check(options.get("size", SIZE), options.get("overlap", OVERLAP))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _cut(b, cut, options)

    return docs.select("doc_id", "text").mapInArrow(run, CHUNK)


def _cut(docs: pa.RecordBatch, cut: Callable[..., Iterator[tuple[int, int, str]]], options: dict, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The chunks of docs (doc_id, text), some megabytes at a time: texts are taken out of the batch one by one."""
    rows, held = [], 0
    for i in range(docs.num_rows):
        d, t = docs.column(0)[i].as_py(), docs.column(1)[i].as_py()
        for j, (start, end, content) in enumerate(cut(t, **options) if t else ()):
            rows.append((d, j, start, end, content))
            held += len(content) + ROW
            if held >= most:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)


def chunk_plain(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of exactly `size` characters of the tidied text whatever they cut through; columns only, no Python."""
    check(size, overlap)
    text = strip(F.regexp_replace(F.regexp_replace("text", r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    own = docs.select("doc_id", text.alias("text")).where("text <> ''").withColumn("n", F.length("text"))
    starts = F.when(F.col("n") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1, F.lit(size - overlap)))
    rows = own.select("doc_id", "text", "n", F.explode(starts).alias("start_char"))
    end = F.when(F.col("n") <= size, F.col("n")).otherwise(F.col("start_char") + size)
    rows = rows.select("doc_id", "start_char", end.alias("end_char"), strip(F.substring("text", F.col("start_char") + 1, F.lit(size))).alias("content")).where("content <> ''")
    return rows


def stats(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, least, most, mean, n_words) of the chunks' sizes."""
    n = F.length("content")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.sum(F.size(words("content"))).alias("n_words"))


def duplicates(chunks: DataFrame) -> DataFrame:
    """(doc_id, hash, indexes, n): chunks of a document that are equal after white space is evened out."""
    digest = F.sha1(strip(F.regexp_replace("content", r"(?U)\s+", " ")))
    by = chunks.groupBy("doc_id", digest.alias("hash")).agg(F.sort_array(F.collect_set("chunk_index")).alias("indexes"))
    return by.where(F.size("indexes") >= 2).withColumn("n", F.size("indexes"))
