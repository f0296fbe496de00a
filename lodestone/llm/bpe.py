"""Byte-level BPE: DuckDB recursive queries inside each Spark partition merge words and decode ids."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces, small_batches

#: Distinct words whose ids a worker keeps between batches; the cache is emptied when it is full.
CACHE = 600_000
#: Each round joins token rows, which also hold their right neighbour, with the merge table and contracts every word's
#: leftmost pair of least rank: row p takes the new token m, row q goes (its token is null), and the row before p gets a
#: new neighbour. A word of which no pair is in the table leaves the recursion. Only the last state of each (word,
#: position) is kept, so memory follows the words' bytes, not the rounds.
MERGE = """
with recursive t(w, pos, tok, next, ntok) using key (w, pos) as (
  select w, pos, tok, next, ntok from bytes_in
  union all
  select w, pos, case when pos = p then m when pos = q then null else tok end, case when pos = p then after else next end,
    case when pos = p then atok when next = p then m else ntok end
  from t join (
    select b.*, x.next as after, x.ntok as atok
    from (
      select w, min(pick) >> 32 as m, min(pick) & 4294967295 as p, arg_min(next, pick) as q
      from (select w, next, (id << 32) + pos as pick from t join merges on l = tok and r = ntok) group by w) b
    join t x on x.w = b.w and x.pos = b.q) using (w)
  where tok is not null)
select w, string_agg(tok::varchar, ',' order by pos) as ids from t where tok is not null group by w
"""

#: Ordered aggregation puts a text's pieces together; bytes travel as the characters of the same number.
DECODE = "select d, string_agg(v.piece, '' order by pos) as text from ids_in join vocab v on v.id = tok group by d"


class Bpe:
    """Encodes and decodes batches of texts with the ranks of a vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, str] = {}
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        merges = []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    merges.append((left, right, rank))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False, "temp_directory": ""})
        l, r, i = (pa.array(np.array(x, np.int64)) for x in zip(*merges, strict=True))
        self._table("merges", pa.table({"l": l, "r": r, "id": i}))
        self._table("vocab", pa.table({"id": pa.array(list(self.ranks.values()), pa.int64()), "piece": [x.decode("latin-1") for x in self.ranks]}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows_in", rows)
        self.db.execute(f"create or replace table {name} as select * from rows_in")
        self.db.unregister("rows_in")

    def _merge(self, words: list[str], most: int = 400_000) -> None:
        """Words go in by length, so that those of one query take about as many rounds."""
        words = sorted(words, key=len)
        start = 0
        while start < len(words):
            end, total = start, 0
            data = []
            while end < len(words) and (end == start or total < most):
                data.append(words[end].encode("utf-8", "surrogatepass"))
                total += len(data[-1])
                end += 1
            sizes = np.array([len(x) for x in data])
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            toks = self.first[np.frombuffer(b"".join(data), np.uint8)]
            word = np.repeat(np.arange(len(data)), sizes)
            last = np.append(word[1:] != word[:-1], True)
            rows = {"w": word, "pos": at, "tok": toks, "next": pa.array(at + 1, mask=last), "ntok": pa.array(np.append(toks[1:], 0), mask=last)}
            self._table("bytes_in", pa.table(rows))
            out = self.db.sql(MERGE).to_arrow_table()
            for w, ids in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                self.known[words[start + w]] = ids
            start = end

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text as decimal numbers joined by commas."""
        split = [self.split(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        self._merge(list(set().union(*split).difference(self.known)))
        known = self.known
        return [",".join([known[w] for w in ws]) for ws in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        sizes = np.array([len(x) for x in ids], np.int64)
        out = [b""] * len(ids)
        if sizes.sum():
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self.db.register("ids_in", pa.table({"d": np.repeat(np.arange(len(ids)), sizes), "pos": at, "tok": np.concatenate(ids)}))
            got = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("ids_in")
            for d, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                out[d] = text.encode("latin-1")
        return out


@lru_cache(maxsize=2)
def engine(path: str, pattern: str) -> Bpe:
    """One per worker process."""
    return Bpe(path, pattern)


def tokenize(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, [ids,] ids_sha256, decoded_sha256) per row of docs.

    Words are the matches of `pattern` in the whole text and are merged by the ranks of the file at `path`, without
    special tokens; the ids are then decoded, and a text that does not come back is an error. A null or empty text has
    no ids and the hashes of nothing. Repeated rows are encoded each, an empty table gives an empty one, and other
    columns are ignored. The file must be at the same path on every machine, as an installed package puts it. No
    shuffle. A single word of n letters takes about n rounds over n rows: README gives times for very long ones.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestone.llm.bpe import engine

        bpe = engine(path, pattern)
        for b in pieces(batches, most=1_500_000):
            texts = [t or "" for t in b.column(1).to_pylist()]
            encoded = bpe.encode(texts)
            ids = [np.fromstring(x, np.int64, sep=",") if x else np.empty(0, np.int64) for x in encoded]
            decoded = bpe.decode(ids)
            if any(d != t.encode() for d, t in zip(decoded, texts, strict=True)):
                raise ValueError("a text did not come back from its ids")
            sha = [[hashlib.sha256(x).hexdigest() for x in col] for col in ([e.encode() for e in encoded], decoded)]
            n = pa.array([len(x) for x in ids], pa.int64())
            lists = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([b.column(0), n, *lists, pa.array(sha[0], pa.string()), pa.array(sha[1], pa.string())], names=names)

    names = ["doc_id", "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]
    kinds = ["long", "long", *(["array<int>"] if with_ids else []), "string", "string"]
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark, sf_dir):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 per row of `documents`; null texts are empty ones."""
    from .common import spread, table

    return tokenize(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), *vocabulary(), with_ids=False)
