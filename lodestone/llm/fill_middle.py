"""Fill-in-middle rearrangement: packed boundary bitvectors with rank and select turn code-point cuts into byte cuts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, spread, unused

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Per cent of the documents that are rearranged, and of those the per cent that put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes of a bitvector that one entry of the directory counts.
BLOCK = 64
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class Boundaries:
    """Which bytes of some UTF-8 begin a code point: one bit a byte, and a directory with the bits before each block."""

    def __init__(self, data: bytes):
        self.n = len(data)
        marks = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
        bits = np.packbits(marks)
        blocks = len(bits) // BLOCK + 1  # the last one is never full, so that every position has a block
        self.bits = np.zeros((blocks, BLOCK), dtype=np.uint8)
        self.bits.reshape(-1)[: len(bits)] = bits
        self.before = np.concatenate(([0], np.cumsum(POPCOUNT[self.bits].sum(axis=1, dtype=np.int64))))
        self.total = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that begin before the bytes `at`."""
        block, byte, bit = at // (8 * BLOCK), at // 8 % BLOCK, at % 8
        rows = self.bits[block]
        whole = np.where(np.arange(BLOCK) < byte[:, None], POPCOUNT[rows], 0).sum(axis=1, dtype=np.int64)
        part = POPCOUNT[rows[np.arange(len(at)), byte] & (0xFF00 >> bit & 0xFF).astype(np.uint8)]
        return self.before[block] + whole + part

    def select(self, k: np.ndarray) -> np.ndarray:
        """The bytes at which the code points `k` (from 0) begin; the end of the data for those after the last."""
        inside = np.minimum(k, max(self.total - 1, 0))
        block = np.minimum(np.searchsorted(self.before, inside, side="right") - 1, len(self.bits) - 1)
        rows, left = self.bits[block], inside - self.before[block]
        sums = np.cumsum(POPCOUNT[rows], axis=1, dtype=np.int64)
        byte = (sums > left[:, None]).argmax(axis=1)
        here = rows[np.arange(len(k)), byte]
        left = left - (sums[np.arange(len(k)), byte] - POPCOUNT[here])
        bit = (np.cumsum(np.unpackbits(here[:, None], axis=1), axis=1, dtype=np.int64) > left[:, None]).argmax(axis=1)
        return np.where(k >= self.total, self.n, (block * BLOCK + byte) * 8 + bit)


def draws(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four numbers below 2**32 by an id: the first 8-digit groups of the hex SHA-256 of seed, colon and id.

    A null id counts as an empty string."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(docs: DataFrame, seed: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: Sequence[str] = MARKS) -> DataFrame:
    """docs with `n` (code points), `form` (plain, psm or spm), `prefix_chars`, `middle_chars` and `output`.

    Both cuts and the form are drawn by doc_id, so that a rerun gives the same rows. psm puts the parts in the order
    prefix, suffix, middle, spm suffix, prefix, middle, each behind its mark. Null and empty texts, texts that hold a
    mark, and those beyond `rate` stay plain, with null lengths. Rows that repeat a doc_id are cut alike; null ids share
    one draw. Columns of docs other than doc_id and text are left out; an empty table gives an empty one. A text of any
    length is cut whole: a task holds a few megabytes of text and its bitvector, or a single longer text.
    """
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [x or b"" for x in b.column(1).cast(pa.large_binary()).to_pylist()]
            h1, h2, h3, h4 = (np.asarray(b.column(i)) for i in range(2, 6))
            ends = np.cumsum([len(x) for x in texts])
            starts = np.concatenate(([0], ends[:-1]))
            bounds = Boundaries(b"".join(texts))
            base = bounds.rank(starts)
            n = bounds.rank(ends) - base
            a, z = h1 % (n + 1), h2 % (n + 1)
            low, high = np.minimum(a, z), np.maximum(a, z)
            # a text's last cut would be the next text's first byte, which is where the text ends
            cuts = [np.where(c >= n, ends, bounds.select(base + c)) - starts for c in (low, high)]
            out, forms = [], []
            for text, i, j, x3, x4 in zip(texts, *cuts, h3, h4, strict=True):
                if not text or x3 % 100 >= rate or p in text or s in text or m in text:
                    forms.append("plain")
                    out.append(text)
                elif x4 % 100 < suffix_first:
                    forms.append("spm")
                    out.append(b"".join((s, text[j:], p, text[:i], m, text[i:j])))
                else:
                    forms.append("psm")
                    out.append(b"".join((p, text[:i], s, text[j:], m, text[i:j])))
            plain = np.array([f == "plain" for f in forms])
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(forms), pa.array(low, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = spread(own).select("doc_id", "text", *[d.alias(f"h{i}") for i, d in enumerate(draws(F.col("doc_id"), seed))])
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, marks: Sequence[str] = MARKS, name: str = "restored") -> DataFrame:
    """rows (with `form` and `output`) and the text that the output was made of, read from its marks alone.

    An output of null or of form plain is its own text. If rows have the column already, it gets underscores before it."""
    p, s, m = marks

    def upto(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, 1)

    def after(c: Column, mark: str) -> Column:
        return F.substring(c, F.length(upto(c, mark)) + (len(mark) + 1), F.length(c))

    body = F.col("output")
    psm = F.concat(upto(after(body, p), s), after(after(body, s), m), upto(after(body, s), m))
    spm = F.concat(upto(after(body, p), m), after(after(body, p), m), upto(after(body, s), p))
    return rows.withColumn(unused(name, rows), F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(body))


def op13_fill_middle(spark, sf_dir):
    """Per document its length, form and cuts, and digests of the output and of the text restored from it.

    Null texts are empty ones and repeated ids give repeated draws; see fill_middle."""
    from .common import table

    rows = restore(fill_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
g as (
  select doc_id, text, length(text) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as i, greatest(h1 % (n + 1), h2 % (n + 1)) as j,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form from g),
p as (select *, substr(text, 1, i) as pre, substr(text, i + 1, j - i) as mid, substr(text, j + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then i end as prefix_chars, case when form <> 'plain' then j - i end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
