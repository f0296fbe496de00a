"""Repeated three-line windows across a corpus, removed but for their first occurrence. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Lines of a window.
WINDOW = 3


def repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, hash, gone): the 0-based lines of each text (doc_id and hash of the text) that later occurrences of
    repeated windows cover.

    Every run of `window` consecutive lines is hashed to 128 bits; only hashes, ids and positions are shuffled. The
    first occurrence in the order (doc_id, hash of the text, position) stays. It is found with partial aggregates, and
    one equi-join with a row per repeated window gives all others, so that a passage which very many documents share
    is a skewed key that adaptive execution splits.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= window)
    at = F.sequence(F.lit(0), F.size("lines") - window)
    hashed = F.transform(
        at,
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(F.slice("lines", i + 1, window)).alias("h1"),
            F.xxhash64(F.lit("second"), F.slice("lines", i + 1, window)).alias("h2"),
            F.exists(F.slice("lines", i + 1, window), lambda x: F.trim(x) != "").alias("some"),
        ),
    )
    seen = lines.select("doc_id", "hash", F.explode(hashed).alias("w")).select("doc_id", "hash", "w.*").where("some").drop("some")
    place = F.struct("doc_id", "hash", "pos")
    first = seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = seen.join(first, ["h1", "h2"]).where(place > F.col("first"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + (window - 1)))))
    return later.groupBy("doc_id", "hash").agg(covered.alias("gone"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, drop_emptied: bool = True) -> DataFrame:
    """docs with the repeated windows cut out of `text`; all other columns as they are, except that n_chars follows.

    A line goes if any later occurrence of a repeated window covers it; overlapping occurrences merge. Documents of
    fewer lines than a window, null and empty texts, windows of blank lines only and rows without doc_id stay as they
    are. Rows of one doc_id with different texts are documents of their own, in the order of a hash of the text; such
    with equal texts count as one and lose the same lines. A document of which no line is left is dropped, as all of
    it stands elsewhere, unless drop_emptied is off. Empty tables stay empty; columns may have any further names.
    """
    id_, hash_, gone_, left_ = (unused(n, docs) for n in ("id_", "hash_", "gone_", "left_"))
    gone = repeated_lines(docs.where("doc_id is not null").select("doc_id", "text"), window).toDF(id_, hash_, gone_)
    joined = docs.join(gone.hint("shuffle_hash"), (docs["doc_id"] == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(hash_)), "left")
    lines = F.split("text", "\n", -1)
    keep = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_)))
    text = F.when(F.col(gone_).isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn(left_, text)
    if drop_emptied:
        out = out.where(F.col(gone_).isNull() | (F.col(left_) != "") | (F.size(gone_) < F.size(lines)))
    columns = [F.col(left_).alias("text") if c == "text" else (F.length(left_).cast("long").alias(c) if c == "n_chars" else docs[c]) for c in docs.columns]
    return out.select(*columns)


def op6_line_dedup(spark, sf_dir):
    """One row per document that keeps any line: doc_id, the text left, its lines and length."""
    from .common import table

    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return docs.select("doc_id", "text", n.cast("long").alias("n_lines"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


ORACLE = r"""
with l as (
  select doc_id, text, string_split(text, chr(10)) as ls from documents),
w as (
  select doc_id, unnest(range(0, len(ls) - 2)) as pos, ls from l where len(ls) >= 3),
s as (
  select doc_id, pos, ls[pos + 1:pos + 3] as win from w
  where len(list_filter(ls[pos + 1:pos + 3], lambda x: trim(x, ' ') <> '')) > 0),
r as (select *, row_number() over (partition by win order by doc_id, pos) as nth from s),
g as (select doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) as gone from r where nth > 1 group by doc_id),
t as (
  select l.doc_id, l.text, gone, case when gone is null then l.text
    else array_to_string(list_filter(ls, lambda x, i: not list_contains(gone, i - 1)), chr(10)) end as left_
  from l left join g using (doc_id)),
k as (select * from t where gone is null or len(gone) < len(string_split(text, chr(10))))
select doc_id, left_ as text, case when left_ is null then 0 else len(string_split(left_, chr(10))) end::bigint as n_lines,
  coalesce(length(left_), 0) as n_chars
from k
"""
