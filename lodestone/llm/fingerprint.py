"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits. DataFrame functions only."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a sketch (a power of two), low-order bits kept of each, words of a shingle, probes before the full order.
BINS, BITS, SHINGLE, PROBES = 256, 4, 5, 16
#: Bins that one packed 64-bit number holds.
PER_LONG = 64 // BITS
#: Neighbouring ids that are put in order together, as a power of two, and groups of a level above.
BUCKET_BITS, FAN_BITS = 5, 11


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of all runs of `size` lower-cased words; fewer words make one shingle, none make none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")

    def runs(w: Column) -> Column:
        full = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < size, F.array(F.xxhash64(w))).otherwise(full)

    return _let(F.transform(words, lambda x: F.xxhash64(x)), runs)


def _bin(x: Column) -> Column:
    """The top bits of a hash: a bin from 0."""
    return (F.shiftright(x, 64 - BINS.bit_length() + 1) + BINS // 2).cast("int")


def _dense(firsts: Column) -> Column:
    """The least hash of each bin in bin order, null for empty bins; `firsts` are those of the full bins in order."""
    nothing = F.lit(None).cast("bigint")
    gap = lambda x, i: _bin(x) - F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get(firsts, F.greatest(i - 1, F.lit(0))))) - 1
    filled = F.flatten(F.transform(firsts, lambda x, i: F.concat(F.array_repeat(nothing, gap(x, i)), F.array(x))))
    return F.concat(filled, F.array_repeat(nothing, F.lit(BINS - 1) - _bin(F.element_at(firsts, -1))))


def _densified(firsts: Column) -> Column:
    """Every empty bin takes the value of the first full bin in a probing order that belongs to the bin and is the same
    for all documents: some hashed probes, then all bins by the hash of (bin, other bin). So it always ends."""

    orders = [" ".join(str(zlib.crc32(f"{j} {r}".encode()) % BINS) for j in range(BINS)) for r in range(PROBES)]
    probes = [F.split(F.lit(o), " ").cast("array<int>") for o in orders]  # folded to constants

    def fill(dense: Column) -> Column:
        last = lambda j: F.array_min(F.transform(firsts, lambda v: F.struct(F.xxhash64(j, _bin(v)).alias("h"), v.alias("v"))))["v"]
        return F.transform(dense, lambda x, j: F.coalesce(x, *[F.get(dense, F.get(p, j)) for p in probes], last(j)))

    return _let(_dense(firsts), fill)


def packed(text: Column) -> Column:
    """The fingerprint as an array of BINS / PER_LONG longs; empty for a text without words."""
    top = 64 - BINS.bit_length() + 1

    def firsts(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, top) != F.shiftright(F.get(h, F.greatest(i - 1, F.lit(0))), top)))

    def pack(v: Column) -> Column:
        part = lambda w: F.slice(v, w * PER_LONG + 1, PER_LONG)
        longs = F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda w: F.aggregate(part(w), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")))))
        return longs

    def sketch(h: Column) -> Column:
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(_let(firsts(h), lambda f: _let(_densified(f), pack)))

    return _let(F.sort_array(shingle_hashes(text)), sketch)


def as_text(longs: Column) -> Column:
    """The packed bits as hex digits, one for each bin."""
    return F.array_join(F.transform(longs, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity (0 to 1) of two packed fingerprints.

    Bins whose bits agree by chance, one in 2**BITS, are taken off. Two empty ones are alike, an empty one and another are not.
    """
    ones = F.lit(0x1111111111111111).cast("bigint")

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(ones)).cast("long")

    other = F.aggregate(F.zip_with(a, b, differing), F.lit(0).cast("bigint"), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (1 - other / BINS - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(estimate)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) per row of docs; null and empty texts and those without words have the empty fingerprint."""
    return docs.select("doc_id", as_text(packed(F.col("text").cast("string"))).alias("fingerprint"))


def _lower(keys: DataFrame, low: int, high: int) -> DataFrame:
    """(k, lower): for each distinct key the next lower one, the highest for the lowest. No group has over 2**FAN_BITS rows."""
    parent = F.shiftright("k", FAN_BITS)
    top = (high >> FAN_BITS) == (low >> FAN_BITS)
    w = Window.partitionBy(parent).orderBy(F.desc("k"))
    own = keys.withColumn("lower", F.lead("k").over(w))
    if top:
        return own.withColumn("lower", F.coalesce("lower", F.first("k").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    heads = keys.groupBy(parent.alias("parent")).agg(F.max("k").alias("head"))
    up = _lower(heads.select(F.col("parent").alias("k")), low >> FAN_BITS, high >> FAN_BITS)
    after = up.join(heads, up["lower"] == heads["parent"]).select(F.col("k").alias("parent"), "head")
    return own.withColumn("parent", parent).join(after, "parent", "left").select("k", F.coalesce("lower", "head").alias("lower"))


def with_next(rows: DataFrame, text: str, derived: str, derive: Callable[[Column], Column]) -> DataFrame:
    """rows (with a non-null long doc_id), `derived` = derive(text), and a struct `next` of the next row's text and derived.

    Rows follow one another by descending doc_id, those that repeat an id by text; after the last comes the first.
    Ids are put in order in buckets of neighbours, so texts are shuffled once and no task gets all rows; the row after
    a bucket's last is looked up in an order of the buckets alone.
    """
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    first = (low or 0) >> BUCKET_BITS
    bucket = F.coalesce(F.shiftright("doc_id", BUCKET_BITS) - F.lit(first), F.lit(0).cast("long"))  # not nullable: no filter that only one reader of the shuffle has
    w = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), text)
    own = rows.withColumn("bucket", bucket)
    # plain columns, not a struct of them: that would be made before the shuffle and double it
    own = own.withColumns({"__text": F.lead(text).over(w), "last": F.lead("doc_id").over(w).isNull(), "before": F.lag("doc_id").over(w)})
    own = own.withColumn(derived, derive(F.col(text)))
    own = own.withColumn("__derived", F.lead(derived).over(w))
    after, gone = F.struct(F.col("__text").alias(text), F.col("__derived").alias(derived)), ["bucket", "last", "before", "__text", "__derived"]
    if low is None:
        return own.withColumn("next", after).drop(*gone)
    chain = _lower(rows.select(bucket.alias("k")).distinct(), 0, (high >> BUCKET_BITS) - first)
    heads = own.where("before is null").select(F.col("bucket").alias("lower"), F.struct(text, derived).alias("guest"))
    guests = chain.join(heads, "lower").select(F.col("k").alias("bucket"), "guest")
    return own.join(guests, "bucket", "left").withColumn("next", F.when(F.col("last"), F.col("guest")).otherwise(after)).drop("guest", *gone)


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Per row of docs its fingerprint, that of its edited text, and how alike it is to that and to the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by descending doc_id; after the last comes the first, so a document alone is next to itself. Rows that
    repeat a doc_id follow one another by text. Rows without doc_id have an empty next document. Null texts are empty
    ones; equal texts have equal fingerprints. Other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = with_next(own.where("doc_id is not null"), "text", "bits", packed)
    none = F.struct(F.lit("").alias("text"), F.array().cast("array<bigint>").alias("bits"))
    rows = ordered.unionByName(own.where("doc_id is null").withColumn("bits", packed(F.col("text"))).withColumn("next", none))
    n = F.length("text").cast("long")
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next.text, 1, cast(n_chars div 2 as int)))")
    rows = rows.withColumn("n_chars", n).withColumn("edited", edited).withColumn("edited_bits", packed(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("bits")).alias("fingerprint"),
        as_text(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        likeness(F.col("bits"), F.col("next.bits")).alias("near_next"),
    )


def op4_fingerprints(spark, sf_dir):
    """Per document its length, fingerprints of its text and of its edited text, and how alike they and the next document's
    are; null and empty texts have the empty fingerprint, repeated ids follow one another by text. See edit_likeness."""
    from .common import table

    return edit_likeness(table(spark, sf_dir, "documents"))
