"""Near-duplicate groups by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M2, Scratch, hash_words, mix, pieces, shingle_hashes, small_batches
from .components import components

#: Coordinates of a sketch; bands of ROWS of them. Two sets with Jaccard 0.75 share a band with 1 - (1 - 0.75**4)**32,
#: that is all but 6 in a million.
T, ROWS = 128, 4
SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def fast_similarity_sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """One row of t coordinates per non-empty set of 64-bit hashes.

    Round i < t throws every element into a bin chosen by that round's hash, later rounds place it in bin i - t; a
    coordinate keeps the smallest (round, hash) that falls into it. A set is done after the first round that leaves no
    bin empty, which the last t rounds guarantee, so sketches of similar sets agree coordinate by coordinate with the
    sets' Jaccard similarity and its concentration.
    """
    out = np.full((len(sets), t), np.iinfo(np.uint64).max, np.uint64)
    live = np.arange(len(sets))
    for i in range(2 * t):
        if not len(live):
            break
        x = np.concatenate([sets[k] for k in live])
        row = np.repeat(live, [len(sets[k]) for k in live])
        h = mix(x ^ mix(np.full(1, i + 1, np.uint64)))
        bins = (h & np.uint64(t - 1)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out, (row, bins), (np.uint64(i) << np.uint64(55)) | (h >> np.uint64(9)))
        live = live[(out[live] == np.iinfo(np.uint64).max).any(axis=1)]
    return out


def band_keys(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, t = sketches.shape
    parts = sketches.reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(1, t // rows + 1, dtype=np.uint64), (n, t // rows)).copy()
    for j in range(rows):
        key = mix(key * M2 + parts[:, :, j])
    return key


def _sets(texts: list[bytes | None]) -> list[np.ndarray]:
    return [shingle_hashes(hash_words(x or b"")) for x in texts]


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        sets = _sets(b.column(1).cast(pa.large_binary()).to_pylist())
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        keys = np.empty((0, T // ROWS), np.uint64)
        digests = np.zeros((2, len(sets)), np.uint64)
        if len(full):
            own = [sets[i] for i in full]
            keys = band_keys(fast_similarity_sketches(own))
            cuts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            every = np.concatenate(own)
            for k in range(2):
                digests[k, full] = np.add.reduceat(mix(every ^ np.uint64(0xA5A5 + k)), cuts)
        offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, T // ROWS, 0)))).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(sizes), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), bands],
            names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
        )


def _linked(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, ta, b, tb) with texts in columns 4 and 5 whose whole shingle sets reach the similarity; a set that
    recurs is cut up once."""
    for b in batches:
        sets: dict[tuple, np.ndarray] = {}
        keep = []
        cols = b.columns
        for i in range(b.num_rows):
            pair = []
            for who, tag, text in ((0, 1, 4), (2, 3, 5)):
                k = (cols[who][i].as_py(), cols[tag][i].as_py())
                if k not in sets:
                    if len(sets) > 2000:
                        sets.clear()
                    sets[k] = shingle_hashes(hash_words(cols[text][i].as_buffer().to_pybytes()))
                pair.append(sets[k])
            same = len(np.intersect1d(*pair, assume_unique=True))
            keep.append(100 * same >= percent * (len(pair[0]) + len(pair[1]) - same))
        yield pa.RecordBatch.from_arrays(cols[:4], names=["a", "ta", "b", "tb"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """b's texts come first, so that the join with the few a's, which may have very many pairs, is one that adaptive
    execution can split."""
    one, other = (texts.select(F.col("id").alias(s), F.col("tag").alias(f"t{s}"), F.col("text").alias(f"text_{s}")) for s in "ab")
    both = pairs.join(other, ["b", "tb"]).join(one, ["a", "ta"]).select("a", "ta", "b", "tb", "text_a", "text_b")
    return both.mapInArrow(lambda it: _linked(it, percent), "a long, ta long, b long, tb long")


def _tagged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tag, text): each text with the digest of its set, which tells the rows of one id apart."""
    for b in pieces(batches):
        sets = _sets(b.column(1).cast(pa.large_binary()).to_pylist())
        tags = np.array([np.add.reduce(mix(x ^ np.uint64(0xA5A5))) if len(x) else 0 for x in sets], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tags.view(np.int64)), b.column(1)], names=["id", "tag", "text"])


#: Slots of the table that says how common a shingle is; two shingles of one slot look as common as both.
SLOTS = 1 << 20


def _slot_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        x = np.concatenate([np.empty(0, np.uint64), *_sets(b.column(b.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist())])
        slots, n = np.unique(x & np.uint64(SLOTS - 1), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slots.view(np.int64)), pa.array(n)], names=["slot", "n"])


def _need(a: str, b: str, percent: int) -> str:
    """SQL: the shingles that sets of sizes a and b share at least if they are as similar as percent says."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


def _prefixes(crowd: DataFrame, percent: int) -> DataFrame:
    """(key, place, shared) and the columns of crowd but its text: of every document the shingles that any partner must
    share one of, rarest first by one order for all.

    Of n shingles a partner shares ceil(percent * n / 100) or more, so one of the first n - that + 1. `shared` counts
    those that may occur in a second document; a shingle that can't is left out, but keeps its place. A passage that
    everyone quotes comes last in the order.
    """
    counted = crowd.mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(SLOTS, np.int64)  # at most SLOTS numbers, whatever the crowd's size
    common[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    sent = crowd.sparkSession.sparkContext.broadcast(common)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, most=1_000_000):
            at = b.schema.get_field_index("text")
            keys, places, shared = [], [], []
            for x in _sets(b.column(at).cast(pa.large_binary()).to_pylist()):
                often = sent.value[(x & np.uint64(SLOTS - 1)).astype(np.int64)]
                order = np.lexsort((x, often))[: len(x) - -(-percent * len(x) // 100) + 1]
                rare = often[order] > 1
                keys.append(x[order][rare].view(np.int64))
                places.append(np.flatnonzero(rare) + 1)
                shared.append(int((often > 1).sum()))
            rows = np.repeat(np.arange(b.num_rows), [len(k) for k in keys])
            rest = b.select([c for c in b.schema.names if c != "text"]).take(pa.array(rows))
            more = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (keys, places)] + [np.array(shared, np.int64)[rows]]
            yield pa.RecordBatch.from_arrays([*rest.columns, *map(pa.array, more)], names=[*rest.schema.names, "key", "place", "shared"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in crowd.schema.fields if f.name != "text")
    return crowd.mapInArrow(emit, f"{kinds}, key long, place long, shared long")


def _exact(crowd: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, ta, b, tb) of the crowd (id, tag, n, root, asks, text), in different components and with a member that
    asks, among which is every such pair that reaches the similarity.

    Two documents meet under a shingle that both have early enough for the other's size. The bound is first applied
    with the least size under the shingle, then, for what is left, by classes of sizes a hundredth wide, and then pair
    by pair. So a document that differs from the rest of its group in too much never meets them under the group's
    common text: it is compared only with those that share a rarer shingle with it.
    """
    rows = scratch.keep("prefixes", _prefixes(crowd, percent))
    least = rows.groupBy("key").agg(F.min("n").alias("low"), F.min(F.when(F.col("asks"), F.col("n"))).alias("low_asks"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    fits = lambda low: F.expr(f"place <= n - {_need('n', f'greatest({low}, ({percent} * n + 99) div 100)', percent)} + 1")
    kept = rows.join(least.where("low_asks is not null and r0 < r1").select("key", "low", "low_asks"), "key")
    kept = kept.withColumns({"asks": F.col("asks") & fits("low"), "told": fits("low_asks")}).where("asks or told").drop("low", "low_asks")
    kept = scratch.keep("kept", kept)
    scratch.drop("prefixes")
    sizes = kept.groupBy("key").agg(F.min(F.when(F.col("told"), F.col("n"))).alias("low"), F.max(F.when(F.col("told"), F.col("n"))).alias("high"))
    size_class = lambda n: f"cast(floor(ln({n}) * 100) as int)"
    # the largest partner for which this place is early enough, by the bound's slope
    largest = f"least(high, (100 * n) div {percent}, (({100 + percent} * (n + 1 - place)) div {percent}) - n)"
    smallest = f"greatest(low, ({percent} * n + 99) div 100)"
    own = kept.where("asks").join(sizes.where("low is not null"), "key").withColumns({"most": F.expr(largest), "least": F.expr(smallest)}).where("least <= most")
    own = own.withColumn("size", F.explode(F.expr(f"sequence({size_class('least')}, {size_class('most')})")))
    own = own.select("key", "size", *[F.col(c).alias(f"{c}_a") for c in ("id", "tag", "n", "root", "place", "shared", "most")])
    told = kept.where("told").withColumn("size", F.expr(size_class("n")))
    told = told.select("key", "size", *[F.col(c).alias(f"{c}_b") for c in ("id", "tag", "n", "root", "place", "shared")])
    need = _need("n_a", "n_b", percent)
    near = F.expr(f"root_a <> root_b and n_b <= most_a and {need} <= least(shared_a, shared_b) and place_a <= n_a - {need} + 1 and place_b <= n_b - {need} + 1")
    met = own.join(told, (own["key"] == told["key"]) & (own["size"] == told["size"]) & near)
    return _ordered(met, ("id_a", "tag_a"), ("id_b", "tag_b")).distinct()


def _ordered(pairs: DataFrame, one: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """(a, ta, b, tb) with the smaller (id, tag) first."""
    x, y = (F.struct(F.col(i).alias("i"), F.col(t).alias("t")) for i, t in (one, other))
    both = pairs.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    return both.select(F.col("x.i").alias("a"), F.col("x.t").alias("ta"), F.col("y.i").alias("b"), F.col("y.t").alias("tb"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per doc_id: n_shingles, component_id, kept.

    Documents are linked when their sets of distinct five-word shingles have 100 * |A & B| >= percent * |A | B|; the
    component is named by its smallest doc_id and keeps that document.

    Copies with equal sets fall together first, by a 128-bit digest of the set, and one of each such class goes on. Its
    bands meet others' in buckets. In each round the members of a bucket are checked, on whole texts, against one of
    them: first the one that meets the most others, later one drawn from the largest component; that one then leaves
    the bucket, and buckets that hold a single component are done. Rounds go on as long as each shortens the buckets by
    three tenths. Where they end, documents that are still in different components meet under rare shingles by exact bounds
    (_exact). So no link is lost, and no group is expanded into all its pairs unless its documents can't be told apart
    by those bounds though they aren't linked: many texts that differ from each other, but from no common text, in
    just over what the similarity allows.

    Null, empty and wordless texts have n_shingles 0 and are linked with nothing. Rows that repeat a doc_id count as
    one document that has the links of all of them (its largest set size is shown); rows without doc_id stay unlinked,
    with a null component, and are kept. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = scratch.keep("sketched", docs.mapInArrow(_sketch, SKETCH))
    linkable = sketched.where("n_shingles > 0 and doc_id is not null")
    by_set = linkable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.keep("classes", by_set)
    named = sketched.select("doc_id", "n_shingles", "set_a", "set_b").join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"], "left")
    named = scratch.keep("named", named.select("doc_id", "n_shingles", "rep"))
    scratch.drop("sketched")

    placed = classes.select(F.col("rep").alias("id"), F.col("set_a").alias("tag"), "n", F.explode("bands").alias("key"))
    met = placed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    members = scratch.keep("members", placed.join(met, "key"))
    scratch.drop("classes")
    ids = members.select("id", "tag").distinct()
    texts = docs.where("text is not null").withColumnRenamed("doc_id", "id").join(ids.select("id").distinct(), "id", "left_semi")
    texts = texts.mapInArrow(_tagged, "id long, tag long, text string").join(ids, ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"])
    texts = scratch.keep("texts", texts)

    weights = members.groupBy("id", "tag").agg(F.sum("many").alias("weight"))
    own = members.drop("many").join(weights, ["id", "tag"]).withColumns({"root": F.col("id"), "lead": F.lit(None).cast("long")})
    own, before = scratch.keep("open", own), members.count()
    scratch.drop("members")
    # rows that repeat an id hold the classes that they are in together
    several = named.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).where("r0 < r1").select("doc_id")
    links = named.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links, scratch=scratch, name="found 0")
    tried = scratch.keep("tried", spark.createDataFrame([], "a long, ta long, b long, tb long"))
    for turn in count():
        order = F.col("weight") if not turn else F.xxhash64("id", "tag", F.lit(turn))
        head = own.groupBy("key").agg(F.max(F.struct((F.col("root") == F.col("lead")).alias("same"), order.alias("order"), (-F.col("id")).alias("low"), "id", "tag", "n", "root")).alias("h"))
        head = head.select("key", *[F.col(f"h.{c}").alias(f"{c}_h") for c in ("id", "tag", "n", "root")])
        rest = scratch.keep("rest", own.join(head, "key").where("not (id = id_h and tag = tag_h)"))
        can = f"root <> root_h and {100} * least(n, n_h) >= {percent} * greatest(n, n_h)"
        pairs = rest.where(can).select(F.col("id_h").alias("a"), F.col("tag_h").alias("ta"), F.col("id").alias("b"), F.col("tag").alias("tb")).distinct()
        again = _ordered(tried, ("b", "tb"), ("a", "ta"))
        back = again.select(F.col("b").alias("a"), F.col("tb").alias("ta"), F.col("a").alias("b"), F.col("ta").alias("tb"))
        pairs = scratch.keep("pairs", pairs.join(again.unionByName(back), ["a", "ta", "b", "tb"], "left_anti") if turn else pairs)
        links = _verify(pairs, texts, percent).select("a", "b").unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        found = components(links, scratch=scratch, name=f"found {turn + 1}")
        scratch.drop(f"found {turn}")
        tried = scratch.keep("tried", tried.unionByName(_ordered(pairs, ("a", "ta"), ("b", "tb"))))
        roots = found.withColumnRenamed("root", "now")
        own = rest.drop("root", "lead").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("now", "id")).drop("now")
        own = own.join(roots.withColumnRenamed("node", "root_h"), "root_h", "left").withColumn("lead", F.coalesce("now", "root_h")).select("key", "id", "tag", "n", "weight", "root", "lead")
        still = own.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
        own = scratch.keep("open", own.join(still, "key", "left_semi"))
        left = own.count()
        if not left or left > 0.7 * before:
            break
        before = left
    scratch.drop("rest", "pairs")
    if left:
        lead = own.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("root") == F.col("lead"), F.col("lead"))), F.min("root")).alias("most"))
        asks = own.join(lead, "key").groupBy("id", "tag", "n", "root").agg(F.max(F.col("root") != F.col("most")).alias("asks"))
        crowd = scratch.keep("crowd", texts.join(asks, ["id", "tag"]))
        pairs = scratch.keep("pairs", _exact(crowd, percent, scratch).join(tried, ["a", "ta", "b", "tb"], "left_anti"))
        scratch.drop("crowd", "kept", "open", "tried")
        links = _verify(pairs, texts, percent).select("a", "b").unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        found = components(links, scratch=scratch, name="found")
    scratch.drop("texts", "open", "tried", "pairs")

    roots = named.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    known = (
        roots.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("n_shingles").alias("n_shingles"), F.min("root").alias("root"))
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    )
    nameless = named.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs whose document near_duplicates() keeps; columns as they are. Rows without doc_id stay."""
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op7_minhash_near_dedup(spark, sf_dir):
    """Per document the number of its shingles, the least doc_id that it is linked with, and whether that is its own.
    Texts without words are linked with nothing; rows that repeat a doc_id count as one document of all their shingles'
    links; rows without doc_id are in no group."""
    from .common import spread, table

    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: Every pair of documents that shares a shingle, compared on whole sets; for small tables.
ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end) as sh
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select x.doc_id as a, y.doc_id as b, count(*) as common
  from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by 1, 2),
e as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * common >= 75 * (na.n + nb.n - common)),
r as (
  select doc_id as node, doc_id as root from documents
  union
  select e.b, r.root from r join e on e.a = r.node where r.root < e.b),
c as (select node, min(root) as root from r group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.root as component_id, d.doc_id = c.root as kept
from documents d left join n using (doc_id) join c on c.node = d.doc_id
"""
