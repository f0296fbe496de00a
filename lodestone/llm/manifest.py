"""Merkle manifest of a dataset: trees over groups and one over their roots, reduced by superblocks, with a proof per row."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bucket_of

#: Children of a node, and levels that one superblock collapses: it holds at most FANOUT ** LEVELS nodes.
FANOUT, LEVELS = 2, 10
#: Rows of a table of runs or block proofs that is still sent to all tasks (each has under 4 KB); beyond that it is joined by a shuffle.
SENT = 10_000
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its length in UTF-8 bytes, a colon, itself; a dash for null."""
    own = value.cast("string")
    return F.when(own.isNull(), "-").otherwise(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _with(rows: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join; `few` goes to all tasks only if it has been counted to be small."""
    return rows.join(F.broadcast(few) if few.count() <= SENT else few, list(keys))


def numbered(rows: DataFrame, order: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with `idx`, their place from 0 in their group `grp` by `order`, and `n`, the rows of the group.

    A range sort over all rows deals a group of any size out to many tasks. Each task numbers its rows; only the counts
    per task and group are summed up in order. rows must be a written table, as the sort reads it twice.
    """
    keys = ["grp", *order]
    at = F.monotonically_increasing_id()
    own = scratch.keep(name, rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", at)).withColumn("part", F.shiftright("at", 33))
    runs = own.groupBy("grp", "part").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = scratch.keep(f"{name}-runs", runs.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("n")))
    return _with(own, runs, ["grp", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def levels_of(n: int, fanout: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapse(digests: Sequence[str], levels: int, fanout: int) -> tuple[str, list[list[str]], list[list[str]]]:
    """What is left of a block of consecutive nodes after `levels` levels, and per node and level its run's other
    digests on its left and on its right. A last run may be short, down to one node."""
    lefts, rights = [[] for _ in digests], [[] for _ in digests]
    nodes, width = list(digests), 1
    for _ in range(levels):
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        left = ["".join(r[:j]) for r in runs for j in range(len(r))]
        right = ["".join(r[j + 1 :]) for r in runs for j in range(len(r))]
        for i in range(len(digests)):
            lefts[i].append(left[i // width])
            rights[i].append(right[i // width])
        nodes = [hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
        width *= fanout
    return nodes[0], lefts, rights


def _blocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes (grp, idx, n, h, carried) with their block, its root after at most `levels` levels, and their proof up to it."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        root, lefts, rights = collapse(list(block["h"]), min(levels, levels_of(int(block["n"].iloc[0]), fanout)), fanout)
        return block.assign(top=root, lefts=lefts, rights=rights)

    schema = "grp string, block long, idx long, n long, h string, carried string, top string, lefts array<string>, rights array<string>"
    own = nodes.select("grp", F.expr(f"idx div {fanout**levels}").alias("block"), "idx", "n", "h", "carried")
    return own.groupBy("grp", "block").applyInPandas(run, schema)


def reduced(nodes: DataFrame, scratch: Scratch, name: str, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(grp, root) of each group, and nodes with `block`, `lefts`, `rights` and, from above their block, `up_lefts` and `up_rights`.

    nodes has grp, idx, n, h and carried. A block of fanout ** levels consecutive nodes collapses in one task; the block
    roots of a group are the nodes of the next round, so n nodes take log(n) / log(block) rounds. Each round is written
    once and read for both its roots and its proofs.
    """
    size, rounds = fanout**levels, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        done = scratch.keep(f"{name}-{len(rounds)}", _blocks(nodes, fanout, levels))
        rounds.append(done)
        heads = done.where(F.col("idx") == F.col("block") * size).select("grp", F.col("block").alias("idx"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("h"), F.lit(None).cast("string").alias("carried"))
        if most <= size:
            break
        most, nodes = -(-most // size), heads
    none = F.array().cast("array<string>")
    above = heads.select("grp", F.col("idx").alias("block"), none.alias("up_lefts"), none.alias("up_rights"))
    for done in reversed(rounds[1:]):
        own = _with(done, above, ["grp", "block"])
        above = own.select("grp", F.col("idx").alias("block"), F.concat("lefts", "up_lefts").alias("up_lefts"), F.concat("rights", "up_rights").alias("up_rights"))
    return heads.select("grp", F.col("h").alias("root")), _with(rounds[0], above, ["grp", "block"])


def fold(start: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(F.zip_with(lefts, rights, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), start, lambda h, x: F.sha2(F.concat(x["a"], h, x["b"]), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """One digest of all siblings, level by level and from left to right; that of nothing if there are none."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)


def manifest(docs: DataFrame, columns: Sequence[str] = LEAF, group: str = "lang", key: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS, tampered: Column | None = None) -> DataFrame:
    """Per row of docs: key, leaf, subroot, root, lefts, rights and tampered.

    The leaf digests `columns`. Within a group, rows go by key (null first) and then by leaf; fully equal rows are
    leaves of their own. Subroots, the null group first and the others by their bytes, make the root. lefts and rights
    hold the digests beside a row's node on each level, up to the root. `tampered` is another column that is kept along,
    such as a changed leaf. Columns that aren't named are ignored; an empty table gives an empty manifest. Texts are
    digested where they lie: only digests and keys are shuffled, at most fanout ** levels of them to a task at once.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("grp"),  # null first
        F.col(key).cast("long").alias("key"),
        leaf([F.col(c) for c in columns]).alias("h"),
        (F.lit(None) if tampered is None else tampered).cast("string").alias("changed"),
        F.monotonically_increasing_id().alias("salt"),  # equal rows can be dealt out to several tasks
    )
    leaves = scratch.keep("leaves", own)
    # pandas would turn a null key into a float
    carried = F.concat_ws(",", F.coalesce(F.col("key").cast("string"), F.lit("-")), "changed")
    nodes = numbered(leaves, ["key", "h", "salt"], scratch, "order").select("grp", "idx", "n", "h", carried.alias("carried"))
    subroots, below = reduced(nodes, scratch, "tree", fanout, levels)
    groups = scratch.keep("groups", subroots.select(F.lit("").alias("grp"), F.col("grp").alias("carried"), F.col("root").alias("h")))
    roots, above = reduced(numbered(groups, ["carried"], scratch, "group-order"), scratch, "top", fanout, levels)
    top = above.join(roots, "grp").select(F.col("carried").alias("grp"), F.col("h").alias("subroot"), "root", F.concat("lefts", "up_lefts").alias("top_lefts"), F.concat("rights", "up_rights").alias("top_rights"))
    parts = F.split("carried", ",")
    return _with(below, top, ["grp"]).select(
        F.when(parts[0] != "-", parts[0].cast("long")).alias(key),
        F.col("h").alias("leaf"),
        "subroot",
        "root",
        F.concat("lefts", "up_lefts", "top_lefts").alias("lefts"),
        F.concat("rights", "up_rights", "top_rights").alias("rights"),
        F.get(parts, F.lit(1)).alias("tampered"),
    )


def op12_merkle_manifest(spark, sf_dir):
    """Per document its leaf, its group's root, the root, a digest of its proof, and whether the proof holds after some
    rows' n_chars were tampered with. Null ids are never tampered with; see manifest for ties and nulls."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    values = [F.col("n_chars").cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in LEAF]
    rows = manifest(docs, tampered=F.when(bucket_of("doc_id", 7) == 0, leaf(values)))
    rows = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("lefts"), F.col("rights")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("lefts"), F.col("rights")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _crc32(text: str) -> str:
    """SQL for the crc32 of an ASCII string: a byte at a time, with one conditional xor a bit."""
    value = "xor(c, b)"
    for _ in range(8):
        value = f"list_transform([{value}], lambda r: case when r % 2 = 1 then xor(r // 2, 3988292384::bigint) else r // 2 end)[1]"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), lambda c, b: {value}), 4294967295::bigint)"


ORACLE = f"""
with recursive f as (
  select doc_id, lang, doc_id is not null and {_crc32("doc_id::varchar")} % 7 = 0 as hit,
    coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') ||
      coalesce(octet_length(encode(lang)) || ':' || lang, '-') as a,
    coalesce(length(n_chars::varchar) || ':' || n_chars, '-') as b,
    coalesce(length((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') as b1,
    coalesce(octet_length(encode(text)) || ':' || text, '-') as c from documents),
l as (select doc_id, lang, sha256(a || b || c) as leaf, sha256(a || case when hit then b1 else b end || c) as given from f),
g as (select lang, row_number() over (order by lang nulls first) - 1 as g from (select distinct lang from l)),
r as (
  select doc_id, leaf, given, g.g, row_number() over (partition by g.g order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by g.g) as n
  from l join g on l.lang is not distinct from g.lang),
t as (
  select g, 0 as lvl, idx, leaf as h, n from r
  union all
  select g, lvl + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (max(n) + 1) // 2 from t where n > 1 group by g, lvl, idx // 2),
s as (select g, lvl as height, h as subroot from t where n = 1),
u as (
  select 0 as lvl, g as idx, subroot as h, count(*) over () as n from s
  union all
  select lvl + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (max(n) + 1) // 2 from u where n > 1 group by lvl, idx // 2),
w as (select h as root, lvl as height from u where n = 1),
q as (
  select r.g, r.idx, x.lvl, coalesce(t.idx % 2 = 0, false) as is_left, coalesce(t.h, '') as h
  from (select g, idx, unnest(range(height)) as lvl from r join s using (g)) x join r using (g, idx)
  left join t on t.g = x.g and t.lvl = x.lvl and t.idx = xor(x.idx // (1 << x.lvl::int), 1)
  union all
  select r.g, r.idx, s.height + x.lvl, coalesce(u.idx % 2 = 0, false), coalesce(u.h, '')
  from (select s.g, unnest(range(w.height)) as lvl from s cross join w) x join r using (g) join s using (g)
  left join u on u.lvl = x.lvl and u.idx = xor(x.g // (1 << x.lvl::int), 1)),
p as (select g, idx, string_agg(h, '' order by lvl) as proof, list(case when is_left then 'L' else 'R' end || h order by lvl) as steps from q group by g, idx),
o as (
  select r.doc_id, r.leaf, s.subroot, w.root, sha256(coalesce(proof, '')) as proof_sha256,
    list_reduce(list_prepend(given, coalesce(steps, [])), lambda a, x: sha256(case when x[1] = 'L' then x[2:] || a else a || x[2:] end)) as folded_root
  from r join s using (g) cross join w left join p on p.g = r.g and p.idx = r.idx)
select *, folded_root = root as verified from o
"""
