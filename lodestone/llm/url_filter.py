"""URL rules looked up in a Bloom filter cascade that is exact over the corpus's own keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, mix

#: (verdict, host, path): the rules of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: About so many bytes of filters are broadcast at once; longer lists are split by a hash of the key into several
#: cascades, looked up in one after another.
BROADCAST_BYTES = 64 << 20


def host_path(url: str | Column = "url") -> tuple[Column, Column]:
    """Host (after the first `://`, A-Z lower-cased) and path; both empty where url is null or has no `://`."""
    c = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(c, pattern, 1)), F.regexp_extract(c, pattern, 2)


def hashes(host: Column, path: Column) -> tuple[Column, Column]:
    return F.xxhash64(host, path), F.xxhash64(F.lit("second"), host, path)


def _place(a: np.ndarray, b: np.ndarray, i: int, salt: int, m: int) -> np.ndarray:
    """The i-th bit of each key. Levels have salts of their own: else keys that collide in one would in all."""
    return (mix(a ^ mix(np.full(1, salt + 1, np.uint64))) + np.uint64(i) * (b | np.uint64(1))) % np.uint64(m)


class Level:
    def __init__(self, bits: np.ndarray, m: int, k: int, salt: int):
        self.bits, self.m, self.k, self.salt = bits, m, k, salt

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for i in range(self.k):
            at = _place(a, b, i, self.salt, self.m)
            out &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _fill(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A filter of n keys: bits are set in the tasks, words are joined by bit_or, and n * log2(1 / rate) bits come back."""
    m = max(64, int(np.ceil(n * np.log2(1 / rate) * 1.45)))
    k = max(1, round(np.log2(1 / rate)))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            a, b = x["a"].to_numpy().view(np.uint64), x["b"].to_numpy().view(np.uint64)
            at = np.concatenate([_place(a, b, i, salt, m) for i in range(k)])
            yield pd.DataFrame({"w": (at >> np.uint64(6)).astype(np.int64), "v": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    rows = keys.select("a", "b").mapInPandas(words, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    bits = np.zeros(m // 64 + 1, np.uint64)
    bits[rows["w"].to_numpy()] = rows["v"].to_numpy().view(np.uint64)
    return Level(bits, m, k, salt)


class Cascade:
    """Levels alternate between listed keys and the false positives of the level before.

    A key of the universe is listed if the first level that lacks it is an odd one (counting from 0: level 0 lacks it
    means it is not listed); passing all levels means listed if their number is odd.
    """

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def __len__(self) -> int:
        return sum(x.bits.nbytes for x in self.levels)

    def __contains__(self, key) -> bool:
        return bool(self.holds(*(np.array([x], np.uint64) for x in key))[0])

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        live = np.arange(len(a))
        for i, level in enumerate(self.levels):
            passed = level.holds(a[live], b[live])
            out[live[~passed]] = i % 2 == 1
            live = live[passed]
        out[live] = len(self.levels) % 2 == 1
        return out


def _first_rate(listed: int, others: int) -> float:
    return min(0.5, listed * 0.5**0.5 / max(1, others))


def shards(listed: int, others: int, most_bytes: int = BROADCAST_BYTES) -> int:
    """Cascades of which each takes about most_bytes at most; all levels take less than three times the first."""
    return int(max(1, listed) * -np.log2(_first_rate(max(1, listed), others)) * 1.45 / 8 * 3 // most_bytes) + 1


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of listed keys (a, b) that is exact on `universe` (a, b).

    The first filter's false positive rate is set by the two counts so that about as many false positives as listed
    keys are left, later filters halve them; its size follows the listed keys, not the universe.
    """
    scratch = Scratch(listed.sparkSession)
    inside = scratch.keep("inside", listed.select("a", "b").distinct())
    outside = scratch.keep("outside", universe.select("a", "b").distinct().join(inside, ["a", "b"], "left_anti"))
    r, s = inside.count(), outside.count()
    levels: list[Level] = []
    ours, theirs, n = inside, outside, r
    names, spare = ["inside", "outside"], 0
    while n:
        level = _fill(ours, n, _first_rate(r, s) if not levels else 0.5, len(levels))
        levels.append(level)
        if len(levels) > 200:
            raise RuntimeError("the cascade does not end; two keys share both hashes")
        sent = listed.sparkSession.sparkContext.broadcast(level)
        spare += 1
        ours, theirs = scratch.keep(f"level {spare}", theirs.where(_passes(sent)("a", "b"))), ours
        names.append(f"level {spare}")
        n = ours.count()
    scratch.drop(*names)
    return Cascade(levels)


def _passes(sent):
    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(sent.value.holds(a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64)))

    return passes


def _members(sent):
    """A flag for each key of an array of keys."""

    @F.pandas_udf("array<boolean>")
    def members(a: pd.Series, b: pd.Series) -> pd.Series:
        ends = np.cumsum([len(x) for x in a])
        if not len(ends):
            return pd.Series([], dtype=object)
        flags = sent.value.holds(*(np.concatenate(list(x)).astype(np.int64).view(np.uint64) for x in (a, b)))
        return pd.Series(np.split(flags, ends[:-1]))

    return members


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", default: str = "allow", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page row: key, host, path, rule, verdict.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with the rule's path; the longest
    that fits wins (by host and path together), and where none does the verdict is `default`. The keys of a page are
    the suffixes of its host with as many labels as some rule's host, each with the beginnings of its path that are as
    long as some rule's path; membership of each is decided by one cascade per verdict (several, for lists that take
    more than most_bytes), built from the rules and exact over the keys of all pages, without a join. A key that is
    both allowed and blocked is allowed. Null urls or urls without `://` have empty host and path and no rule. Repeated
    rows are judged each. Empty tables give an empty result; other columns are ignored.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    rules = rules.select(F.col("verdict"), ascii_lower(F.col("host")).alias("h"), F.col("path").alias("p")).dropna()
    dots = lambda host: F.split(host, r"\.", -1)
    lengths, depths = (sorted(r[0] for r in rules.select(c).distinct().collect()) for c in (F.length("p"), F.size(dots("h"))))  # at most as many as a path is long or a host deep
    host, path = host_path()
    own = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    strings = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull()) if xs else F.array().cast("array<string>")
    labels = dots("host")
    suffixes = strings([F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.size(labels) - (n - 1), n), ".")) for n in depths])
    starts = strings([F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    pairs = F.flatten(F.transform("suffixes", lambda h: F.transform("starts", lambda p: F.struct(h.alias("h"), p.alias("p"), *(x.alias(n) for x, n in zip(hashes(h, p), "ab", strict=True))))))
    own = own.withColumns({"suffixes": suffixes, "starts": starts}).withColumn("keys", pairs).drop("suffixes", "starts")
    universe = scratch.keep("universe", own.select(F.explode("keys").alias("x")).select("x.a", "x.b").distinct())
    others = universe.count()
    a, b = hashes(F.col("h"), F.col("p"))
    listed = scratch.keep("listed", rules.select("verdict", a.alias("a"), b.alias("b")).distinct())
    sizes = {v: listed.where(F.col("verdict") == v).count() for v in ("allow", "block")}
    n = {v: shards(r, others, most_bytes) if r else 0 for v, r in sizes.items()}  # an empty list needs no filter
    marked = own.withColumns({v: F.transform("keys", lambda x: F.lit(False)) for v in n})
    for v in n:
        for k in range(n[v]):
            mine = lambda x: F.pmod(F.shiftrightunsigned(x, 40), F.lit(n[v])) == k  # noqa: B023, E731
            cascade = build(listed.where((F.col("verdict") == v) & mine(F.col("a"))), universe.where(mine(F.col("a"))))
            found = _members(spark.sparkContext.broadcast(cascade))(F.col("keys.a"), F.col("keys.b"))
            # keys of other parts may pass by chance: a cascade is exact on its own part alone
            flags = F.zip_with(F.zip_with(F.col("keys"), F.col("found"), lambda x, f: f & mine(x["a"])), F.col(v), lambda x, y: x | y)
            marked = marked.withColumn("found", found).withColumn(v, flags).drop("found")
            if sum(n.values()) > 2:
                marked = scratch.keep("marked", marked)
    scratch.drop("universe", "listed")
    found = F.filter(
        F.zip_with(
            F.col("keys"),
            F.arrays_zip("allow", "block"),
            lambda x, f: F.when(f["allow"] | f["block"], F.struct((F.length(x["h"]) + F.length(x["p"])).alias("n"), F.concat(x["h"], x["p"]).alias("rule"), F.when(f["allow"], "allow").otherwise("block").alias("verdict"))),
        ),
        lambda x: x.isNotNull(),
    )
    return _named(marked.withColumn("best", F.array_max(found)), key, default)


def _named(best: DataFrame, key: str, default: str) -> DataFrame:
    verdict = F.coalesce("best.verdict", F.lit(default))
    return best.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def op8_url_filter(spark, sf_dir):
    """page_id, host, path, rule and verdict per row of `pages`; null urls have empty parts and no rule."""
    from .common import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, RULES))


ORACLE = r"""
with p as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages),
r as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from p)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from r
"""
