"""Secret scans: stated patterns, and character Markov models that tell random strings from ordinary identifiers. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread

#: The stated patterns by kind: the match, and the group and length that it must reach.
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What a pattern's match must hold at least, so that it needn't list what is dropped for its length anyway. A run that
#: is matched greedily to its end is as long from its first character, whether or not shorter runs are matched as well.
LISTED = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Characters of the shortest run that the models learn from, and of the shortest that can be called random.
LEARNED, SHORTEST = 10, 16
RUN = f"[A-Za-z0-9+/_-]{{{LEARNED},}}"
#: Characters of a random string that is drawn for a sample, and distinct strings of a label that the models are fitted
#: on, about: those of the least SHA-256.
DRAWN, SAMPLE = 42, 40_000
#: Summed log-likelihood ratio, in thousandths, from which a run is called random: odds of e**12 against one are made good.
LIMIT = 12_000
#: Characters that a model knows by their code, and what is added to each count.
CODES, PRIOR = 128, 1
#: Elements whose running sums are made in one go.
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(lengths: Column) -> Column:
    """For each of an array of ints, the sum of those before it; by blocks, so that the work grows little faster than
    the array."""
    zero = F.lit(0)

    def running(part: Column, start: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), 1, F.size(part))

    at = F.sequence(zero, F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    block = lambda i: F.slice(lengths, i * BLOCK + 1, BLOCK)
    starts = lambda: running(F.transform(at, lambda i: F.aggregate(block(i), zero, lambda a, x: a + x)), zero)
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(_let(starts(), lambda s: F.flatten(F.transform(at, lambda i: running(block(i), F.get(s, i))))))


def matches(text: Column, pattern: str) -> Column:
    """[(start, end, value)]: the leftmost non-overlapping matches of a pattern, in code points, end exclusive.

    The pieces between matches give their places. A text without a match isn't cut up."""
    found, empty = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(m: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), 1, F.size(m))
        widths = F.transform(m, lambda x: F.length(x))
        # before a match lie the gap right before it, and the gaps and matches before that
        ends = _let(F.zip_with(gaps, widths, lambda a, b: a + b), sums_before)
        starts = F.zip_with(ends, gaps, lambda a, b: a + b)
        return F.transform(F.arrays_zip(starts.alias("s"), m.alias("m")), lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), x["m"].alias("value")))

    return F.when(F.regexp_like(text, F.lit(pattern)), _let(found, placed)).otherwise(empty)


def base_spans(text: Column, kind: str) -> Column:
    """[(start, end, value)] of one of the stated patterns; matches that are too short are dropped."""
    pattern, group, least = PATTERNS[kind]
    if kind in LISTED:
        return matches(text, LISTED[kind])
    return F.filter(matches(text, pattern), lambda x: F.length(F.regexp_extract(x["value"], pattern, group)) >= least)


def _last_before(starts: Column, at: Column) -> Column:
    """How many of an ascending array lie below `at`, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(starts, p + s - 1) < at, p + s).otherwise(p))


def _apart(run: Column, spans: Column, starts: Column) -> Column:
    """Whether a run overlaps none of the ascending spans."""
    return F.when(F.size(starts) == 0, True).otherwise(_let(_last_before(starts, run["end"]), lambda n: (n == 0) | (F.get(spans, n - 1)["end"] <= run["start"])))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, and per row the spans of each stated pattern and the `runs` that overlap none of them.

    All of it is found where the text lies, and is small against it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = own.select("doc_id", *[base_spans(F.col("text"), k).alias(k) for k in PATTERNS], matches(F.col("text"), RUN).alias("runs"))
    starts = {k: F.transform(k, lambda x: x["start"]) for k in PATTERNS}
    own = own.select("*", *[starts[k].alias(f"{k}_starts") for k in PATTERNS])

    def free(run: Column) -> Column:
        out = F.lit(True)
        for k in PATTERNS:
            out = out & _apart(run, F.col(k), F.col(f"{k}_starts"))
        return out

    return own.select("doc_id", *PATTERNS, F.filter("runs", free).alias("runs"))


def samples(found: DataFrame, scratch: Scratch, most: int = SAMPLE) -> DataFrame:
    """(label, value): labelled strings to learn from, about `most` distinct ones that were found of each label.

    Ordinary (0) are the runs that no pattern matches. Random (1) are the values that the patterns match, and for each
    ordinary run of the sample DRAWN characters of its SHA-256 as Base64 and as upper-case hex digits, which stand for
    keys of other alphabets. Each counts once, so that copies of a document weigh nothing; a few secrets among the
    ordinary runs do little to counts of all of them. Beyond the bound, the least SHA-256 values are taken: n strings
    are thinned by most / n.
    """
    pattern, group, _ = PATTERNS["assign"]
    values = F.concat(*[F.transform(k, (lambda x: F.regexp_extract(x["value"], pattern, group)) if k == "assign" else (lambda x: x["value"])) for k in PATTERNS])

    def some(strings: Column, name: str) -> DataFrame:
        every = scratch.keep(name, found.select(F.explode(strings).alias("value")).distinct())
        place = F.conv(F.substring(F.sha2("value", 256), 1, 8), 16, 10).cast("decimal(20,0)")
        return every.where(place * every.count() < most << 32)

    plain, digest = some(F.transform("runs", lambda x: x["value"]), "ordinary"), F.sha2("value", 256)
    drawn = plain.select(F.explode(F.array(F.base64(F.unhex(digest)), F.upper(digest))).alias("value")).select(F.substring("value", 1, DRAWN).alias("value"))
    return plain.select(F.lit(0).alias("label"), "value").unionByName(some(values, "named").unionByName(drawn).select(F.lit(1).alias("label"), "value"))


def learn(labelled: DataFrame) -> list[int]:
    """The log-likelihood ratio of each character pair, in thousandths, at CODES * first + second.

    It is ln P(second | first, random) - ln P(second | first, ordinary) from counts of all labelled strings, each raised
    by PRIOR. Pairs are counted in Spark; at most 2 * CODES ** 2 counts come to the driver.
    """
    at = F.transform(F.split("value", ""), lambda c: F.ascii(c))
    # explode_outer: explode would make the arrays several times for a filter that drops empty ones
    pairs = spread(labelled).select("label", at.alias("at")).select("label", F.explode_outer(F.zip_with(F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at") - 1), lambda a, b: a * CODES + b)).alias("pair"))
    counts = {(r.label, r.pair): r.n for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).where(F.col("pair") < CODES * CODES).collect()}
    return ratios(counts)


def ratios(counts: dict[tuple[int, int], int]) -> list[int]:
    """The thousandths of learn() from counts by (label, pair)."""
    totals = {(label, a): sum(counts.get((label, a * CODES + b), 0) for b in range(CODES)) + PRIOR * CODES for label in (0, 1) for a in range(CODES)}
    share = lambda label, pair: math.log((counts.get((label, pair), 0) + PRIOR) / totals[label, pair // CODES])
    return [math.floor(1000 * (share(1, p) - share(0, p)) + 0.5) for p in range(CODES * CODES)]


def score(value: Column, model: Column) -> Column:
    """The summed thousandths of a run's pairs."""
    at = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    return _let(at, lambda a: F.aggregate(F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), lambda x, y: F.get(model, x * CODES + y)), F.lit(0), lambda s, x: s + x))


def trained(docs: DataFrame) -> list[int]:
    """The model that docs gives, to find secrets in other tables with."""
    scratch = Scratch(docs.sparkSession)
    return learn(samples(scratch.keep("found", scanned(spread(docs))), scratch))


def find_secrets(docs: DataFrame, limit: int = LIMIT, weights: list[int] | None = None) -> DataFrame:
    """doc_id and, per row of docs, the spans [(start, end, value)] `assign`, `access`, `hex` and `random`, each ascending.

    The first three are the stated patterns. `random` are runs of at least SHORTEST identifier characters outside those,
    whose log-likelihood ratio of the random against the ordinary model reaches `limit` thousandths. The models are
    `weights` of trained(), else learned from docs; where nothing is labelled, no run is random. Offsets count code points, ends are exclusive.
    Null texts are empty; repeated rows are scanned each; null ids stay; other columns are ignored; an empty table gives
    an empty one. Texts of any length are scanned whole, in one task each.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep("found", scanned(spread(docs)))
    weights = weights or learn(samples(found, scratch))
    model = F.split(F.lit(" ".join(map(str, weights))), " ").cast("array<int>")  # folded to a constant
    return found.select("doc_id", *PATTERNS, F.filter("runs", lambda x: (F.length(x["value"]) >= SHORTEST) & (score(x["value"], model) >= limit)).alias("random"))


def listed(kinds: dict[str, Column]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""

    def named(spans: Column, kind: str, nth: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(nth).alias("nth"), F.concat_ws(":", F.lit(kind), x["start"], x["end"]).alias("as")))

    rows = [named(c, k, i) for i, (k, c) in enumerate(kinds.items())]
    return F.array_join(F.transform(F.array_sort(F.concat(*rows)), lambda x: x["as"]), ",")


def op11_secret_scan(spark, sf_dir):
    """Per document the number of spans of each stated pattern, a digest of these spans, and all spans with the random
    runs of the models. Rows with null or empty texts have none; see find_secrets."""
    from .common import table

    rows = find_secrets(table(spark, sf_dir, "documents"))
    base = {k: F.col(k) for k in PATTERNS}
    counts = [F.size(c).cast("long").alias(f"n_{k}") for k, c in base.items()]
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(base | {"random": F.col("random")}).alias("spans"))


def _spans(kind: str, pattern: str, keep: str) -> str:
    """SQL: row, start, end and value of a pattern's matches that `keep` holds for."""
    return f"""{kind}_m as (select r, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as p from d),
{kind}_u as (select r, unnest(m) as value, unnest(p[:len(m)]) as gap, generate_subscripts(m, 1) as i from {kind}_m),
{kind}_w as (select r, value, (sum(length(gap) + length(value)) over (partition by r order by i))::bigint as e from {kind}_u),
{kind} as (select r, '{kind}' as kind, e - length(value) as s, e, value from {kind}_w where {keep})"""


def _oracle() -> str:
    quoted = {k: v[0].replace("'", "''") for k, v in PATTERNS.items()}
    codes = "list_transform(string_split(value, ''), lambda c: ascii(c))"
    pairs = "list_transform(range(1, len(a)), lambda i: a[i] * 128 + a[i + 1])"
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
{_spans("assign", quoted["assign"], f"length(regexp_extract(value, '{quoted['assign']}', 1)) >= 6")},
{_spans("access", quoted["access"], "length(value) >= 20")},
{_spans("hex", quoted["hex"], "length(value) >= 24")},
{_spans("run", RUN, "true")},
base as (select *, 0 as nth from assign union all select *, 1 from access union all select *, 2 from hex),
free as (select * from run where not exists (from base where base.r = run.r and base.s < run.e and run.s < base.e)),
known as (select distinct value from free),
plain as (select value from known where ('0x' || sha256(value)[1:8])::hugeint * (select count(*) from known) < {SAMPLE << 32}),
valued as (select distinct case when kind = 'assign' then regexp_extract(value, '{quoted["assign"]}', 1) else value end as value from base),
named as (select value from valued where ('0x' || sha256(value)[1:8])::hugeint * (select count(*) from valued) < {SAMPLE << 32}),
labelled as (
  select 0 as label, value from plain union all select 1, value from named
  union all select 1, base64(unhex(sha256(value)))[:{DRAWN}] from plain union all select 1, upper(sha256(value))[:{DRAWN}] from plain),
pairs as (select label, unnest({pairs}) as pair from (select label, {codes} as a from labelled)),
n as (select label, pair, count(*) as n from pairs where pair < 16384 group by all),
tot as (select label, pair // 128 as a, sum(n) as n from n group by all),
w as (
  select p.pair, floor(1000 * (
    ln((coalesce(n1.n, 0) + 1) / (coalesce(t1.n, 0) + 128)) - ln((coalesce(n0.n, 0) + 1) / (coalesce(t0.n, 0) + 128))) + 0.5)::bigint as w
  from (select distinct unnest({pairs}) as pair from (select {codes} as a from known)) p
  left join n n1 on n1.pair = p.pair and n1.label = 1 left join n n0 on n0.pair = p.pair and n0.label = 0
  left join tot t1 on t1.a = p.pair // 128 and t1.label = 1 left join tot t0 on t0.a = p.pair // 128 and t0.label = 0),
scores as (
  select value, sum(w) as score from (select value, unnest({pairs}) as pair from (select value, {codes} as a from known)) join w using (pair) group by value),
random as (select free.r, 'random' as kind, s, e, value, 3 as nth from free join scores using (value) where score >= {LIMIT} and length(value) >= {SHORTEST}),
b as (
  select r, count(*) filter (nth = 0) as n_assign, count(*) filter (nth = 1) as n_access, count(*) filter (nth = 2) as n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, nth) as t from base group by r),
a as (select r, string_agg(kind || ':' || s || ':' || e, ',' order by s, nth) as t from (from base union all from random) group by r)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(b.t, '')) as base_sha256, coalesce(a.t, '') as spans
from d left join b using (r) left join a using (r)
"""


ORACLE = _oracle()
