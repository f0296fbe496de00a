"""The query over sentence boundaries and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sentences
from .retrieval import read, spread


def sentence_boundaries(spark, d):
    """Sentences of each document by what the whole table teaches."""
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    own = sentences.split_rows(docs.withColumn("text", F.coalesce("text", F.lit(""))), sentences.learned(docs))
    return own.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.sha2(F.array_join("s", "|"), 256).alias("sentences_sha256"))


QUERIES = {"sentence_boundaries": sentence_boundaries}

_BARE = r"regexp_replace(lower({}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g')"
_BASE = r"regexp_replace({}, '\.$', '')"
SQL = {
    "sentence_boundaries": rf"""with d as (select row_number() over () as r, doc_id, replace(coalesce(text, ''), chr(1), ' ') as text from documents),
l as (select r, doc_id, regexp_extract_all(text, '\s*\S+') as ps from d),
t as (select r, doc_id, unnest(ps) as part, unnest(range(len(ps))) as i from l),
w as (select *, {_BARE.format("trim(part, e' \n\t\r\f')")} as b from t),
x as (select *, case when regexp_matches(b, '\p{{L}}') then b else '' end as word, lead(case when regexp_matches(b, '\p{{L}}') then b else '' end) over (partition by r order by i) as next,
  lead(part) over (partition by r order by i) as after, {_BASE.format("b")} as k from w),
tot as (select count(*) as n, count(*) filter (word like '%.') as dots from x),
c as (select {_BASE.format("word")} as word, count(*) as n, count(*) filter (word like '%.') as dots from x where word <> '' group by 1),
a0 as (
  select c.word, length(c.word) - length(replace(c.word, '.', '')) as inn, length(replace(c.word, '.', '')) as size, c.n - c.dots as rest,
    2 * (c.dots * ln(0.99) + (c.n - c.dots) * ln(1 - 0.99) - c.dots * ln(least(tot.dots / tot.n, 1 - 1e-9)) - (c.n - c.dots) * ln(1 - least(tot.dots / tot.n, 1 - 1e-9))) as ratio
  from c, tot where c.dots > 0 and c.word <> ''),
a as (select word from (select word, ratio * exp(-size) * (inn + 1) * pow(size, -rest) as score from a0) where score >= 0.3),
aa as (select word from a0 where ratio * exp(-size) * (inn + 1) * pow(size, -rest) >= 0.3),
e as (select * from x where word like '%.' and k not in (select word from aa)),
br as (select count(*) as b from e),
s0 as (select {_BASE.format("next")} as word, count(*) as "at" from e where next <> '' group by 1),
s1 as (
  select word, c.n, "at", b, tot.n as total, greatest(1e-9, least(1 - 1e-9, c.n / tot.n)) as p, greatest(1e-9, least(1 - 1e-9, "at" / b)) as p1,
    greatest(1e-9, least(1 - 1e-9, (c.n - "at") / greatest(tot.n - b, 1))) as p2 from s0 join c using (word), tot, br where "at" / b > c.n / tot.n),
s as (select word from (
  select word, 2 * ("at" * ln(p1) + (b - "at") * ln(1 - p1) + (n - "at") * ln(p2) + (total - b - n + "at") * ln(1 - p2)
    - "at" * ln(p) - (b - "at") * ln(1 - p) - (n - "at") * ln(p) - (total - b - n + "at") * ln(1 - p)) as score from s1) where score >= 30),
z as (
  select r, i, part, regexp_extract(part, '([.!?])["''»”’)\]]*$', 1) as mark, k in (select word from a)
    and not (regexp_matches(coalesce(after, ''), '^\s*[^\p{{L}}\p{{N}}]*\p{{Lu}}') and coalesce(lead(k) over (partition by r order by i), '') in (select word from s)) as goes_on from x),
y as (select r, string_agg(part || case when mark <> '' and not (mark = '.' and goes_on) then chr(1) else '' end, '' order by i) as t from z group by 1),
q as (select d.doc_id, list_filter(string_split(coalesce(t, ''), chr(1)), lambda v: v <> '') as s from d left join y using (r))
select doc_id, len(s) as n_sentences, sha256(array_to_string(s, '|')) as sentences_sha256 from q""",
}
