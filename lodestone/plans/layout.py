"""Queries over page blocks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages
from .retrieval import read


def _page_blocks(spark, d):
    """Lines of documents as blocks on pages of 40 in two columns, under a head and over a page number; and a table on
    every other page, over two blocks of the left column."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    k, page = F.col("i") % 40, (F.floor(F.col("i") / 40) + 1).cast("int")
    wide, right = k % 13 == 0, k % 2 == 1
    x0 = F.when(right & ~wide, 320.0).otherwise(50.0)
    size = F.when(k % 17 == 3, 24.0).when(k % 23 == 8, 16.0).otherwise(10.0)
    own = lines.select("doc_id", page.alias("page"), x0.alias("x0"), (60.0 + k * 17).alias("y0"), F.when(wide, 550.0).otherwise(x0 + 230).alias("x1"), (72.0 + k * 17).alias("y1"), "text", size.alias("size"), F.when(k % 19 == 5, 1.0).otherwise(0.0).alias("bold_share"))
    at = lines.select("doc_id", "lang", page.alias("page")).distinct()
    frame = lambda y0, y1, text: at.select("doc_id", "page", F.lit(50.0).alias("x0"), F.lit(y0).alias("y0"), F.lit(550.0).alias("x1"), F.lit(y1).alias("y1"), text.alias("text"), F.lit(10.0).alias("size"), F.lit(0.0).alias("bold_share"))
    own = own.unionByName(frame(10.0, 25.0, F.concat_ws(" ", F.lit("Head of"), "lang"))).unionByName(frame(770.0, 785.0, F.col("page").cast("string")))
    blocks = own.withColumn("page_width", F.lit(600.0)).withColumn("page_height", F.lit(800.0))
    cells = F.array(F.array(F.lit("document"), F.lit("page")), F.array(F.col("doc_id").cast("string"), F.col("page").cast("string")))
    tables = at.where("page % 2 = 0").select("doc_id", "page", F.lit(50.0).alias("x0"), F.lit(230.0).alias("y0"), F.lit(280.0).alias("x1"), F.lit(276.0).alias("y1"), cells.alias("rows"))
    # collections of German documents ask for larger headings, of French ones for longer texts
    settings = docs.select("doc_id", F.when(F.col("lang") == "de", 1.7).alias("size_ratio_threshold"), F.when(F.col("lang") == "fr", 900).alias("min_doc_length"))
    return blocks, tables, settings


def pdf_text(spark, d):
    out = pages.assemble(*_page_blocks(spark, d))
    heads = F.array_join(F.transform("headings", lambda h: F.concat_ws(":", h["pos"], h["level"], h["text"])), "|")
    places = F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["off"], p["page"], F.coalesce(p["logical"].cast("string"), F.lit("-")))), "|")
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"), F.sha2(heads, 256).alias("headings_sha256"), F.size("headings").cast("long").alias("n_headings"), F.sha2(places, 256).alias("pages_sha256"), F.size("pages").cast("long").alias("n_pages"), "outcome")


def pdf_profiles(spark, d):
    """The zones and running headers of each document."""
    own = pages.profile(_page_blocks(spark, d)[0])
    return own.select("doc_id", F.round("header_zone", 6).alias("header_zone"), F.round("footer_zone", 6).alias("footer_zone"), F.array_join(F.array_sort("running"), "|").alias("running"))


QUERIES = {"pdf_text": pdf_text, "pdf_profiles": pdf_profiles}

_PAGES = r"""l0 as (select doc_id, lang, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, lang, unnest(ls) as text, unnest(range(len(ls))) as i from l0),
l1 as (select *, i % 40 as k, (i // 40 + 1)::int as page from l),
at_ as (select distinct doc_id, lang, page from l1),
b as (
  select doc_id, page, case when k % 2 = 1 and k % 13 <> 0 then 320.0 else 50.0 end as x0, 60.0 + k * 17 as y0,
    case when k % 13 = 0 then 550.0 when k % 2 = 1 then 550.0 else 280.0 end as x1, 72.0 + k * 17 as y1, text,
    case when k % 17 = 3 then 24.0 when k % 23 = 8 then 16.0 else 10.0 end as size, case when k % 19 = 5 then 1.0 else 0.0 end as bold from l1
  union all select doc_id, page, 50, 10, 550, 25, 'Head of' || coalesce(' ' || lang, ''), 10, 0 from at_
  union all select doc_id, page, 50, 770, 550, 785, page::varchar, 10, 0 from at_),
pg as (select doc_id, count(distinct page) as pages from b group by 1),
seen as (
  select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text, count(*) filter (y0 < 80) as tops, max(y1) filter (y0 < 80) as y1,
    count(*) filter (y1 > 720) as bottoms, min(y0) filter (y1 > 720) as y0 from b where y0 < 80 or y1 > 720 group by 1, 2),
run as (
  select doc_id, max(y1) filter (tops >= greatest(3, pages * 0.3)) as y1, min(y0) filter (bottoms >= greatest(3, pages * 0.3)) as y0,
    coalesce(list(text order by text) filter (tops >= greatest(3, pages * 0.3)), []) as running
  from seen join pg using (doc_id) where text <> '' group by 1),
prof as (
  select pg.doc_id, case when y1 is null then 0.0 else least((y1 + 4) / 800, 0.1) end as header_zone,
    case when y0 < 800 then greatest((y0 - 4) / 800, 0.85) else 1.0 end as footer_zone, coalesce(running, []) as running
  from pg left join run using (doc_id))"""
_TEXT = r"""med as (select doc_id, page, median(size) as median from b group by 1, 2),
kept as (
  select b.*, case lang when 'de' then 1.7 else 1.15 end as ratio from b join prof using (doc_id) join (select distinct doc_id, lang from documents) using (doc_id)
  where y0 >= 800 * header_zone and y0 < 800 * footer_zone and trim(text) <> ''
    and not list_contains(running, trim(regexp_replace(text, '\s+', ' ', 'g')))
    and not (page % 2 = 0 and greatest(0, least(x1, 280) - greatest(x0, 50)) * greatest(0, least(y1, 276) - greatest(y0, 230)) >= 0.4 * (x1 - x0) * (y1 - y0))),
head as (
  select k.*, size > median * ratio as large, trim(regexp_replace(text, '\s+', ' ', 'g')) as one,
    case when size > median * ratio then case when size / median >= 2 then 1 when size / median >= 1.5 then 2 else 3 end
      when bold >= 0.85 and length(trim(text)) >= 5 and length(trim(text)) < 120 then 2 end as level from kept k join med using (doc_id, page)),
items as (
  select doc_id, page, x0, y0, x1, text, case when level is not null and one <> '' and not regexp_matches(one, '^[0-9]+$') and (not large or length(one) < 200) then level end as level, one from head
  union all
  select doc_id, page, 50, 230, 280, '| document | page |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | ' || page || ' |', null, null from at_ where page % 2 = 0),
g0 as (select *, (x0 + x1) / 2 as c, row_number() over w as rn, lag((x0 + x1) / 2) over w as before from items window w as (partition by doc_id, page order by (x0 + x1) / 2)),
g1 as (select doc_id, page, count(*) as n, arg_max(struct_pack(gap := c - before, l := rn - 1, x := (c + before) / 2), (c - before, -rn)) filter (before is not null) as m from g0 group by 1, 2),
g as (select doc_id, page, case when n >= 6 and m.gap >= 90 and m.l >= 3 and n - m.l >= 3 then m.x end as gutter from g1),
s as (select i.*, gutter, coalesce(x0 < gutter and gutter < x1 and x1 - x0 >= 360, false) as spans from items i join g using (doc_id, page)),
d as (select *, sum(spans::int) over (partition by doc_id, page order by y0, spans desc rows unbounded preceding) - spans::int as band from s),
o as (
  select *, row_number() over (partition by doc_id, page order by band, case when spans then 2 when gutter is null or (x0 + x1) / 2 < gutter then 0 else 1 end, y0, x0, x1, text) as place,
    regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]', '', 'g') as clean from d),
f as (select *, coalesce(sum(length(clean) + 2) over (partition by doc_id, page order by place rows between unbounded preceding and 1 preceding), 0) as off from o),
p as (select doc_id, page, sum(length(clean) + 2) as n from f group by 1, 2 having bool_or(trim(clean) <> '')),
q as (select doc_id, page, coalesce(sum(n) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding), 0) as start from p),
w as (select f.*, (start + off)::int as pos, start from f join q using (doc_id, page)),
h0 as (select doc_id, pos, level, one, count(*) over (partition by doc_id, one) as n, row_number() over (partition by doc_id, one order by pos) as nth from w where level is not null),
h as (select doc_id, string_agg(pos || ':' || level || ':' || one, '|' order by pos, level, one) as t, count(*) as n from h0 where n < 4 or nth = 1 group by 1),
r as (select doc_id, string_agg(start::int || ':' || page || ':' || page, '|' order by start) as t, count(*) as n from q group by 1),
x as (select doc_id, string_agg(clean, chr(10) || chr(10) order by pos, place) as t from w group by 1),
z as (select x.doc_id, lang, case when length(trim(x.t)) >= case lang when 'fr' then 900 else 100 end then x.t end as t, r.t as rt, r.n as rn, coalesce(h.t, '') as ht, coalesce(h.n, 0) as hn
  from x join r using (doc_id) left join h using (doc_id) join (select distinct doc_id, lang from documents) using (doc_id))"""

SQL = {
    "pdf_profiles": f"with {_PAGES} select doc_id, round(header_zone, 6) as header_zone, round(footer_zone, 6) as footer_zone, array_to_string(running, '|') as running from prof",
    "pdf_text": f"""with {_PAGES},
{_TEXT}
select doc_id, sha256(t) as text_sha256, length(t) as n_chars, sha256(ht) as headings_sha256, hn as n_headings, sha256(rt) as pages_sha256, rn as n_pages,
  case when t is null then 'too_short' else 'ok' end as outcome from z""",
}
