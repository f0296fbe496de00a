"""Queries over document, chat, evaluation, catalog and event operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..operators import catalog, chat, chunk, evaluate, structure
from ..sources import files
from ..streaming import events as ev
from .retrieval import TIDY, read, spread


def _docs(spark, d):
    return spread(read(spark, d, "documents"))


def _talk(spark, d):
    return read(spark, d, "conversations")


def _function(make):
    return lambda spark, d: make(_docs(spark, d))


def sanitize_text(docs):
    dirty = F.concat(F.lit("\x07\t"), F.col("text"), F.lit("\x00 \x7f\n"))
    return docs.select("doc_id", F.sha2(T.sanitize(dirty), 256).alias("clean_sha256"), F.length(T.drop_controls(dirty)).alias("n_kept"))


def text_metadata(docs):
    heads, front = files.markdown_facts(F.col("text"))
    return docs.select("doc_id", F.size(F.split("text", "\n", -1)).alias("n_lines"), F.length("text").alias("n_chars"), F.size(T.words("text")).alias("n_words"), heads.alias("n_headings"), front.alias("front_matter"), F.octet_length("text").alias("n_bytes"))


def normalize_whitespace(docs):
    return docs.select("doc_id", F.sha2(T.normalize_whitespace("text"), 256).alias("text_sha256"))


def truncate(docs):
    return docs.select("doc_id", T.truncate("text", 80).alias("short"), T.token_estimate("text").alias("n_tokens"), T.clean_title(T.first_sentence("text")).alias("title"))


def _chunks(strategy, **options):
    return lambda spark, d: chunk.chunk(_docs(spark, d), strategy, **options)


def chunk_stats(spark, d):
    out = chunk.stats(chunk.chunk_plain(_docs(spark, d), 400, 50))
    return out.withColumn("mean", F.round("mean", 6))


def duplicate_chunks(spark, d):
    """Lines of documents as chunks."""
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"))
    out = chunk.duplicates(lines.where(T.strip("content") != ""))
    return out.select("doc_id", "hash", F.array_join(F.transform("indexes", lambda x: x.cast("string")), ",").alias("indexes"), "n")


def content_hash_dedup(spark, d):
    docs = _docs(spark, d).withColumnRenamed("source", "collection")
    known = docs.where("lang = 'de'").select("collection", F.sha2("text", 256).alias("content_hash")).distinct()
    return catalog.new_documents(docs, known).select("doc_id", "collection", "content_hash")


def _marked(spark, d):
    """Documents whose lines of at most 40 characters are made headings, by their length."""
    marks = F.lit("######")
    level = lambda x: (F.length(x) % 4 + 1).cast("int")
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.when((F.length(T.strip(x)) > 0) & (F.length(x) <= 40), F.concat(F.substring(marks, F.lit(1), level(x)), F.lit(" "), F.trim(x))).otherwise(x))
    return _docs(spark, d).select("doc_id", F.array_join(lines, "\n").alias("text"))


def md_heading_map(spark, d):
    rows = _marked(spark, d).select("doc_id", F.posexplode(structure.headings("text")).alias("nth", "h"))
    return rows.select("doc_id", "nth", "h.pos", "h.level", F.col("h.text").alias("heading"))


def section_path(spark, d):
    """The section of the middle of every document."""
    own = _marked(spark, d).select("doc_id", F.floor(F.length("text") / 2).cast("int").alias("at"), structure.headings("text").alias("heads"))
    return own.select("doc_id", "at", F.array_join(structure.section_path("heads", "at"), " > ").alias("path"))


def page_lookup(spark, d):
    pages = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 900).cast("int")), lambda i: F.struct((i * 900 + 10).alias("off"), (i + 1).alias("page")))
    own = _docs(spark, d).select("doc_id", pages.alias("pages"), F.floor(F.length("text") / 2).cast("int").alias("middle"))
    own = own.select("doc_id", "pages", F.explode(F.array(F.lit(0), F.lit(10), "middle")).alias("at"))
    return own.select("doc_id", "at", structure.page_at("pages", "at")["page"].alias("page")).distinct()


def _blocks(spark, d):
    """Lines of documents as blocks on pages of 40, in two columns with a wide one now and then."""
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    k = F.col("i") % 40
    wide, right = k % 13 == 0, k % 2 == 1
    x0 = F.when(right & ~wide, 320.0).otherwise(50.0)
    return lines.select("doc_id", F.floor(F.col("i") / 40).cast("int").alias("page"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), x0.alias("x0"), F.when(wide, 550.0).otherwise(x0 + 230).alias("x1"), (k * 20.0).alias("y0"), (k * 20.0 + 15).alias("y1"), "text")


def pdf_gutters(spark, d):
    return structure.gutters(_blocks(spark, d))


def pdf_columns(spark, d):
    return structure.reading_order(_blocks(spark, d)).select("doc_id", "page", "x0", "y0", "place")


def pdf_running_headers(spark, d):
    return structure.running_headers(_blocks(spark, d))


def url_clean(spark, d):
    p = read(spark, d, "pages")
    more = F.concat("url", F.when(F.instr("url", "?") > 0, "&").otherwise("?"), F.lit("utm_source=a&keep=&GCLID=1&b=2#frag"))
    return p.select("page_id", urls.clean("url").alias("url"), urls.clean(more).alias("tagged"), urls.clean("url", F.lit("https://other.test/x")).alias("foreign"), urls.host("url").alias("host"))


def html_title(spark, d):
    own = files.web_pages(read(spark, d, "pages"))
    return own.select("page_id", "title", "outcome")


def web_pages(spark, d):
    own = files.web_pages(read(spark, d, "pages"))
    return own.select("page_id", "title", "text", "canonical", "outcome", urls.file_name("title", "url").alias("file_name"))


def _answers(spark, d):
    """Answers as predictions; gold is the same text, its first sentence, another question or none, by conversation."""
    p = chat.pairs(_talk(spark, d)).where("question is not null")
    kind = F.col("conv_id") % 4
    gold = F.when(kind == 0, F.concat(F.lit("** "), "answer", F.lit(" !"))).when(kind == 1, T.first_sentence("answer")).when(kind == 2, F.col("question")).otherwise(F.lit(T.NO_ANSWER_SENTINEL))
    pred = F.when((kind == 3) & (F.col("turn") % 4 == 1), F.concat(F.lit("Sorry, I don't know. "), "answer")).otherwise(F.col("answer"))
    return p.select("conv_id", "turn", pred.alias("pred"), gold.alias("gold"))


def qa_metrics(spark, d):
    m = evaluate.metrics(_answers(spark, d))
    return m.select("conv_id", "turn", "em", F.round("f1", 6).alias("f1"), F.round("concise_f1", 6).alias("concise_f1"), "no_answer")


def qa_summary(spark, d):
    m = evaluate.summary(evaluate.metrics(_answers(spark, d)))
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


def feedback_promotion(spark, d):
    talk = _talk(spark, d)
    rated = talk.select("conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, 1).when((F.col("conv_id") + F.col("turn")) % 3 == 1, -1).alias("rating")).where("rating is not null")
    old = talk.where("role = 'assistant' and conv_id % 2 = 0").select(F.concat_ws(":", "conv_id", "turn").alias("source_id"), F.lit("old").alias("question"), F.lit("old").alias("answer"))
    return chat.promote(old, rated, talk)


def message_delete(spark, d):
    talk = _talk(spark, d)
    return chat.without_message(talk, talk.where("(conv_id + turn) % 5 = 0")).select("conv_id", "turn", "role")


def doc_counters(spark, d):
    docs = _docs(spark, d).withColumn("is_deleted", F.col("doc_id") % 7 == 0)
    lines = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return catalog.counters(docs, lines, "source")


def list_page(spark, d):
    o = read(spark, d, "orders")
    total = catalog.page_count(o.where("o_orderstatus = 'O'"), 50)
    rows = catalog.page(o.where("o_orderstatus = 'O'"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 50)
    return rows.crossJoin(F.broadcast(total)).select("o_orderkey", "o_orderdate", "total", "pages")


def fk_join(spark, d):
    o, c, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return rows.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def left_lookup(spark, d):
    e, c = read(spark, d, "events"), read(spark, d, "customer")
    rows = e.join(c.where("c_mktsegment = 'BUILDING'"), e["user_id"] == c["c_custkey"], "left")
    return rows.select("event_id", F.coalesce("c_name", F.lit("unknown")).alias("name"))


def _deleted(spark, d):
    docs = _docs(spark, d)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"))
    return lines.select("doc_id", "chunk_index"), catalog.soft_delete(docs.select("doc_id", F.lit(False).alias("is_deleted")), docs.where("source = 'src3'"))


def semi_cleanup(spark, d):
    return catalog.orphans(*_deleted(spark, d))[1]


def anti_keep(spark, d):
    return catalog.orphans(*_deleted(spark, d))[0]


def upsert(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return catalog.upsert(c, new, ["c_custkey"])


def import_remap(spark, d):
    ids = _docs(spark, d).where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("old_id"), F.concat(F.lit("n"), "doc_id").alias("new_id"))
    talk = _talk(spark, d)
    sources = F.array(F.struct(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("chunk_index")), F.struct(F.lit("9").alias("document_id"), F.lit(0).cast("long").alias("chunk_index")))
    rows = talk.select(F.concat_ws(":", "conv_id", "turn").alias("id"), sources.alias("sources"))
    out = catalog.remap_sources(rows, ids, "id")
    return out.select("id", F.array_join(F.transform("sources", lambda s: F.concat_ws("/", s["document_id"], s["chunk_index"])), ",").alias("sources"))


def label_quality_join(spark, d):
    rows = _docs(spark, d).join(read(spark, d, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


def event_log_recent(spark, d):
    e = read(spark, d, "events").where("event_type = 'click'")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", F.get_json_object("props", "$.page").alias("page"))


def event_tumbling(spark, d):
    return ev.tumbling(read(spark, d, "events")).withColumn("total", F.round("total", 4))


def event_sessions(spark, d):
    return ev.sessions(read(spark, d, "events"), "6 hours")


def _chat(make):
    return lambda spark, d: make(_talk(spark, d))


QUERIES = {
    "sanitize_text": _function(sanitize_text),
    "text_metadata": _function(text_metadata),
    "normalize_whitespace": _function(normalize_whitespace),
    "truncate": _function(truncate),
    "chunk_fixed_nobreak": lambda spark, d: chunk.chunk_plain(_docs(spark, d), 400, 50),
    "chunk_fixed": _chunks("simple", size=1000, overlap=200),
    "chunk_recursive": _chunks("smart", size=1000, overlap=200),
    "chunk_semantic": _chunks("semantic"),
    "chunk_stats": chunk_stats,
    "duplicate_chunks": duplicate_chunks,
    "content_hash_dedup": content_hash_dedup,
    "md_heading_map": md_heading_map,
    "section_path": section_path,
    "page_lookup": page_lookup,
    "pdf_gutters": pdf_gutters,
    "pdf_columns": pdf_columns,
    "pdf_running_headers": pdf_running_headers,
    "url_clean": url_clean,
    "html_title": html_title,
    "web_pages": web_pages,
    "qa_metrics": qa_metrics,
    "qa_summary": qa_summary,
    "chat_pairs": _chat(chat.pairs),
    "chat_history_tail": _chat(lambda t: chat.tail(t, 3).select("conv_id", "turn", "role", "place")),
    "chat_next_index": _chat(chat.next_turn),
    "first_turns": _chat(chat.first_turns),
    "chat_markdown": _chat(chat.markdown),
    "feedback_promotion": feedback_promotion,
    "message_delete": message_delete,
    "doc_counters": doc_counters,
    "list_page": list_page,
    "fk_join": fk_join,
    "left_lookup": left_lookup,
    "semi_cleanup": semi_cleanup,
    "anti_keep": anti_keep,
    "upsert": upsert,
    "import_remap": import_remap,
    "label_quality_join": label_quality_join,
    "event_log_recent": event_log_recent,
    "event_tumbling": event_tumbling,
    "event_sessions": event_sessions,
}

_WS = r"e' \n\t\r'"
_PAIRS = "select a.conv_id, a.turn, a.text as answer, u.text as question from conversations a left join conversations u on u.conv_id = a.conv_id and u.turn = a.turn - 1 and u.role = 'user' where a.role = 'assistant'"


def _first(c):
    ends = [". ", "?' || chr(10) || '", "!' || chr(10) || '", "? ", "! ", ".' || chr(10) || '"]
    return "trim(case " + " ".join(f"when instr({c}, '{e}') > 0 then substr({c}, 1, instr({c}, '{e}') - 1)" for e in ends) + f" else {c} end, {_WS})"


def _f1(a, b):
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else 2.0 * list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))) / (len({a}) + len({b})) end"


_METRICS = rf"""p as ({_PAIRS}),
a as (select conv_id, turn, case when conv_id % 4 = 3 and turn % 4 = 1 then 'Sorry, I don''t know. ' || answer else answer end as pred,
  case conv_id % 4 when 0 then '** ' || answer || ' !' when 1 then {_first("answer")} when 2 then question else '__NO_ANSWER__' end as gold from p where question is not null),
t as (select *, regexp_extract_all(lower(pred), '[a-z0-9]+') as tp, regexp_extract_all(lower(gold), '[a-z0-9]+') as tg,
  regexp_extract_all(lower({_first("pred")}), '[a-z0-9]+') as cp, regexp_extract_all(lower({_first("gold")}), '[a-z0-9]+') as cg from a),
m as (select conv_id, turn, (tp = tg)::int::double as em, {_f1("tp", "tg")} as f1, {_f1("cp", "cg")} as concise_f1,
  case when gold = '__NO_ANSWER__' then case when lower(pred) like '%i don''t know%' or lower(pred) like '%no information%' then 1.0 else 0.0 end end as no_answer from t)"""
_LINES = "unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i"
_PLAIN = f"""t as (select doc_id, {TIDY} as text from documents),
s as (select doc_id, text, unnest(case when length(text) <= 400 then [0] else range(0, length(text), 350) end) as s from t where text <> ''),
c as (select doc_id, s::int as start_char, (case when length(text) <= 400 then length(text) else s + 400 end)::int as end_char, trim(substr(text, s + 1, 400), {_WS}) as content from s)"""
_MARKED = f"""l as (select doc_id, {_LINES} from documents),
h as (select doc_id, i, case when trim(line, {_WS}) <> '' and length(line) <= 40 then repeat('#', (length(line) % 4 + 1)::int) || ' ' || trim(line) else line end as line,
  case when trim(line, {_WS}) <> '' and length(line) <= 40 then length(line) % 4 + 1 end as level, trim(line) as heading from l),
o as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from h)"""
_BLOCKS = f"""l as (select doc_id, {_LINES} from documents),
b as (select doc_id, (i // 40)::int as page, i % 40 as k, (i % 40) * 20.0 as y0, (i % 40) * 20.0 + 15 as y1,
  case when (i % 40) % 2 = 1 and (i % 40) % 13 <> 0 then 320.0 else 50.0 end as x0,
  case when (i % 40) % 13 = 0 then 550.0 when (i % 40) % 2 = 1 then 550.0 else 280.0 end as x1, line as text from l),
g0 as (select *, (x0 + x1) / 2 as c, row_number() over w as rn, lag((x0 + x1) / 2) over w as before from b window w as (partition by doc_id, page order by (x0 + x1) / 2)),
g1 as (select doc_id, page, count(*) as n, arg_max(struct_pack(gap := c - before, l := rn - 1, x := (c + before) / 2), (c - before, -rn)) filter (before is not null) as m from g0 group by 1, 2),
g as (select doc_id, page, case when n >= 6 and m.gap >= 90 and m.l >= 3 and n - m.l >= 3 then m.x end as gutter from g1)"""

SQL = {
    "sanitize_text": r"""with t as (select doc_id, regexp_replace(chr(7) || chr(9) || text || ' ' || chr(127) || chr(10), '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]', '', 'g') as c from documents)
select doc_id, sha256(trim(c, e' \n\t\r')) as clean_sha256, length(c) as n_kept from t""",
    "text_metadata": rf"""select doc_id, len(string_split(text, chr(10))) as n_lines, length(text) as n_chars,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as n_words,
  len(list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x, {_WS}), '#'))) as n_headings,
  starts_with(trim(text, {_WS}), '---') as front_matter, octet_length(encode(text)) as n_bytes from documents""",
    "normalize_whitespace": rf"select doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{2,}}', e'\n\n', 'g'), {_WS})) as text_sha256 from documents",
    "truncate": rf"""select doc_id, case when length(text) <= 80 then text else substr(text, 1, 77) || '...' end as short, length(text) // 4 as n_tokens,
  substr(trim(regexp_replace(trim(trim(trim({_first("text")}, '"'), ''''), {_WS}), '[.!?:;]$', ''), {_WS}), 1, 120) as title from documents""",
    "chunk_fixed_nobreak": f"with {_PLAIN} select * from c where content <> ''",
    "chunk_stats": rf"""with {_PLAIN} select doc_id, count(*) as n_chunks, min(length(content)) as least, max(length(content)) as most, round(avg(length(content)), 6) as mean,
  sum(len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> ''))) as n_words from c where content <> '' group by 1""",
    "duplicate_chunks": rf"""with l as (select doc_id, {_LINES} from documents),
h as (select doc_id, i, sha1(trim(regexp_replace(line, '\s+', ' ', 'g'))) as hash from l where trim(line, {_WS}) <> '')
select doc_id, hash, string_agg(i::varchar, ',' order by i) as indexes, count(*) as n from h group by 1, 2 having count(*) >= 2""",
    "content_hash_dedup": """with h as (select doc_id, source as collection, sha256(text) as content_hash, lang from documents),
f as (select collection, content_hash, min(doc_id) as doc_id from h group by 1, 2)
select doc_id, collection, content_hash from f where (collection, content_hash) not in (select (collection, content_hash) from h where lang = 'de')""",
    "md_heading_map": f"with {_MARKED} select doc_id, row_number() over (partition by doc_id order by i) - 1 as nth, pos, level, heading from o where level is not null",
    "section_path": f"""with {_MARKED},
a as (select doc_id, floor((sum(length(line) + 1) - 1) / 2)::int as "at" from h group by 1),
b as (select o.doc_id, "at", i, level, heading from a join o on o.doc_id = a.doc_id and o.level is not null and o.pos <= "at"),
k as (select *, min(level) over (partition by doc_id order by i rows between 1 following and unbounded following) as later from b)
select a.doc_id, a."at", coalesce(string_agg(heading, ' > ' order by i) filter (later is null or level < later), '') as path from a left join k on k.doc_id = a.doc_id group by 1, 2""",
    "page_lookup": """with a as (select doc_id, length(text) as n, unnest([0, 10, floor(length(text) / 2)::int]) as "at" from documents)
select distinct doc_id, "at"::int as "at", (case when "at" < 10 then 1 else least(("at" - 10) // 900, n // 900) + 1 end)::int as page from a""",
    "pdf_gutters": f"with {_BLOCKS} select * from g",
    "pdf_columns": f"""with {_BLOCKS},
s as (select b.*, gutter, coalesce(x0 < gutter and gutter < x1 and x1 - x0 >= 360, false) as spans from b join g using (doc_id, page)),
d as (select *, sum(spans::int) over (partition by doc_id, page order by y0, spans desc rows unbounded preceding) - spans::int as band from s)
select doc_id, page, x0, y0, row_number() over (partition by doc_id, page order by band, case when spans then 2 when gutter is null or (x0 + x1) / 2 < gutter then 0 else 1 end, y0, x0) as place from d""",
    "pdf_running_headers": f"""with {_BLOCKS},
n as (select doc_id, count(distinct page) as pages from b group by 1),
e as (select doc_id, trim(text) as text, count(distinct page) as n from b where y1 <= 80 or y0 >= 720 group by 1, 2)
select doc_id, text, e.n from e join n using (doc_id) where e.n >= greatest(3, pages * 0.3)""",
    "url_clean": r"""with u as (select page_id, url, url || case when instr(url, '?') > 0 then '&' else '?' end || 'utm_source=a&keep=&GCLID=1&b=2#frag' as more from pages),
v as (select page_id, regexp_replace(url, '#.*$', '') as a, regexp_replace(more, '#.*$', '') as b, url from u),
k as (select *, array_to_string(list_filter(string_split(regexp_extract(a, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_|cx_|mc_|yclid)') and lower(split_part(p, '=', 1)) not in ('fbclid', 'gclid', 'gclsrc', 'msclkid', 'igshid', '_ga', 'twclid')), '&') as qa,
  array_to_string(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_|cx_|mc_|yclid)') and lower(split_part(p, '=', 1)) not in ('fbclid', 'gclid', 'gclsrc', 'msclkid', 'igshid', '_ga', 'twclid')), '&') as qb from v),
r as (select page_id, split_part(a, '?', 1) || case when qa = '' then '' else '?' || qa end as url, split_part(b, '?', 1) || case when qb = '' then '' else '?' || qb end as tagged, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as host from k)
select page_id, url, tagged, case when host = 'other.test' then 'https://other.test/x' else url end as foreign, host from r""",
    "qa_metrics": f"with {_METRICS} select conv_id, turn, em, round(f1, 6) as f1, round(concise_f1, 6) as concise_f1, no_answer from m",
    "qa_summary": f"with {_METRICS} select count(*) as n, round(avg(em), 6) as mean_em, round(avg(f1), 6) as mean_f1, round(avg(concise_f1), 6) as mean_concise_f1, round(avg(no_answer), 6) as mean_no_answer from m",
    "chat_pairs": _PAIRS,
    "chat_history_tail": "with r as (select *, row_number() over (partition by conv_id order by turn desc) as nth from conversations) select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as place from r where nth <= 3",
    "chat_next_index": "select conv_id, max(turn) as last, max(turn) + 1 as next_user, max(turn) + 2 as next_assistant from conversations group by 1",
    "first_turns": "select conv_id, arg_min(text, turn) filter (role = 'user') as user, arg_min(text, turn) filter (role = 'assistant') as assistant from conversations group by 1",
    "chat_markdown": "select conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || '## Messages' || chr(10) || chr(10) || string_agg('**' || upper(role[1]) || role[2:] || ':** ' || text || chr(10) || chr(10), '' order by turn) as markdown from conversations group by 1",
    "feedback_promotion": f"""with p as ({_PAIRS}),
old as (select conv_id, turn from conversations where role = 'assistant' and conv_id % 2 = 0 and (conv_id + turn) % 3 = 2)
select conv_id || ':' || turn as source_id, 'old' as question, 'old' as answer from old
union all select conv_id || ':' || turn, question, answer from p where question is not null and (conv_id + turn) % 3 = 0""",
    "message_delete": """with g as (select conv_id, turn, role from conversations where (conv_id + turn) % 5 = 0),
w as (select conv_id, case role when 'user' then turn + 1 when 'assistant' then turn - 1 end as turn, case role when 'user' then 'assistant' when 'assistant' then 'user' end as role from g)
select conv_id, turn, role from conversations c where (conv_id + turn) % 5 <> 0 and not exists (select 1 from w where w.conv_id = c.conv_id and w.turn = c.turn and w.role = c.role and w.turn > 0)""",
    "doc_counters": "select source, count(*) as n_documents, sum(len(string_split(text, chr(10))))::bigint as n_chunks from documents where doc_id % 7 <> 0 group by 1",
    "list_page": "select o_orderkey, o_orderdate, (select count(*) from orders where o_orderstatus = 'O') as total, (select ceil(count(*) / 50)::bigint from orders where o_orderstatus = 'O') as pages from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey limit 50 offset 100",
    "fk_join": "select n_name, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    "left_lookup": "select event_id, coalesce(c_name, 'unknown') as name from events left join customer on user_id = c_custkey and c_mktsegment = 'BUILDING'",
    "semi_cleanup": f"select doc_id, i::int as chunk_index from (select doc_id, source, {_LINES} from documents) where source = 'src3'",
    "anti_keep": f"select doc_id, i::int as chunk_index from (select doc_id, source, {_LINES} from documents) where source <> 'src3'",
    "upsert": "with n as (select c_custkey * 2 as c_custkey, 'new ' || c_name as c_name, 0.0::double as c_acctbal from customer where c_custkey % 3 = 0) select c_custkey, c_name, c_acctbal from customer where c_custkey not in (select c_custkey from n) union all select * from n",
    "import_remap": """with n as (select doc_id from documents where doc_id % 3 = 0)
select conv_id || ':' || turn as id, case when conv_id in (select doc_id from n) then 'n' else '' end || conv_id || '/' || turn || ',' || case when 9 in (select doc_id from n) then 'n9/0' else '9/0' end as sources from conversations""",
    "label_quality_join": "select lang, count(*) as n, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from documents join labels using (doc_id) group by 1",
    "event_log_recent": "select event_id, user_id, json_extract_string(props, '$.page') as page from events where event_type = 'click' order by ts desc, event_id desc limit 100",
    "event_tumbling": "select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_sessions": """with g as (select *, case when ts < lag(ts) over w + interval 6 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, max(ts) as end, count(*) as n from s group by user_id, k""",
}
