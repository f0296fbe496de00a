"""Queries over ingestion, catalog, feedback and layout operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, chat, dense, evaluate, ingest, structure
from .documents import _BLOCKS, _blocks, _docs, _talk
from .retrieval import DENSE, TIDY, _vectors, read


def sentence_split(spark, d):
    parts = _docs(spark, d).select("doc_id", T.sentence_list("text").alias("s"))
    return parts.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("sentences_sha256"))


def uuid_list(spark, d):
    tail = F.lpad(F.hex("c_custkey"), 12, "0")
    values = F.array(F.concat(F.lit(" 3F2504E0-4F89-11D3-9A0C-"), tail), F.lit("bad"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("00000000-0000-0000-0000-"), tail)), F.concat(tail, F.lit("-1")))
    return read(spark, d, "customer").select("c_custkey", F.array_join(T.uuids(values), ",").alias("ids"))


def iso_times(spark, d):
    e = read(spark, d, "events").select("event_id", T.iso_time("ts").alias("iso"))
    text = F.when(F.col("event_id") % 10 == 0, F.lit("yesterday")).otherwise(F.col("iso"))
    return e.select("event_id", "iso", T.parse_time(text).alias("ts"))


def question_intent(spark, d):
    forms = F.array(F.lit("Please SHOW me question 7"), F.lit("list the question"), F.lit("relist question 9"), F.concat(F.lit("give\tQuestion "), F.col("item_id")))
    b = read(spark, d, "benchmark").select("item_id", F.posexplode(forms).alias("form", "text"))
    return b.select("item_id", "form", T.asks_for_question("text").alias("asked"))


def token_account(spark, d):
    n = F.col("event_id") % 100
    rows = read(spark, d, "events").select("event_id", F.when(n % 7 != 0, n).alias("read"), F.when(n % 3 != 0, n * 2 % 90).alias("hit"), F.when(n % 5 == 0, n % 11).alias("made"))
    return rows.select("event_id", T.missed_tokens(F.col("read"), F.col("hit"), F.col("made")).alias("missed"), T.clamp(F.col("hit"), 10, 50).alias("shown"))


def model_counts(spark, d):
    known = read(spark, d, "part").select(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("gpt-"), "p_brand")).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("claude-"), "p_brand")).otherwise(F.col("p_brand")).alias("model"))
    more = read(spark, d, "supplier").select(F.concat(F.lit("voyage-"), "s_name").alias("model"))
    models = known.unionByName(more, allowMissingColumns=True).distinct()
    return models.groupBy(T.provider("model").alias("provider")).agg(F.count("*").alias("n"))


def feedback_list(spark, d):
    k = F.col("conv_id") + F.col("turn")
    talk = _talk(spark, d).select("conv_id", "turn", "role", F.when(k % 4 == 0, 1).when(k % 4 == 1, -1).when(k % 4 == 2, 0).alias("rating"), F.col("turn").alias("created_at"))
    conversations = talk.select("conv_id").distinct().withColumn("collection", F.concat(F.lit("src"), (F.col("conv_id") % 5).cast("string")))
    gold = talk.where((F.col("role") == "assistant") & (k % 8 == 0)).select(F.concat_ws(":", "conv_id", "turn").alias("source_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("gold_id"))
    return chat.feedback(talk, conversations.where("collection <> 'src4'"), gold, None, 200)


def eval_results(spark, d):
    b = read(spark, d, "benchmark")
    runs = b.select(F.col("item_id").alias("sample_id"), F.when(F.col("item_id") % 3 == 0, 0.2).when(F.col("item_id") % 3 == 1, 0.9).alias("f1"))
    samples = b.where("item_id % 2 = 0").select(F.col("item_id").alias("sample_id"), F.col("text").alias("question"), F.lit("a").alias("answer"))
    return evaluate.results(runs, samples, 0.4).select("sample_id", "f1", "question", "answer")


def gold_replace(spark, d):
    b = read(spark, d, "benchmark").select(F.concat(F.lit("kb"), (F.col("item_id") % 4).cast("string")).alias("collection"), "item_id")
    new = b.where("item_id % 10 = 0").withColumn("item_id", F.col("item_id") + 1000)
    return catalog.replace_samples(b, new, b.where("item_id % 4 = 2"))


def gold_oldest(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return catalog.oldest(rows, [F.asc("o_orderdate"), F.asc("o_orderkey")], 100)


def _collections(spark, d):
    docs = _docs(spark, d).select("doc_id", F.col("source").alias("collection"), (F.col("doc_id") % 11 == 0).alias("is_deleted"), F.lit("completed").alias("status"))
    return docs.select("collection").distinct().withColumn("is_deleted", F.lit(False)), docs


def collection_delete(spark, d):
    """Three collections deleted with their documents, one of them restored; the rest is purged."""
    every, docs = _collections(spark, d)
    gone = every.where("collection in ('src1', 'src2', 'src3')")
    every, docs = catalog.cascade(every, docs, gone)
    every, docs = catalog.cascade(every, docs, every.where("collection = 'src2'"), restore=True)
    return catalog.purge(docs, every).select("doc_id", "collection", "is_deleted", "status")


def status_backfill(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")).alias("status"))
    return catalog.backfill(o, "status", {"O": "open", "F": "filled"}, "pending")


def newest_settings(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return catalog.latest(e, F.struct("ts", "event_id"), ["user_id"]).select("user_id", "event_id", "event_type")


def valid_tokens(spark, d):
    e = read(spark, d, "events")
    n = F.col("event_id")
    tokens = e.select("event_id", F.when(n % 5 == 0, F.col("ts")).alias("revoked_at"), F.when(n % 3 != 0, F.col("ts") + F.expr("interval 30 days")).alias("expires_at"), (n % 7 == 0).alias("used"))
    now = F.lit("2024-02-15 00:00:00").cast("timestamp_ntz")
    return catalog.valid_tokens(tokens, now).select("event_id")


def conversation_search(spark, d):
    talk = _talk(spark, d).where("turn = 0").select("conv_id", F.when(F.col("conv_id") % 3 != 0, F.substring("text", 1, 60)).otherwise(F.lit("  ")).alias("title"))
    return catalog.matching(talk, "title", "conv_id", " Untitled ").select("conv_id")


def pdf_page_numbers(spark, d):
    numbered = _blocks(spark, d).withColumn("text", F.when((F.col("y0") >= 760) & (F.col("doc_id") % 2 == 0), F.concat("text", F.lit("\n "), (F.col("page") + 3).cast("string"))).otherwise(F.col("text")))
    return structure.footer_numbers(numbered)


def pdf_headings(spark, d):
    k = (F.col("y0") / 20).cast("int")
    sized = _blocks(spark, d).withColumns({"size": F.when(k % 17 == 0, 24.0).when(k % 19 == 0, 16.0).when(k % 11 == 0, 14.5).otherwise(10.0 + k % 3), "bold_share": F.when(k % 5 == 0, 0.9).otherwise(0.1)})
    return structure.block_headings(sized).select("doc_id", "page", "y0", "level", "text")


def _markdown(spark, d):
    """Documents of which every other line that isn't blank begins a section, with pages of 700 characters."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when((i % 6 == 0) & (F.trim(x) != ""), F.concat(F.repeat(F.lit("#"), (i / 6 % 3 + 1).cast("int")), F.lit(" "), x)).otherwise(x))
    pages = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 700).cast("int")), lambda i: F.struct((i * 700).alias("off"), (i + 1).alias("physical"), F.when(i % 2 == 0, i + 11).alias("logical")))
    kind = F.when(F.col("doc_id") % 2 == 0, "md").otherwise("txt")
    status = F.when(F.col("doc_id") % 9 == 0, "processing")
    return _docs(spark, d).select("doc_id", F.array_join(lines, "\n").alias("text"), F.col("source").alias("collection"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), kind.alias("file_type"), pages.alias("pages"), status.alias("status"))


def chunk_payloads(spark, d):
    rows, _ = ingest.process(_markdown(spark, d), 400, 50)
    return rows.select("doc_id", "collection", "chunk_index", F.sha2("text", 256).alias("text_sha256"), "char_count", "start_char", "name", "file_type", "page_number_physical", "page_number")


def lexical_payloads(spark, d):
    """Chunks with sections: how many chunks of each level a document has."""
    rows, _ = ingest.process(_markdown(spark, d), 400, 50)
    lexical = ingest.lexical_documents(rows)
    return lexical.groupBy("doc_id", "section_level").agg(F.count("*").alias("n"), F.count_distinct("section_path").alias("paths"))


def ingest_statuses(spark, d):
    docs = _markdown(spark, d).withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.lit(" \n")).otherwise(F.col("text")))
    _, statuses = ingest.process(docs, 400, 50, docs.where("doc_id % 10 = 3").select("doc_id"))
    return statuses


def source_listing(spark, d):
    """The dense hits of each query as a listing, with their mean score and number of documents."""
    c, q = _vectors(spark, d)
    found = dense.search(c, q, 5).select("qid", "id", F.round("score", 4).alias("score"), "rank")
    rows = found.join(_docs(spark, d).select(F.col("doc_id").alias("id"), "source", "text"), "id")
    s = F.array_sort(F.collect_list(F.struct("rank", F.col("source").alias("name"), (F.col("id") % 7).alias("chunk_index"), F.format_string("%.4f", "score").alias("score"), "text", F.col("score").alias("value"), "id")))
    by = rows.groupBy("qid").agg(s.alias("s"), F.count_distinct("id").alias("documents"))
    return by.select("qid", chat.source_list("s").alias("listing"), F.round(chat.confidence(F.transform("s", lambda x: x["value"])), 6).alias("confidence"), "documents")


def retrieve_by_document(spark, d):
    """Dense search within one document's chunks, here within one label."""
    c, q = _vectors(spark, d)
    return dense.search(c, q, 5, None, {"label": 3}).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def retrieval_recall(spark, d):
    """Whether the hits of a dense search hold the document that is wanted: the query's own, a neighbour or one that isn't there."""
    c, q = _vectors(spark, d)
    found = dense.search(c, q, 10)
    s = found.groupBy("qid").agg(F.collect_list(F.struct(F.col("id").cast("string").alias("document_id"), (F.col("rank") - 1).cast("int").alias("chunk_index"))).alias("s"))
    k = F.floor(F.col("qid") / 50) % 4
    doc = F.when(k == 0, F.col("qid").cast("string")).when(k == 1, (F.col("qid") + 1).cast("string")).when(k == 2, "")
    index = F.when(k == 0, 0).when(k == 3, 9)
    return s.select("qid", evaluate.recall("s", doc, index).alias("recall"))


def collection_stats(spark, d):
    """Counters of documents, chunks and conversations by collection, and whether all is ready."""
    docs = _docs(spark, d).select("doc_id", F.col("source").alias("collection"), F.length("text").alias("size"), (F.col("doc_id") % 50 != 0).alias("ready"))
    return docs.groupBy("collection").agg(F.count("*").alias("documents"), F.sum("size").alias("size"), F.bool_and("ready").alias("ready"))


QUERIES = {f.__name__: f for f in (
    sentence_split, uuid_list, iso_times, question_intent, token_account, model_counts, feedback_list, eval_results, gold_replace, gold_oldest, collection_delete, status_backfill, newest_settings,
    valid_tokens, conversation_search, pdf_page_numbers, pdf_headings, chunk_payloads, lexical_payloads, ingest_statuses, source_listing, retrieve_by_document, retrieval_recall, collection_stats,
)}

_MARKED = rf"""m0 as (select doc_id, source, text as plain, string_split(text, chr(10)) as ls from documents),
m as (select doc_id, source, plain, array_to_string(list_transform(ls, lambda x, i: case when (i - 1) % 6 = 0 and trim(x) <> '' then repeat('#', (((i - 1) // 6) % 3 + 1)::int) || ' ' || x else x end), chr(10)) as text from m0 where doc_id % 9 <> 0)"""
_CUT = rf"""t as (select doc_id, source, plain, text as raw, {TIDY} as text from m),
c as (select *, trim(substr(text, s + 1, 400), e' \n\t\r') as content from (select *, unnest(case when length(text) <= 400 then [0] else range(0, length(text), 350) end) as s from t where text <> '')),
k as (select *, (s // 350)::int as chunk_index from c where content <> '')"""

SQL = {
    "sentence_split": r"""with s as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '(?s)(.[^.!?]*[.!?]|.+\z)'), lambda x: trim(x, e' \n\t\r')), lambda x: x <> '') as s from documents)
select doc_id, len(s) as n, sha256(array_to_string(s, '|')) as sentences_sha256 from s""",
    "uuid_list": "select c_custkey, '3f2504e0-4f89-11d3-9a0c-' || lower(lpad(hex(c_custkey), 12, '0')) || case when c_custkey % 2 = 0 then ',00000000-0000-0000-0000-' || lower(lpad(hex(c_custkey), 12, '0')) else '' end as ids from customer",
    "iso_times": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, case when event_id % 10 <> 0 then date_trunc('second', ts) end as ts from events",
    "question_intent": "select item_id, unnest(range(4)) as form, unnest([true, false, false, true]) as asked from benchmark",
    "token_account": """with r as (select event_id, event_id % 100 as n from events),
s as (select event_id, case when n % 7 <> 0 then n end as read, case when n % 3 <> 0 then n * 2 % 90 end as hit, case when n % 5 = 0 then n % 11 end as made from r)
select event_id, case when read is not null then greatest(read - coalesce(hit, 0) - coalesce(made, 0), 0) end as missed, greatest(10, least(50, hit)) as shown from s""",
    "model_counts": """with m as (select case p_partkey % 4 when 0 then 'gpt-' when 1 then 'claude-' else '' end || p_brand as model from part union select 'voyage-' || s_name from supplier)
select case when model like 'gpt-%' then 'openai' when model like 'claude-%' then 'anthropic' when model like 'voyage-%' then 'voyage' else 'ollama' end as provider, count(*) as n from m group by 1""",
    "feedback_list": """with t as (select conv_id, turn, case (conv_id + turn) % 4 when 0 then 1 else -1 end as rating from conversations where role = 'assistant' and (conv_id + turn) % 4 in (0, 1) and conv_id % 5 <> 4)
select conv_id, turn, rating, 'src' || conv_id % 5 as collection, case when (conv_id + turn) % 8 = 0 then conv_id * 1000 + turn end as gold_id from t order by turn desc, conv_id limit 200""",
    "eval_results": "select item_id as sample_id, 0.2::double as f1, case when item_id % 2 = 0 then text else '' end as question, case when item_id % 2 = 0 then 'a' else '' end as answer from benchmark where item_id % 3 = 0",
    "gold_replace": "select 'kb' || item_id % 4 as collection, item_id from benchmark where item_id % 4 <> 2 union all select 'kb' || item_id % 4, item_id + 1000 from benchmark where item_id % 10 = 0",
    "gold_oldest": "select o_orderkey, o_orderdate from orders order by o_orderdate, o_orderkey limit 100",
    "collection_delete": "select doc_id, source as collection, case when source = 'src2' then false else doc_id % 11 = 0 end as is_deleted, case when source = 'src2' then 'pending' else 'completed' end as status from documents where source not in ('src1', 'src3')",
    "status_backfill": "select o_orderkey, case when o_orderkey % 9 = 0 then 'pending' when o_orderstatus = 'O' then 'open' when o_orderstatus = 'F' then 'filled' else o_orderstatus end as status from orders",
    "newest_settings": "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1",
    "valid_tokens": "select event_id from events where event_id % 5 <> 0 and event_id % 7 <> 0 and (event_id % 3 = 0 or ts + interval 30 days > timestamp '2024-02-15')",
    "conversation_search": "select conv_id from conversations where turn = 0 and (conv_id % 3 = 0 or trim(substr(text, 1, 60)) = '' or lower(substr(text, 1, 60)) like '%untitled%')",
    "pdf_page_numbers": f"""with {_BLOCKS},
lines as (select doc_id, page, y0, x0, i, trim(line) as line from (select doc_id, page, y0, x0, unnest(range(len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as line from
  (select doc_id, page, y0, x0, text || case when doc_id % 2 = 0 then chr(10) || ' ' || (page + 3) else '' end as text from b where y0 >= 760)))
select doc_id, page, arg_max(line, (y0, x0, i))::int as number from lines where regexp_full_match(line, '[0-9]{{1,4}}') group by 1, 2""",
    "pdf_headings": rf"""with {_BLOCKS},
z as (select *, case when k % 17 = 0 then 24.0 when k % 19 = 0 then 16.0 when k % 11 = 0 then 14.5 else 10.0 + k % 3 end::double as size, k % 5 = 0 as bold from b),
y as (select *, quantile_cont(size, 0.5) over (partition by doc_id, page) as median, trim(regexp_replace(text, '\s+', ' ', 'g')) as one, trim(text) as line from z),
h as (select doc_id, page, y0, size > median * 1.15 as large, size / median as part, one, line, bold from y),
r as (select doc_id, page, y0, case when large and part >= 2 then 1 when large and part >= 1.5 then 2 when large then 3 when bold and length(line) >= 5 and length(line) < 120 then 2 end as level, one as text, large from h)
select doc_id, page, y0, level, text from r where level is not null and text <> '' and not regexp_full_match(text, '[0-9]+') and (not large or length(text) < 200)""",
    "chunk_payloads": f"""with {_MARKED}, {_CUT}
select doc_id, source as collection, chunk_index, sha256(content) as text_sha256, length(content) as char_count, s::int as start_char, 'd' || doc_id as name, case when doc_id % 2 = 0 then 'md' else 'txt' end as file_type,
  (least(s // 700, length(plain) // 700) + 1)::int as page_number_physical,
  case when least(s // 700, length(plain) // 700) % 2 = 0 then least(s // 700, length(plain) // 700) + 11 else least(s // 700, length(plain) // 700) + 1 end::int as page_number from k""",
    "ingest_statuses": f"""with {_MARKED.replace("text as plain, string_split(text, chr(10))", "text as plain, string_split(case when doc_id % 13 = 0 then ' ' || chr(10) else text end, chr(10))")}, {_CUT},
n as (select doc_id, count(k.chunk_index) as n from m left join k using (doc_id) group by 1)
select doc_id, case when n > 0 then 'completed' else 'failed' end as status, case when n > 0 then 'completed' else 'failed' end as embeddings_status,
  case when n > 0 and doc_id % 10 <> 3 then 'completed' else 'failed' end as bm25_status, case when n > 0 then 100 else 0 end::int as progress, n as chunk_count, case when n = 0 then 'no text' end as error from n""",
    "source_listing": f"""with {DENSE.format(where="")},
f as (select qid, r.id, rank, round(score, 4) as score, source, replace(trim(text), chr(10), ' ') as flat from r join documents on doc_id = r.id where rank <= 5)
select qid, string_agg('- ' || source || ' (chunk ' || id % 7 || ', score ' || printf('%.4f', score) || '): ' || case when length(flat) > 200 then substr(flat, 1, 200) || '…' else flat end, chr(10) order by rank) as listing,
  round(avg(score), 6) as confidence, count(distinct id) as documents from f group by qid""",
    "retrieve_by_document": f"with {DENSE.format(where='and e.label = 3')} select qid, id, round(score, 6) as score, rank from r where rank <= 5",
    "retrieval_recall": f"""with {DENSE.format(where="")}, h as (select * from r where rank <= 10), q as (select distinct qid, (qid // 50) % 4 as k from h)
select qid, case k when 0 then (exists (select 1 from h where h.qid = q.qid and id = q.qid and rank = 1))::int when 1 then (exists (select 1 from h where h.qid = q.qid and id = q.qid + 1))::int
  when 3 then (exists (select 1 from h where h.qid = q.qid and rank = 10))::int end::double as recall from q""",
    "collection_stats": "select source as collection, count(*) as documents, sum(length(text))::bigint as size, bool_and(doc_id % 50 <> 0) as ready from documents group by 1",
}
