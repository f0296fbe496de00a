import io
import json
import tracemalloc
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import urls
from lodestone.operators import catalog, chat, chunk, context, dense, evaluate, fuse, lexical, settings, structure
from lodestone.plans import registry
from lodestone.sources import files
from lodestone.streaming import events


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


def test_diversity_zero_is_relevance_and_one_differs(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    c, q = e.select(F.col("vec_id").alias("id"), "embedding"), e.where("vec_id < 3").select(F.col("vec_id").alias("qid"), "embedding")
    plain = {(r.qid, r["rank"], r.id) for r in dense.search(c, q, 5).collect()}
    assert {(r.qid, r["rank"], r.id) for r in dense.diverse(c, q, 5, 0.0).collect()} == plain
    assert {(r.qid, r["rank"], r.id) for r in dense.diverse(c, q, 5, 1.0).collect()} != plain


def test_search_in_blocks_ties_zero_vectors_and_empty_tables(spark):
    c = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "id long, embedding array<double>")
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "qid long, embedding array<double>")
    got = dense.search(c, q, 3, block=2).collect()
    assert sorted((r.qid, r["rank"], r.id, r.score) for r in got) == [(i, k, d, s) for i in range(5) for k, d, s in ((1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0))]
    assert dense.search(c, q.limit(0), 3).count() == 0
    assert dense.search(c.limit(0), q, 3).count() == 0


def test_nearest_holds_a_tile_whatever_the_batch_and_ties_of_equal_vectors_go_to_the_smaller_id():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(2000, 16)), 3, axis=0)
    m = x[:3000] / np.linalg.norm(x[:3000], axis=1, keepdims=True)
    ids = rng.permutation(len(x))
    own = dense.Nearest(m, 5)
    tracemalloc.start()
    own.add(pa.array(ids), x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(m) * len(x) * 8 / 2  # all scores of the batch would be 144 MB, and their order as much again
    scores = np.round((m @ x.T) / np.linalg.norm(x, axis=1), 9)
    want = ids[np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]]
    assert (own.ids == want).all()
    split = dense.Nearest(m, 5)
    for at in range(0, len(x), 700):
        split.add(pa.array(ids[at : at + 700]), x[at : at + 700])
    assert (split.ids == own.ids).all() and (split.best == own.best).all()


def test_chunks_leave_a_batch_in_pieces():
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4], pa.int64()), pa.array(["ab " * 40, None, "", "c d. " * 60])], names=["doc_id", "text"])
    whole = [r for b in chunk._cut(docs, chunk.fixed, {"size": 50, "overlap": 10}) for r in b.to_pylist()]
    parts = list(chunk._cut(docs, chunk.fixed, {"size": 50, "overlap": 10}, 500))
    assert len(parts) > 3 and all(b.num_rows <= 3 for b in parts)
    assert [r for b in parts for r in b.to_pylist()] == whole and {r["doc_id"] for r in whole} == {1, 4}


def test_bm25_modes_and_phrase(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "red hen"), (3, "fox red"), (4, None), (5, "")], "id long, text string")
    q = spark.createDataFrame([(0, "red fox blue")], "qid long, text string")
    ids = lambda mode: {r.id for r in lexical.bm25(docs, q, 10, mode).collect()}
    assert ids("any") == {1, 2, 3} and ids("all") == set() and ids("balanced") == {1, 2, 3}
    assert {r.id for r in lexical.phrase(docs, spark.createDataFrame([(0, "red fox")], "qid long, text string")).collect()} == {1}


def test_fusion_one_sided_and_zero_maximum(spark):
    h = "qid long, id long, score double"
    d, x = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0)], h), spark.createDataFrame([(1, 2, 4.0), (1, 3, 2.0)], h)
    got = [(r.id, round(r.score, 3), r.source) for r in fuse.fuse(d, x, 5).orderBy("rank").collect()]
    assert got == [(2, 0.4, "hybrid"), (3, 0.2, "lexical"), (1, 0.0, "dense")]


@pytest.mark.parametrize(("query", "want"), [("Question 6 from EMA", "Question 6"), ("вопрос №6", "вопрос №6"), ("see стр. 42", "стр. 42"), ("the question asked 6 times", None), ("§ 5.3", "§ 5.3"), ("Глава 7", "Глава 7")])
def test_identifier(spark, query, want):
    assert one(spark, fuse.identifier("q"), q=query) == want


def test_window_and_budget(spark):
    hits = spark.createDataFrame([(1, 7, 0, 0.9, 1), (1, 7, 1, 0.5, 2)], "qid long, document_id long, chunk_index int, score double, rank int")
    chunks = spark.createDataFrame([(7, i) for i in range(4)], "document_id long, chunk_index int")
    got = [(r.chunk_index, r.score, r.source) for r in context.expand(hits, chunks, 1).orderBy("place").collect()]
    assert got == [(0, 0.9, "hit"), (1, 0.5, "hit"), (2, 0.0, "window")]
    assert context.expand(hits, chunks, 0).count() == 2
    rows = spark.createDataFrame([(1, 1, "a", 0, "x" * 10), (1, 2, "b", 0, "y" * 500), (1, 3, "c", 0, "z")], "qid long, rank int, name string, chunk_index int, text string")
    assert context.pack(rows, 100).first().n_sources == 1
    assert context.pack(rows, 0).first().n_sources == 3
    assert context.pack(rows, 5).first().context == ""


def test_chunkers():
    got = list(chunk.fixed("x" * 50, 20, 5))
    assert [s for s, _, _ in got] == [0, 15, 30, 45]
    text = "One sentence here. " * 60
    for cut in (chunk.fixed, chunk.recursive):
        parts = list(cut(text, 200, 40))
        assert all(len(c) <= 200 for _, _, c in parts)
        covered = set()
        for a, b, _ in parts:
            covered.update(range(a, b))
        assert set(range(len(text.strip()))) <= covered
    assert all(text[a:b].strip() == c for a, b, c in chunk.recursive(text, 200, 40))
    assert list(chunk.semantic("")) == [] and list(chunk.fixed("  ")) == []
    assert " ".join(c for _, _, c in chunk.semantic("Cats purr. Cats sleep. Rockets fly. Rockets burn.")).split() == "Cats purr. Cats sleep. Rockets fly. Rockets burn.".split()
    with pytest.raises(ValueError):
        chunk.check(10, 10)


def test_columns_chunk_like_the_loop(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {(r.doc_id, i * 350) for r in docs.collect() for i in range(1 if len(chunk.tidy(r.text)) <= 400 else -(-len(chunk.tidy(r.text)) // 350)) if chunk.tidy(r.text)[i * 350 : i * 350 + 400].strip()}
    assert {(r.doc_id, r.start_char) for r in chunk.chunk_plain(docs, 400, 50).collect()} == want


def test_headings_paths_and_pages(spark):
    md = "# A\ntext\n## B\n### C\nx\n## D\n"
    rows = spark.createDataFrame([(md,)], "t string").select(structure.headings("t").alias("h"))
    assert [(h.pos, h.level, h.text) for h in rows.first().h] == [(0, 1, "A"), (9, 2, "B"), (14, 3, "C"), (22, 2, "D")]
    paths = rows.select(*[structure.section_path("h", F.lit(at)).alias(f"p{at}") for at in (20, 25)]).first()
    assert paths.p20 == ["A", "B", "C"] and paths.p25 == ["A", "D"]


def test_tables_and_layout(spark):
    assert one(spark, structure.table_markdown(F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1"))))) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    blocks = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 50.0, 50.0, 60.0, 60.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    assert structure.outside_tables(blocks, blocks.limit(1)).count() == 1
    heads = spark.createDataFrame([(1, i, "H") for i in range(4)] + [(1, 9, "K")], "doc_id long, pos int, text string")
    assert sorted(r.pos for r in structure.distinct_headings(heads).collect()) == [0, 9]


def test_text_and_url_functions(spark):
    assert one(spark, T.clean_title("q"), q='"What is it?"') == "What is it"
    assert one(spark, T.first_sentence("q"), q="Is it? Yes. No") == "Is it? Yes"
    assert one(spark, T.as_list("q"), q='["a", " b"]') == ["a", "b"] and one(spark, T.as_list("q"), q="a, b,,") == ["a", "b"]
    assert one(spark, T.as_bool("q"), q=" Yes ") is True and one(spark, T.masked("q"), q="abcdefgh") == "********efgh"
    assert one(spark, urls.clean("q"), q="http://a.b/c?utm_x=1&k=&k=2&FBCLID=3#f") == "http://a.b/c?k=&k=2"
    assert one(spark, urls.clean("q", F.lit("https://a.b/z")), q="http://a.b/c?x=1") == "https://a.b/z"
    assert one(spark, urls.file_name(F.lit("A/b: ü"), F.lit("http://h/x"))) == "A_b_ ü"
    assert one(spark, settings.file_error("n", "s"), n="a.exe", s=3) == "type" and one(spark, settings.file_error("n", "s"), n="../a.md", s=3) == "name"


def test_metrics(spark):
    rows = spark.createDataFrame([("The cat the", "the the dog"), ("", ""), ("I don't know", "__NO_ANSWER__")], "pred string, gold string")
    got = evaluate.metrics(rows).collect()
    assert [round(r.f1, 4) for r in got] == [0.6667, 0.0, 0.0] and [r.em for r in got] == [0.0, 1.0, 0.0] and got[2].no_answer == 1.0
    assert evaluate.summary(evaluate.metrics(rows.limit(0))).first().mean_f1 == 0.0


def test_sources_of_messages(spark):
    for raw, want in (('[{"document_id": "d", "chunk_index": 3, "content": "c"}]', ("d", 3, "c")), ("{bad", (None, None, None)), ("[]", (None, None, None))):
        assert tuple(one(spark, chat.first_source(F.col("s")), s=raw)) == want


def test_settings_ranges(spark):
    rows = spark.createDataFrame([(1, None, '{"top_k": 500}', None, None)], "id long, app string, collection string, conversation string, request string")
    assert settings.resolve(rows).select(settings.range_errors().alias("e")).first().e == ["top_k"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ntwo \xff\x00")
    r = files.read_text(spark, f"{tmp_path}/a.txt").first()
    assert (r.text, r.n_lines, r.n_words) == ("one\ntwo �", 2, 3)
    fb2 = "<FictionBook><description><title-info><author><first-name>A</first-name><last-name>B</last-name></author><book-title>T</book-title></title-info></description><body><section><title><p>Ch 1</p></title><p>Hello.</p></section></body></FictionBook>"
    (tmp_path / "b.fb2").write_text(fb2)
    (tmp_path / "c.fb2").write_text("not xml")
    got = {r.path[-5:]: r for r in files.read_parsed(spark, f"{tmp_path}/*.fb2", "fb2").collect()}
    assert (got["b.fb2"].text, got["b.fb2"].author, got["b.fb2"].headings[0].level) == ("Ch 1\n\nHello.", "A B", 1)
    assert got["c.fb2"].text == "not xml" and got["c.fb2"].error
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", doc)
    (tmp_path / "d.docx").write_bytes(buffer.getvalue())
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r.path[-6:]: r for r in files.read_parsed(spark, f"{tmp_path}/*.docx", "docx").collect()}
    assert got["d.docx"].text == "Head\n\nBody" and got["d.docx"].headings[0].level == 2 and got["e.docx"].text is None
    (tmp_path / "g.csv").write_text("question,answer,document_id,chunk_index\nQ1,,bad,x\n,A,,\nQ2,A2,00000000-0000-0000-0000-000000000001,4\n")
    rows = files.read_gold(spark, f"{tmp_path}/g.csv").orderBy("question").collect()
    assert [(r.question, r.answer, r.chunk_index) for r in rows] == [("Q1", "__NO_ANSWER__", None), ("Q2", "A2", 4)]
    (tmp_path / "g.json").write_text(json.dumps([{"question": "Q", "answer": "A", "chunk_index": 2}]))
    assert files.read_gold(spark, f"{tmp_path}/g.json").first().chunk_index == 2


def test_html():
    title, text, canonical = files.parse_html("<html><head><title> T &amp; U</title><link rel='canonical' href='http://x/y'><style>p{}</style></head><body><h1>Hi</h1><p>a  b</p><script>no</script></body></html>")
    assert (title, text, canonical) == ("T & U", "# Hi\n\na b", "http://x/y")


def test_catalog_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "k", "a"), (2, "l", "b")], "doc_id long, collection string, text string")
    catalog.write_export({"documents": docs}, str(tmp_path), docs.where("collection = 'k'"))
    back = catalog.read_export(spark, str(tmp_path), {"documents": "doc_id long, collection string, text string"})
    assert [tuple(r) for r in back["documents"].collect()] == [(1, "k", "a")]
    with pytest.raises(ValueError):
        catalog.page(docs, [F.col("doc_id")], 0, 10)


def test_streams_give_what_tables_give(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    q = events.tumbling(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(str(r.start), r.event_type, r.n) for r in events.tumbling(table).collect()}
    assert {(str(r.start), r.event_type, r.n) for r in spark.table("tumbled").collect()} == want


def test_ingestion_drops_repeated_contents(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:01:00"), (3, "b", "2024-01-01 00:02:00")], "doc_id long, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    q = events.ingest(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), lambda df, i: seen.extend(r.text for r in df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sorted(seen) == ["a", "b"]


def test_vectors_of_equal_texts_are_equal():
    assert np.array_equal(chunk.text_vector("a b"), chunk.text_vector("A  b"))


def test_bm25_of_long_queries_equals_the_join(spark):
    words = "red fox hen jumps over lazy dog again and blue".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i * j) % 10] for j in range(i % 13))) for i in range(60)] + [(60, None), (61, "zebra")], "id long, text string")
    q = docs.where("id % 7 = 0").selectExpr("cast(id as int) as qid", "text")
    want = {(r.qid, r.id, r["rank"], round(r.score, 9)) for r in lexical.bm25_joined(docs, q, 5).collect()}
    for pairs in (5, 10**6):
        assert {(r.qid, r.id, r["rank"], round(r.score, 9)) for r in lexical.bm25_long(docs, q, 5, pairs=pairs).collect()} == want
    assert lexical.bm25_long(docs, q.limit(0), 5).count() == 0


def test_phrase_compares_every_term(spark):
    docs = spark.createDataFrame([(1, "a b c d a b c d"), (2, "a b c e"), (3, "b c d"), (4, "x a b c d"), (5, None)], "id long, text string")
    q = spark.createDataFrame([(0, "a b c d"), (1, "A b c zzz"), (2, "c"), (3, "?"), (4, "b c b c")], "qid long, text string")
    got = {(r.qid, r.id, r.n) for r in lexical.phrase(docs, q).collect()}
    assert got == {(0, 1, 2), (0, 4, 1), (2, 1, 2), (2, 2, 1), (2, 3, 1), (2, 4, 1)}


def test_bm25_phrase_asks_whole_items(spark, tmp_path):
    spark.createDataFrame([(1, "so a b c d e"), (2, "a b c x e")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "A b c d e")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in registry.QUERIES["bm25_phrase"](spark, str(tmp_path)).collect()] == [(7, 1, 1)]


def test_running_headers_compare_whole_lines(spark, tmp_path):
    long = "This program is free software; you can redistribute it and or modify it "
    lines = [f"{long}{i}" if i % 40 == 0 else f"{long}always" if i % 40 == 1 else f"line {i}" for i in range(120)]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.text, r.n) for r in registry.QUERIES["pdf_running_headers"](spark, str(tmp_path)).collect()] == [(1, f"{long}always", 3)]


def test_bm25_phrase_clause_and_stop_words(spark):
    docs = spark.createDataFrame([(1, "fox the red hen"), (2, "the red fox hen"), (3, "red hat")], "id long, text string")
    q = spark.createDataFrame([(0, "red fox")], "qid long, text string")
    plain = {r.id: (r["rank"], r.score) for r in lexical.bm25(docs, q, 10).collect()}
    more = {r.id: (r["rank"], r.score) for r in lexical.bm25(docs, q, 10, use_phrase=True).collect()}
    assert [plain[i][0] for i in (1, 2)] == [1, 2] and [more[i][0] for i in (1, 2)] == [2, 1]
    assert more[2][1] == pytest.approx(2 * plain[2][1]) and more[1] == (2, plain[1][1])
    assert {(r.id, r.matched) for r in lexical.bm25(docs, q, 10, "all", stop=["red", "the"]).collect()} == {(1, 1), (2, 1)}


def test_sentences_times_and_ids_of_odd_texts(spark):
    from lodestone.functions import text as T

    def plain(text):
        out, pending = [], ""
        for c in text:
            pending += c
            if c in ".!?" and len(pending) > 1:
                out.append(pending.strip())
                pending = ""
        return [x for x in [*out, pending.strip()] if x]

    texts = ["", ".", "...", "a. b! c", "?!x.", "one\ntwo. \n\n", "..a..b", " .", "é…!?"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.sentence_list("t").alias("s")).collect()
    assert {r.t: r.s for r in got} == {t: plain(t) for t in texts}
    row = spark.createDataFrame([(None, "x", 5, None)], "a string, b string, n int, u array<string>")
    assert tuple(row.select(T.sentence_list("a"), T.parse_time("b"), T.missed_tokens(F.col("n"), F.lit(9)), T.uuids("u"), T.asks_for_question("a")).first()) == (None, None, 0, None, False)


def test_payloads_take_headings_and_pages(spark):
    from lodestone.operators import ingest

    docs = spark.createDataFrame([(1, "# A\nsome text\n## B\nmore text", "kb", "a.md", "md", [(0, 1, None), (15, 2, 7)], None), (2, "", "kb", "b.txt", "txt", [], None), (3, "x", "kb", "c", "txt", None, "processing")], "doc_id long, text string, collection string, name string, file_type string, pages array<struct<off:int,physical:int,logical:int>>, status string")
    rows, statuses = ingest.process(docs, 10, 0)
    found = [(r.start_char, r.section_path, r.section_level, r.page_number) for r in rows.orderBy("start_char").collect()]
    assert found == [(0, "A", 1, 1), (10, "A", 1, 1), (20, "A > B", 2, 7)]
    assert {r.doc_id: (r.status, r.chunk_count, r.error) for r in statuses.collect()} == {1: ("completed", 3, None), 2: ("failed", 0, "no text")}
    assert ingest.lexical_documents(rows).where("key = '1:2'").count() == 1
    again, _ = ingest.reprocess(rows, docs.where("doc_id = 1"), size=100, overlap=0)
    assert again.count() == 1


def test_the_latest_rating_counts_and_bytes_are_decoded(spark):
    from lodestone.operators import chat, evaluate
    from lodestone.sources import files

    talk = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    gold = spark.createDataFrame([], "source_id string, question string, answer string")
    for last, n in ((1, 1), (-1, 0)):
        rated = spark.createDataFrame([(1, 1, -last, 1), (1, 1, last, 2)], "conv_id long, turn long, rating int, rated_at int")
        assert chat.promote(gold, rated, talk).count() == n
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "b binary")
    assert [r[0] for r in raw.select(files.decode(F.col("b"))).collect()] == ["é", "é"]
    pairs = [("a b a", "a a c", 2 / 3), ("", "x", 0.0), ("a", "a", 1.0), ("a a a", "a", 0.5)]
    got = spark.createDataFrame(pairs, "p string, g string, want double").withColumn("f1", evaluate.token_f1("p", "g")).collect()
    assert all(abs(r.f1 - r.want) < 1e-9 for r in got)
    one = spark.createDataFrame([([("1", 0)],)], "s array<struct<document_id:string,chunk_index:int>>")
    assert one.select(evaluate.recall("s", F.lit(""), F.lit(None).cast("int"))).first()[0] is None
