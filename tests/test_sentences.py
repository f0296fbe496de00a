import pytest

from pyspark.sql import functions as F

from lodestone.operators import sentences


def corpus(spark):
    english = ["The court met Dr. Brown and Mr. Lee at noon. It was late. The Dr. said no.", "We saw approx. ten houses, e.g. two small ones. The rest were gone.", "Ask Mr. Hill or Dr. Ray. The end came soon. It rained."]
    german = ["Das kostet ca. zehn Euro bzw. neun. Die Firma zahlt ca. die Summe.", "Es gibt z.B. Brot bzw. Kuchen. Die Leute kamen. Das war gut.", "Wir warten ca. eine Stunde. Die Bahn kam. Das Haus, z.B. am See, ist alt."]
    plain = ["At noon they were gone too late for the ones who said no so soon, and it rained", "Es war alt und gut, eine Stunde lang kam nur neun und Kuchen und die Summe kamen vor"]
    return spark.createDataFrame([(t,) for t in (english + german + plain) * 30] + [(None,), ("",)], "text string")


@pytest.fixture(scope="module")
def known(spark):
    return sentences.learn(corpus(spark))


def cut(spark, text, known=((), ())):
    got = spark.createDataFrame([(text,)], "text string").select(sentences.split("text", known)).first()[0]
    return got if got is None else [s.strip() for s in got]


def test_abbreviations_of_two_languages_are_learned(known):
    assert {"dr", "mr", "ca", "bzw", "z.b", "e.g"} <= set(known[0])
    assert not {"noon", "gone", "alt", "stunde", "the"} & set(known[0])
    assert {"the", "die", "das", "it"} <= set(known[1])


def test_they_end_no_sentence(spark, known):
    assert cut(spark, "Call Dr. Brown now. He waits.", known) == ["Call Dr. Brown now.", "He waits."]
    assert cut(spark, "Es gibt ca. zehn z.B. heute! Ja?", known) == ["Es gibt ca. zehn z.B. heute!", "Ja?"]
    assert cut(spark, "Call Dr. Brown now.") == ["Call Dr.", "Brown now."]
    # a known starter with a capital letter ends it all the same
    assert cut(spark, "He met the Dr. The rest left.", known) == ["He met the Dr.", "The rest left."]


def test_sentences_put_together_are_the_text(spark, known):
    for text in ('He said "no." Then (he left.) And\n\nso on', "  a. b!c? d", "x" * 5000 + ". y", "¿Qué? ¡No! …", "a\x01b. c"):
        df = spark.createDataFrame([(text,)], "text string").select(sentences.split("text", known).alias("s"))
        assert "".join(df.first().s) == text.replace("\x01", " ")
    assert cut(spark, None, known) is None and cut(spark, " \n ", known) == [] and cut(spark, "", known) == []
    assert cut(spark, 'He said "no." Then (he left.) So', known) == ['He said "no."', "Then (he left.)", "So"]


def test_a_corpus_without_periods_or_words_teaches_nothing(spark):
    for texts in ([], [("no end here",)], [("... 1. 2.",), (None,)]):
        assert sentences.learn(spark.createDataFrame(texts, "text string")) == ([], [])


def test_texts_are_cut_once_and_counts_teach_the_same(spark):
    texts = ["Dr. Smith met Mr. Jones. The end.", "See Dr. Who etc. and so on. The rest.", None] * 20
    seen = spark.sparkContext.accumulator(0)

    def look(t):
        seen.add(1)
        return t

    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    watched = docs.select(F.udf(look, "string").asNondeterministic()("text").alias("text"))
    got = sentences.learn(watched)
    assert seen.value == len(texts)
    found = sentences.tokens(docs)
    plain = sentences.abbreviations(found)
    shown = lambda df: sorted((r.word, round(r.score, 9)) for r in df.collect())
    assert shown(sentences.abbreviations(sentences.counted(found))) == shown(plain)
    assert shown(sentences.starters(sentences.counted(found), plain)) == shown(sentences.starters(found, plain))
    assert "dr" in got[0]


def test_no_word_is_dropped_however_many_are_learned(spark):
    letters = "bcdfghjklmnpqrstvwxyzä"
    short = sorted(f"{a}{b}{c}" for a in letters for b in letters for c in letters)
    filler = " plain words without end" * 60
    texts = [f"See {' x '.join(f'{w}. Other' for w in short[i : i + 10])}{filler}" for i in range(0, len(short), 10)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-1, "Ask bbb. Other end. Then")], "id long, text string").repartition(4)
    got = sentences.learn(docs)
    assert len(short) > 10_000 and set(short) <= set(got[0])
    out = sentences.split_rows(docs, sentences.learned(docs))
    assert out.columns == ["id", "text", "s"]
    rows = out.collect()
    assert len(rows) == len(texts) + 2
    assert {len(r.s) for r in rows if r.id >= 0} == {1}  # all of its periods belong to abbreviations
    assert [[s.strip() for s in r.s] for r in rows if r.id == -1 and r.s is not None] == [["Ask bbb. Other end.", "Then"]]
    assert [r.s for r in rows if r.text is None] == [None]


def test_rows_are_split_as_by_lists(spark, known):
    texts = ['He said "no." Then (he left.) And\n\nso on', "He met the Dr. The rest left.", "Call Dr. Brown now. He waits.", "ca. z.B. \"Dr.\" Die Frau", "Call Dr. Brown now. He waits.", "a\x01b. c", None, "", "\t Dr.\n\tThe end. ... ."]
    docs = spark.createDataFrame([(7, t) for t in texts], "id int, text string")
    table = spark.createDataFrame([(k, w) for k, ws in zip((sentences.SHORT, sentences.FIRST), known, strict=True) for w in ws], "kind string, word string")
    shown = lambda df: sorted(str(tuple(r)) for r in df.select("id", "text", "s").collect())
    assert shown(sentences.split_rows(docs, table)) == shown(docs.withColumn("s", sentences.split("text", known)))
    assert shown(sentences.split_rows(docs, table.limit(0))) == shown(docs.withColumn("s", sentences.split("text")))
