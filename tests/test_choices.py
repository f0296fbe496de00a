import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import settings

A, B = "00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000b"


@pytest.mark.parametrize(
    ("wanted", "voyage", "cohere", "want"),
    [("auto", "k", "k", "voyage"), (None, None, "k", "cohere"), (" Cohere ", "k", "k", "cohere"), ("voyage", " ", "k", None), ("other", "", "k", "cohere"), ("auto", None, None, None), ("cohere", "k", None, None), ("", "k", None, "voyage")],
)
def test_the_reranker_has_a_key(spark, wanted, voyage, cohere, want):
    df = spark.createDataFrame([(wanted, voyage, cohere)], "w string, v string, c string")
    assert df.select(settings.reranker("w", {"voyage": F.col("v"), "cohere": F.col("c")})).first()[0] == want
    assert df.select(settings.reranker("w", {})).first()[0] is None


@pytest.mark.parametrize(
    ("request_", "saved", "use", "want"),
    [([B], [A], True, [B]), ([], [A], True, []), (None, [A.upper(), "bad", B], True, [A, B]), (None, [A], False, None), (None, [A], None, None), (None, ["bad"], True, None), (None, [], True, None), (None, None, True, None)],
)
def test_a_request_wins_over_the_conversation(spark, request_, saved, use, want):
    df = spark.createDataFrame([(request_, saved, use)], "r array<string>, s array<string>, u boolean")
    assert df.select(settings.document_filter("r", "s", "u")).first()[0] == want


@pytest.mark.parametrize(("listed", "want"), [(None, {"a", "b"}), ("", {"a", "b"}), ("b, c", {"b", "c"}), ('["c"]', {"c"}), (" , ", {"a", "b"})])
def test_tools_by_the_list_that_is_set(spark, listed, want):
    df = spark.createDataFrame([(t, listed) for t in "abc"], "t string, l string")
    assert {r.t for r in df.where(settings.enabled("t", "l", ("a", "b"))).collect()} == want


def test_keys_titles_and_missing_vectors(spark):
    rows = spark.createDataFrame([("a", None), ("b", " ")], "key string, title string")
    assert settings.any_key(rows, ["z", "b"]) and not settings.any_key(rows, ["z"]) and not settings.any_key(rows.limit(0), ["a"])
    assert [r.key for r in settings.untitled(rows).collect()] == ["a"]
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([1.0],)], "e array<float>").select(vectors.filled("e", 2).alias("e"))
    assert [r.e for r in df.collect()] == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]]
    assert [r[0] for r in df.select(vectors.cosine("e", F.array(F.lit(2.0), F.lit(4.0)))).collect()] == pytest.approx([1.0, 0.0, 0.0])
