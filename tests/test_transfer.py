import pytest
from compare import rows
from pyspark.sql import functions as F

from lodestone.operators import transfer
from lodestone.operators.store import fresh_folder
from lodestone.operators.transfer import Include, TransferError, import_into

SHAPES = {
    "collections": "id string, name string, embedding_model string, embedding_dimension int",
    "documents": "id string, collection_id string, text string",
    "vectors": "id string, document_id string, embedding array<float>",
    "conversations": "id string, collection_id string",
    "messages": "id string, conversation_id string, sources array<struct<document_id:string,chunk_index:int>>",
}


def made(spark, **data):
    return {n: spark.createDataFrame(data.get(n, []), s) for n, s in SHAPES.items()}


@pytest.fixture(scope="module")
def old(spark):
    return made(spark, collections=[("a", "A", "m", 2), ("b", "B", "m", 2)], documents=[("d1", "a", "one"), ("d2", "b", None)], vectors=[("v1", "d1", [1.0, 0.0])], conversations=[("c1", "a")], messages=[("m1", "c1", [("d1", 0), ("gone", 1)]), ("m2", "c1", None)])


def one(spark, name="A2", **more):
    return made(spark, **({"collections": [("a", name, "m", 2)], "documents": [("d1", "a", "new"), ("d9", "a", "nine")], "vectors": [("v1", "d1", [0.0, 1.0]), ("v8", "lost", [0.0, 1.0])], "conversations": [("c1", "a"), ("c9", "a")], "messages": [("m1", "c9", [("d9", 0), ("gone", 1)]), ("m8", "lost", None)]} | more))


def report(r):
    return {x.name: (x.created, x.updated, x.orphans) for x in r.collect()}


def test_an_export_reads_back_as_it_was(spark, old):
    folder = fresh_folder(spark, "export")
    said = transfer.export(old, spark.createDataFrame([("a",)], "id string"), folder)
    archive, metadata = transfer.read(spark, folder)
    assert metadata == said and metadata["include"] == {"documents": True, "vectors": True, "chats": True}
    assert {n: rows(df) for n, df in archive.items()} == {n: rows(df.where(c)) for (n, df), c in zip(old.items(), ["id = 'a'", "id = 'd1'", "true", "true", "true"], strict=True)}
    tables, said = import_into(made(spark), archive)
    assert {n: rows(df) for n, df in tables.items()} == {n: rows(df) for n, df in archive.items()}
    assert report(said) == {"collections": (1, 0, 0), "documents": (1, 0, 0), "vectors": (1, 0, 0), "conversations": (1, 0, 0), "messages": (2, 0, 0)}


def test_merging_replaces_adds_and_counts_orphans(spark, old):
    tables, said = import_into(old, one(spark), mode="merge")
    assert report(said) == {"collections": (0, 1, 0), "documents": (1, 1, 0), "vectors": (0, 1, 1), "conversations": (1, 1, 0), "messages": (0, 1, 1)}
    assert {(r.id, r.text) for r in tables["documents"].collect()} == {("d1", "new"), ("d2", None), ("d9", "nine")}
    assert {(r.id, r.name) for r in tables["collections"].collect()} == {("a", "A2"), ("b", "B")}
    again, said = import_into(tables, one(spark), mode="merge")
    assert all(rows(again[n]) == rows(tables[n]) for n in tables) and {x.created for x in said.collect()} == {0}


def test_new_ids_keep_what_belongs_together(spark, old):
    for _ in range(2):
        tables, said = import_into(old, one(spark), salt="x")
        assert report(said)["documents"] == (2, 0, 0)
        fresh = {n: df.join(old[n].select("id"), "id", "left_anti") for n, df in tables.items()}
        ids = {n: {r.id for r in df.collect()} for n, df in fresh.items()}
        assert {r.collection_id for r in fresh["documents"].collect()} == ids["collections"]
        assert {r.document_id for r in fresh["vectors"].collect()} <= ids["documents"]
        m = fresh["messages"].first()
        assert m.conversation_id in ids["conversations"] and m.sources[0].document_id in ids["documents"] and m.sources[1].document_id == "gone"


def test_a_target_takes_documents_and_chats_and_stays(spark, old):
    tables, said = import_into(old, one(spark), mode="merge", target="b")
    assert report(said)["collections"] == (0, 1, 0) and rows(tables["collections"]) == rows(old["collections"])
    assert {r.collection_id for r in tables["documents"].where("id in ('d1', 'd9')").collect()} == {"b"}


@pytest.mark.parametrize(
    ("how", "more", "said"),
    [
        ({"mode": "skip"}, {}, "neither"),
        ({}, {}, "there already"),
        ({"target": "a"}, {}, "for mode merge"),
        ({"mode": "merge", "target": "zz"}, {}, "no collection"),
        ({"mode": "merge", "target": "a"}, {"collections": [("a", "A", "other", 2)]}, "others than"),
        ({"mode": "merge", "target": "a"}, {"collections": []}, "one collection"),
        ({"mode": "merge"}, {"documents": [("d5", "zz", "x")]}, "aren't in the archive"),
        ({"mode": "merge"}, {"conversations": [("c5", "zz")]}, "aren't in the archive"),
    ],
)
def test_what_cannot_be_brought_in_changes_nothing(spark, old, how, more, said):
    with pytest.raises(TransferError, match=said):
        import_into(old, one(spark, **more), **how)


def test_flags_collections_and_versions_are_checked_up_front(spark, old):
    for bad in ({"documents": False}, {"documents": False, "chats": False}, {"documents": False, "vectors": False}):
        with pytest.raises(TransferError):
            Include(**bad)
    assert Include(False, False, False).tables() == ["collections"]
    folder = fresh_folder(spark, "export")
    gone = old | {"collections": old["collections"].withColumn("is_deleted", F.col("id") == "a")}
    for tables, ids in ((old, ["a", "zz"]), (gone, ["a"])):
        with pytest.raises(TransferError, match="not there"):
            transfer.export(tables, spark.createDataFrame([(i,) for i in ids], "id string"), folder)
    with pytest.raises(TransferError, match="no vectors"):
        import_into(old, {n: df for n, df in one(spark).items() if n != "vectors"}, mode="merge")
    spark.createDataFrame([('{"version": 9}',)], "value string").write.text(f"{folder}/metadata")
    with pytest.raises(TransferError, match="version 9"):
        transfer.read(spark, folder)
