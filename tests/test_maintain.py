import random

import pytest
from compare import rows
from pyspark.sql import functions as F

from lodestone.operators import dense, lexical
from lodestone.operators.lexical_index import LexicalIndex
from lodestone.operators.store import fresh_folder
from lodestone.operators.vector_store import VectorStore
from lodestone.streaming import maintain

CHANGE = "id long, text string, embedding array<float>, deleted boolean, ts long"


def changes(seed, n, start):
    draw = random.Random(seed)
    vec = lambda: [draw.uniform(-1, 1) for _ in range(4)]
    return [(draw.randint(1, 60), draw.choice([None, "", f"w{draw.randint(1, 9)} w{draw.randint(1, 9)}"]), draw.choice([None, vec(), vec(), vec()]), draw.choice([None, False, False, True]), start + i // 2) for i in range(n)]


def left(files):
    """A plain loop over the batches: what each id is in the end."""
    state = {}
    for file in files:
        best = {}
        for i, text, v, gone, ts in file:
            key = (ts, bool(gone), text is not None, text or "")
            if i is not None and (i not in best or key > best[i][0]):
                best[i] = (key, text, v, bool(gone))
        for i, (_, text, v, gone) in best.items():
            state.pop(i, None)
            if not gone:
                state[i] = (text, v)
    return state


@pytest.fixture(scope="module")
def files():
    out = [changes(s, 80, 100 * s) for s in range(3)]
    # times and texts that tie would leave it open which vector counts
    return [list({(r[0], r[4]): r for r in f}.values()) + [(None, "lost", None, None, 1)] for f in out]


def run(spark, files, folder, crash=None, monkeypatch=None):
    source = f"{folder}/in"
    index = LexicalIndex.create(spark, f"{folder}/index")
    store = VectorStore(spark, f"{folder}/vectors")
    store.create("c", 4)
    for n, f in enumerate(files):
        spark.createDataFrame(f, CHANGE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CHANGE).parquet(source)
        if crash and n == 1:
            with monkeypatch.context() as m, pytest.raises(Exception, match="power cut"):
                crash(m)
                maintain.maintain(stream, "docs", index, store, "c", folder).awaitTermination()
        maintain.maintain(stream, "docs", index, store, "c", folder).awaitTermination()
    return index, store


def state(spark, index, store, folder):
    return rows(index.scan()), rows(store.rows("c").select("id", "embedding")), rows(maintain.progress(spark, f"{folder}/progress"))


def lexical_cut(m):
    real = VectorStore.remove
    m.setattr(VectorStore, "remove", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("power cut")) if real else None)


def vector_cut(m):
    m.setattr(maintain, "record", lambda c, stage, b, p, real=maintain.record: (_ for _ in ()).throw(RuntimeError("power cut")) if stage == "done" else real(c, stage, b, p))


@pytest.mark.parametrize("crash", [lexical_cut, vector_cut])
def test_a_batch_that_fails_halfway_and_runs_again_gives_the_tables_of_one_run(spark, files, crash, monkeypatch):
    whole, broken = fresh_folder(spark, "whole"), fresh_folder(spark, "broken")
    one = state(spark, *run(spark, files, whole), whole)
    assert state(spark, *run(spark, files, broken, crash, monkeypatch), broken) == one


def test_both_stores_hold_what_a_plain_loop_leaves(spark, files):
    folder = fresh_folder(spark, "stream")
    log = maintain.BatchLog(spark, f"{folder}/log")
    spark.streams.addListener(log)
    try:
        index, store = run(spark, files, folder)
    finally:
        import time

        time.sleep(2)  # events come after the batches
        spark.streams.removeListener(log)
    want = left(files)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in want.items()], "id long, text string")
    vectors = spark.createDataFrame([(i, v) for i, (_, v) in want.items() if v], "id long, embedding array<float>")
    assert rows(index.scan()) == rows(lexical.corpus_terms(docs).select("id", "terms"))
    assert rows(store.rows("c").select("id", "embedding")) == rows(vectors)
    q = spark.createDataFrame([(1, "w1 w2"), (2, "w9")], "qid long, text string")
    shown = lambda f: rows(f.withColumn("score", F.round("score", 6)))
    assert shown(index.search(q, 4)) == shown(lexical.bm25(docs, q, 4))
    near = vectors.select(F.col("id").alias("qid"), "embedding")
    assert shown(store.search("c", near, 3)) == shown(dense.search(vectors, near, 3))
    assert {(r.stage, r.percent) for r in maintain.progress(spark, f"{folder}/progress").collect()} == {("done", 100)}
    done = spark.read.parquet(f"{folder}/log")
    assert done.agg(F.sum("rows")).first()[0] == sum(map(len, files)) and done.select("name").distinct().count() == 1


def test_percentages_stay_between_0_and_100(spark):
    df = spark.createDataFrame([(-5,), (40,), (130,)], "p int")
    assert [r[0] for r in df.select(maintain.clamped(F.col("p"))).collect()] == [0, 40, 100]


# --- evaluation runs


GOLD = "sample_id string, question string, answer string, document_id string, chunk_index int"


def test_a_run_that_was_broken_off_gives_what_an_unbroken_one_gives(spark, monkeypatch):
    from lodestone.operators import evalrun

    gold = [(f"s{i}", f"what is {i}", "__NO_ANSWER__" if i % 5 == 0 else f"it is {i}", None if i % 3 else str(i), None) for i in range(40)]
    samples = spark.createDataFrame(gold, GOLD)

    def service(question, settings):
        import time

        n = int(question.split()[-1])
        if n == 7:
            raise KeyError("model")
        if n == 8:
            time.sleep(30)
        return ("I don't know." if n % 10 == 0 else f"it is {n}", [(str(n // 2 * 2), settings["top_k"])])

    def shown(run):
        return rows(run.results().withColumn("sources", F.to_json("sources"))), rows(evalrun.summary(run.results()))

    one = evalrun.EvaluationRun.create(samples, fresh_folder(spark, "run"), {"top_k": 2}, part=7)
    assert one.status() == {"samples": 40, "processed": 0, "status": "running"} and one.results().count() == 0
    one.go(service, deadline=2)
    path, commit, calls = fresh_folder(spark, "run"), evalrun.Versions.commit, []
    two = evalrun.EvaluationRun.create(samples, path, {"top_k": 2}, part=7)
    with monkeypatch.context() as m:
        m.setattr(evalrun.Versions, "commit", lambda *a: commit(*a) if len(calls) < 3 and not calls.append(1) else (_ for _ in ()).throw(RuntimeError("power cut")))
        with pytest.raises(RuntimeError, match="power cut"):
            two.go(service, deadline=2)
    assert two.status()["status"] == "running" and 0 < two.status()["processed"] < 40
    again = evalrun.EvaluationRun.create(samples.limit(0), path, {"top_k": 99})
    assert again.settings() == {"top_k": 2}
    again.go(service, deadline=2)
    assert again.status() == one.status() == {"samples": 40, "processed": 40, "status": "completed"}
    assert shown(again) == shown(one)
    s = evalrun.summary(one.results()).first()
    assert (s.n, s.n_answerable, s.n_no_answer, s.n_errors, s.mean_em, s.mean_no_answer) == (40, 30, 8, 2, 1.0, 0.5)
    errors = {r.sample_id: r.error for r in one.results().where("error is not null").collect()}
    assert errors == {"s7": "'model'", "s8": "timeout after 2s"}
    want = [float(i % 2 == 0) for i in range(0, 40, 3) if i % 5]
    assert abs(s.mean_recall - sum(want) / len(want)) < 1e-9


def test_runs_without_samples_and_summaries_of_nothing(spark):
    from lodestone.operators import evalrun

    none = spark.createDataFrame([], GOLD)
    with pytest.raises(ValueError, match="no gold"):
        evalrun.EvaluationRun.create(none, fresh_folder(spark, "run"), {})
    some = spark.createDataFrame([("b", None, None, None, None), ("a", "q", "x", None, None)], GOLD)
    run = evalrun.EvaluationRun.create(some, fresh_folder(spark, "run"), {}, limit=1)
    run.go(lambda q, s: 1 / 0)
    s = evalrun.summary(run.results()).first()
    assert (s.n, s.n_errors, s.mean_em, s.mean_recall, s.mean_no_answer) == (1, 1, 0.0, None, None) and run.results().first().sample_id == "a"


def test_parts_of_a_run_are_answered_together(spark, monkeypatch):
    from lodestone.operators import evalrun

    samples = spark.createDataFrame([(f"s{i}", f"q{i}", f"q{i}", None, None) for i in range(40)], GOLD).repartition(3)
    run = evalrun.EvaluationRun.create(samples, fresh_folder(spark, "run"), {}, part=7)
    files = run._samples().select("part", F.input_file_name().alias("f")).distinct().groupBy("part").count().collect()
    assert len(files) > 4 and all(r["count"] == 1 for r in files)
    jobs, plain = [], evalrun.answered
    monkeypatch.setattr(evalrun, "answered", lambda *a: jobs.append(1) or plain(*a))
    run.go(lambda q, s: (q, []))
    assert len(jobs) == -(-run._run()["parts"] // spark.sparkContext.defaultParallelism) < len(files)
    assert sorted(r.pred for r in run.results().collect()) == sorted(f"q{i}" for i in range(40)) and run.status()["status"] == "completed"
