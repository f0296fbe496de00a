"""Toxicity scores by non-negative positive-unlabelled learning on word and word-beginning features."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import Scratch, bucket_of, pieces, small_batches, spread, table, unused

#: Most rows of either kind that the classifier is fitted on, and most features that it keeps.
SAMPLE, FEATURES = 6000, 60000
#: Standard errors by which a feature must stand out among positives.
SIGMAS = 5.0
WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word and its beginnings of 4, 5 and 6 letters."""
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k)]


def features_in(text: str | None) -> set[str]:
    return {f for w in words_of(text) for f in features_of(w)}


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, p, u): how many positive and unlabelled texts of a batch have it."""
    for b in pieces(batches):
        found: dict[str, list[int]] = {}
        for p, u, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for f in features_in(text):
                n = found.setdefault(f, [0, 0])
                n[0] += p
                n[1] += u
        n = np.array(list(found.values()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["feature", "p", "u"])


class PuModel:
    """Additive weights; score = sigmoid(bias + sum of the weights of a text's distinct features)."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))

    def score(self, text: str | None) -> float:
        return _sigmoid(self.bias + sum(sorted(self.weights.get(f, 0.0) for f in features_in(text))))


def _sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def clearness(np_: int, nu: int) -> Column:
    """Standard errors by which a feature's share among positives exceeds that among unlabelled texts."""
    p, u = F.col("p"), F.col("u")
    both = (p + u) / F.lit(float(np_ + nu))
    return (p / F.lit(float(np_)) - u / F.lit(float(nu))) / F.sqrt(F.greatest(F.lit(1e-12), both * (1 - both) * F.lit(1 / np_ + 1 / nu)))


def fit_nnpu(positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], names: list[str], prior: float, steps: int = 250, rate: float = 0.1, decay: float = 2e-4) -> PuModel:
    """Logistic loss under the non-negative risk prior * R_p+ + max(0, R_u- - prior * R_p-).

    Either kind of text comes as (numbers of the features in `names`, number of the text that has each, how many texts).
    Where the bracket turns negative, the step goes up its gradient instead, as the estimator demands. In the end the
    bias is set so that the unlabelled texts' mean score is the prior.
    """
    (ip, rp, np_), (iu, ru, nu) = positive, unlabelled
    if not np_ or not nu:
        return PuModel({}, -30.0)
    size = len(names)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        zp = np.bincount(rp, w[ip], np_) + w[-1]
        zu = np.bincount(ru, w[iu], nu) + w[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # derivatives by z of prior * softplus(-z_p), and of softplus(z_u) - prior * softplus(z_p)
        a, bp, bu = -prior * (1 - sp) / np_, -prior * sp / np_, su / nu
        cp, cu = (a + bp, bu) if risk >= 0 else (-bp, -bu)
        g = np.zeros(size + 1)  # of floats even where there is no feature at all
        g += np.bincount(ip, cp[rp], size + 1)
        g += np.bincount(iu, cu[ru], size + 1)
        g[-1] += cp.sum() + cu.sum()
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = np.where(np.abs(w[:-1]) > 1e-4, w[:-1], 0)
    low, high, z = -60.0, 60.0, np.bincount(ru, weights[iu], nu)
    for _ in range(60):  # the bias at which unlabelled texts score the class prior on average, which a few positives don't fix
        bias = (low + high) / 2
        low, high = (low, bias) if (1 / (1 + np.exp(-np.clip(z + bias, -30, 30)))).mean() > prior else (bias, high)
    return PuModel({f: float(x) for f, x in zip(names, weights, strict=True) if x}, float(bias))


def train(docs: DataFrame, labels: DataFrame, usable=None, most: int = SAMPLE) -> PuModel:
    """Fit on texts whose label is toxic = 1 (positives) and on texts of all kinds, labels unseen (unlabelled).

    Features are those of at least three positives whose share among positives exceeds that among unlabelled texts by
    SIGMAS standard errors, the clearest first; most words say nothing, and their many weights would only fit noise.
    They are counted and chosen in Spark; the driver gets the numbers of the chosen ones in each text of the sample.
    `usable` is a condition on doc_id; only such rows take part, and none without doc_id. The class prior is the toxic
    share among all usable labelled rows. The sample is that of at most `most` positive ids, those of least hash, and
    of about `most` ids of any kind, by a hash as well, so the same at every run; texts aren't shuffled for it, and it
    is written once. A document labelled both ways counts as toxic. No toxic row, or no rows at all, gives a model that
    scores every text 0; no feature that stands out, one that scores every text alike (the prior).
    """
    usable = F.lit(True) if usable is None else usable
    spark = docs.sparkSession
    scratch = Scratch(spark)
    marks = labels.select("doc_id", "toxic").where(usable & F.col("toxic").isNotNull())
    n, pos = marks.agg(F.count("*"), F.count(F.when(F.col("toxic") == 1, 1))).first()
    if not pos:
        return PuModel({}, -30.0)
    total = docs.where(usable).count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, most / max(total, 1))) + 1
    own = docs.where(usable & F.col("doc_id").isNotNull()).select("doc_id", "text")
    known = marks.where("toxic = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    known = scratch.keep("known", known.select(F.col("doc_id").alias("known")))
    flagged = own.join(F.broadcast(known), own["doc_id"] == F.col("known"), "left")  # at most `most` numbers
    sample = flagged.select(F.col("known").isNotNull().cast("int").alias("p"), share.cast("int").alias("u"), "text").where("p + u > 0")
    sample = scratch.keep("sample", sample.repartition(spark.sparkContext.defaultParallelism))
    np_, nu = sample.agg(F.sum("p"), F.sum("u")).first()
    if not np_ or not nu:
        scratch.drop("known", "sample")
        return PuModel({}, -30.0)
    counts = sample.mapInArrow(_counts, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    clear = counts.where("p >= 3").withColumn("z", clearness(np_, nu)).where(F.col("z") >= SIGMAS)
    names = [r.feature for r in clear.orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").collect()]
    index = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})  # at most FEATURES words

    def numbers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index.value
        for b in pieces(batches):
            own = [sorted(at[f] for f in features_in(t) if f in at) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.list_(pa.int32()))], names=["p", "u", "ids"])

    rows = sample.mapInArrow(numbers, "p int, u int, ids array<int>").collect()
    scratch.drop("known", "sample")

    def group(kind: int) -> tuple[np.ndarray, np.ndarray, int]:
        ids = sorted(r.ids for r in rows if r[kind])  # in one order, so that sums are the same at every run
        lengths = [len(x) for x in ids]
        return np.fromiter((i for x in ids for i in x), np.int64, sum(lengths)), np.repeat(np.arange(len(ids)), lengths), len(ids)

    return fit_nnpu(group(0), group(1), names, min(0.9, pos / n))


def _scored(docs: DataFrame, model: PuModel, threshold: float, score: str, predicted: str) -> DataFrame:
    """docs with two more columns, whose names are none of its own."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value.weights, sent.value.bias
        known: dict[str, tuple[str, ...]] = {}
        for b in pieces(batches):
            out = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                hit: set[str] = set()
                for w in words_of(text):
                    f = known.get(w)
                    if f is None:
                        if len(known) > 400_000:
                            known.clear()
                        f = known[w] = tuple(x for x in features_of(w) if x in weights)
                    if f:
                        hit.update(f)
                out.append(_sigmoid(bias + sum(sorted(weights[f] for f in hit))))
            s = np.array(out)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names, score, predicted])

    schema = StructType([*docs.schema.fields, StructField(score, DoubleType()), StructField(predicted, IntegerType())])
    return docs.mapInArrow(scored, schema)


def score_texts(docs: DataFrame, model: PuModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold); only `text` is an input.

    Null, empty and wordless texts get the bias alone. Repeated rows are scored each; an empty table stays empty.
    Columns named score or predicted are replaced.
    """
    return _scored(docs.select(*[c for c in docs.columns if c not in ("score", "predicted")]), model, threshold, "score", "predicted")


def held_out(key: str = "doc_id"):
    """A doc_id that is null is in no fold that is held out."""
    return F.coalesce(bucket_of(key, 4) == 2, F.lit(False))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic; columns as they are, also those named score or predicted."""
    model = train(docs, labels, ~held_out())
    score, predicted = unused("score", docs), unused("predicted", docs)
    return _scored(docs, model, THRESHOLD, score, predicted).where(F.col(predicted) == 0).select(*docs.columns)


def op9_toxicity(spark, sf_dir):
    """doc_id, held_out, score and predicted per row of `documents`; a null doc_id is not held out, null and empty texts
    get the bias, repeated rows are scored each."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score_texts(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
