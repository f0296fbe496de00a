"""Language of each word, and so of each document, by a linear-chain conditional random field."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, pieces, small_batches, spread, table

#: Runs of letters. As a class of `re`, the thousand numerals that are word characters would be tried one by one.
WORD = regex.compile(r"\p{L}+")
#: About so many training documents of each language, all words of each, in runs of so many words.
PER_LANGUAGE, RUN = 150, 24
#: Most features kept, least runs that a feature must occur in, words of each language's lexicon.
FEATURES, LEAST, LEXICON = 60_000, 3, 1500
#: Least steps, first rate and weight decay of the descent; words that a step sees and least passes over all words.
STEPS, RATE, DECAY, BATCH, PASSES = 60, 0.15, 1e-5, 20_000, 3
UNKNOWN = "und"
#: Distinct words whose weights a worker keeps.
CACHE = 400_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features_of(word: str, lexicons: dict[str, str]) -> list[str]:
    """The word, its affixes, its letter trigrams with the edges, and the lexicons that list it."""
    edged = f"^{word}$"
    grams = [edged[i : i + 3] for i in range(len(edged) - 2)]
    affixes = [f"{word[:k]}-" for k in (1, 2, 4) if len(word) > k] + [f"-{word[-k:]}" for k in (1, 2, 4) if len(word) > k]
    own = [f"={word}", *affixes, *grams]
    return [*own, f"@{lexicons[word]}"] if word in lexicons else own


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words of each text, cut into runs."""
    for b in pieces(batches):
        langs, runs = [], []
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = words_of(text)
            runs += [words[i : i + RUN] for i in range(0, len(words), RUN)]
            langs += [lang] * -(-len(words) // RUN)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(runs, pa.list_(pa.string()))], names=["lang", "words"])


def marginals(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    emit has a row of label scores per word, chains lie one after another; first and move are the scores of a chain's
    first label and of label pairs. Returns each word's label probabilities, the log partition sum of every chain and
    the expected number of each label pair. Chains are taken longest first, so step t touches the chains that reach it.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    peak = emit.max(axis=1, keepdims=True)
    e, m = np.exp(emit - peak), np.exp(move)
    k, longest = emit.shape[1], int(lengths[0]) if len(lengths) else 0
    live = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains longer than t
    a, scale = np.empty_like(e), np.empty(len(e))
    for t in range(longest):
        rows = starts[: live[t]] + t
        x = e[rows] * (np.exp(first) if t == 0 else a[rows - 1] @ m)
        scale[rows] = s = x.sum(axis=1)
        a[rows] = x / s[:, None]
    b, pairs = np.ones_like(e), np.zeros((k, k))
    for t in range(longest - 2, -1, -1):
        rows = starts[: live[t + 1]] + t
        after = e[rows + 1] * b[rows + 1] / scale[rows + 1][:, None]
        b[rows] = after @ m.T
        pairs += (a[rows].T @ after) * m
    logs = np.log(scale) + peak[:, 0]
    total = np.array([logs[s : s + n].sum() for s, n in zip(starts, lengths, strict=True)])
    out = np.empty(len(starts))
    out[order] = total
    return a * b, out, pairs


class Crf:
    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, first: np.ndarray, move: np.ndarray, lexicons: dict[str, str]):
        self.labels, self.index, self.weights, self.first, self.move, self.lexicons = labels, index, weights, first, move, lexicons

    def emissions(self, words: Iterable[str]) -> np.ndarray:
        """Label scores of each word."""
        found = [[self.index[f] for f in features_of(w, self.lexicons) if f in self.index] for w in words]
        out = np.zeros((len(found), len(self.labels)))
        sizes = np.array([len(x) for x in found], np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.concatenate([np.array(found[i], np.int64) for i in full])
            out[full] = np.add.reduceat(self.weights[flat], np.cumsum(sizes[full]) - sizes[full], axis=0)
        return out


def fit(runs: list[tuple[str, list[str]]], steps: int = STEPS) -> Crf:
    """Learn from runs of words of one language each. Neighbouring runs of a fixed shuffle are joined to chains of one
    to three runs, whose languages often differ, so that transitions learn where and how seldom a text switches.

    Each step descends on the next chains of about BATCH words, in turn, with a rate that falls to a twentieth; all
    words are passed over PASSES times or more, so that time grows with the words, not with words times steps."""
    labels = sorted({lang for lang, words in runs if words})
    runs = sorted((lang, tuple(words)) for lang, words in runs if words)
    random.Random(7).shuffle(runs)
    number = {x: i for i, x in enumerate(labels)}
    counts = {lang: Counter() for lang in labels}
    for lang, words in runs:
        counts[lang].update(words)
    lexicons: dict[str, str] = {}
    for lang in labels:
        for w, n in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if n >= LEAST and 2 * n > sum(c[w] for c in counts.values()):
                lexicons[w] = lang
    vocabulary = sorted({w for _, words in runs for w in words})
    place = {w: i for i, w in enumerate(vocabulary)}
    features = {w: features_of(w, lexicons) for w in vocabulary}
    seen: Counter = Counter()
    for _, words in runs:
        seen.update({f for w in set(words) for f in features[w]})
    kept = sorted((f for f, n in seen.items() if n >= LEAST), key=lambda f: (-seen[f], f))[:FEATURES]
    index = {f: i for i, f in enumerate(kept)}
    found = [[index[f] for f in features[w] if f in index] or [len(index)] for w in vocabulary]
    sizes = np.array([len(x) for x in found], np.int64)
    flat, cuts = np.concatenate([np.array(x, np.int64) for x in found]), np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(vocabulary)), sizes)

    word, gold, lengths, at, sizes_of = [], [], [], 0, random.Random(11)
    while at < len(runs):
        chain = runs[at : at + sizes_of.choice((1, 1, 2, 3))]
        at += len(chain)
        for lang, words in chain:
            word += [place[w] for w in words]
            gold += [number[lang]] * len(words)
        lengths.append(sum(len(words) for _, words in chain))
    word, gold, lengths = np.array(word), np.array(gold), np.array(lengths)
    k, ends = len(labels), np.cumsum(lengths)
    parts = []
    for chains in np.array_split(np.arange(len(lengths)), min(len(lengths), -(-len(word) // BATCH))):
        lo, hi, own = ends[chains[0]] - lengths[chains[0]], ends[chains[-1]], lengths[chains]
        w, y, starts, inner = word[lo:hi], gold[lo:hi], np.cumsum(own) - own, np.ones(hi - lo, bool)
        inner[starts] = False
        seen_pairs = np.zeros((k, k))
        np.add.at(seen_pairs, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
        parts.append((w, y, starts, own, np.bincount(y[starts], minlength=k), seen_pairs))
    steps = max(steps, PASSES * len(parts))
    weights, first, move = np.zeros((len(index) + 1, k)), np.zeros(k), np.zeros((k, k))
    parameters = [weights, first, move]
    mean, square = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        w, y, starts, own, seen_first, seen_pairs = parts[step % len(parts)]
        emit = np.add.reduceat(weights[flat], cuts, axis=0)[w]
        p, _, pairs = marginals(emit, starts, own, first, move)
        first_p = p[starts].sum(axis=0)
        p[np.arange(len(w)), y] -= 1
        by_word = np.stack([np.bincount(w, p[:, j], len(vocabulary)) for j in range(k)], axis=1)
        g = np.stack([np.bincount(flat, by_word[owner, j], len(index) + 1) for j in range(k)], axis=1)
        grads = [g / len(w) + DECAY * weights, (first_p - seen_first) / len(own), (pairs - seen_pairs) / len(w) + DECAY * move]
        rate = RATE * (1 - 0.95 * (step - 1) / max(1, steps - 1))
        for i, (x, d) in enumerate(zip(parameters, grads, strict=True)):
            mean[i] = 0.9 * mean[i] + 0.1 * d
            square[i] = 0.99 * square[i] + 0.01 * d * d
            x -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-9)
    return Crf(labels, index, weights, first, move, lexicons)


def train(docs: DataFrame, usable=None, per_language: int = PER_LANGUAGE) -> Crf | None:
    """Fit on text and lang of docs that meet `usable`, a condition on doc_id, and have a lang.

    Of each language about `per_language` documents are taken by a hash of doc_id, with all their words; that is the
    only sample. The languages that the corpus has are collected, and must be few. Rows without doc_id, lang or words
    teach nothing; None where nothing else is there.
    """
    usable = F.lit(True) if usable is None else usable
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(1_000_003 * min(1.0, per_language / n)) + 1)])
    limit = limits[F.col("lang")]
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < limit).select("lang", "text")
    rows = chosen.mapInArrow(_runs, "lang string, words array<string>").toArrow()
    runs = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
    return fit(runs) if any(w for _, w in runs) else None


class Labeller:
    """Labels batches of texts; keeps the label scores of words it has seen."""

    def __init__(self, model: Crf):
        self.model, self.place, self.scores, self.n = model, {}, np.empty((1024, len(model.labels))), 0

    def rows(self, words: list[str]) -> np.ndarray:
        if self.n > CACHE:
            self.place.clear()
            self.n = 0
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            while self.n + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            self.scores[self.n : self.n + len(new)] = self.model.emissions(new)
            self.place.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.n += len(new)
        place = self.place
        return self.scores[np.array([place[w] for w in words], np.int64)]

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all words of the texts, one text after another, and the number of words of each."""
        split = [words_of(t) for t in texts]
        lengths = np.array([len(x) for x in split], np.int64)
        if not lengths.sum():
            return np.empty((0, len(self.model.labels))), lengths
        emit = self.rows([w for x in split for w in x])
        full = lengths[lengths > 0]
        return marginals(emit, np.cumsum(full) - full, full, self.model.first, self.model.move)[0], lengths

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        p, lengths = self.words(texts)
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        full = np.flatnonzero(lengths)
        if len(full):
            mean = np.add.reduceat(p, np.cumsum(lengths[full]) - lengths[full], axis=0) / lengths[full][:, None]
            best = mean.argmax(axis=1)
            for i, j, row in zip(full, best, mean, strict=True):
                labels[i], scores[i] = self.model.labels[j], float(min(1.0, row[j]))
        return labels, scores


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row of docs from its text alone.

    Every word of the whole text gets label probabilities by forward-backward; the document's language is the one with
    the highest mean, and that mean is the score. A text that is null or has no letter is `und` with score 0, as is
    every text if there is no model. Repeated rows are labelled each; no shuffle.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return own.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES rows of weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for b in pieces(batches):
            labels, scores = labeller.documents(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    """A doc_id that is null is in no fold that is held out."""
    return F.coalesce(bucket_of(key, 3) == 1, F.lit(False))


def op5_language_id(spark, sf_dir):
    """doc_id, held_out, lang_pred and score per row of `documents`; a null doc_id is not held out, a text that is null
    or has no letter is `und`, repeated rows are labelled each."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = train(docs, ~held_out())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
