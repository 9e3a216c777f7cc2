"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in the features it holds: its words, and the beginnings of its words, by which
inflected and compound forms that no labelled row has are told by their stem. A document's is the noisy-or of its
sentences, one minus the product of their complements. Only documents have labels, so the gradient of the document's
loss is shared out over its sentences. A leak, one more cause for each document whatever its sentences, takes up labels
that no sentence explains, so that they don't raise every sentence's base rate (which would condemn long documents);
scores leave it out. The features that count are chosen by Spark over the sample (a bounded list, by likelihood ratio),
the model is fitted on a bounded sample of labelled rows, each text once, and scoring covers every whole text and names
the sentences that offend.

Defined cases: a null text counts as empty; a text without sentences scores 0; rows without a label, and labels
without a document, take no part in fitting; of repeated labels, and of the labels of equal texts, the larger counts;
repeated rows score alike; other columns are ignored; without rows of both labels the model has no words and scores 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bounds of what fitting reads and keeps.
SAMPLE_ROWS, VOCABULARY = 6000, 2000
#: Lengths of the beginnings of longer words that are features, written with a star.
STEMS = (3, 4, 5, 6, 7)
#: Words that a model remembers at most.
MEMORY = 1_000_000

SENTENCE = re.compile(r"[.!?…\n]+")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s.strip()]


def _letter(c: str) -> bool:
    """Whether ``WORD`` takes the character."""
    return c.isalnum() and not c.isdecimal()


def features(word: str) -> list[str]:
    """A word in lower case, and its beginnings."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


@dataclass
class Model:
    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)
    #: Words met before, with those of their features that have a weight.
    met: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False, compare=False)
    finder: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"met": {}, "finder": None}

    def _telling(self, words: set[str]) -> dict[str, tuple[str, ...]]:
        """Of the words, those with features that have a weight."""
        met, weights = self.met, self.weights
        if len(met) > MEMORY:
            met.clear()
        for w in words:
            if w not in met:
                met[w] = tuple(f for f in features(w) if f in weights)
        return {w: found for w in words if (found := met[w])}

    def _logit(self, telling: dict[str, tuple[str, ...]], words: set[str]) -> float:
        held = {f for w in words for f in telling.get(w, ())}
        return self.bias + sum(self.weights[f] for f in sorted(held))

    def logit(self, sentence: str) -> float:
        words = {*WORD.findall(sentence.lower())}
        return self._logit(self._telling(words), words)

    def _told(self, low: str) -> bool:
        """Whether a word of the text has a weight: an automaton finds weighted words and stems, their ends are looked at."""
        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for f in {f.removesuffix("*") for f in self.weights}:
                self.finder.add_word(f, (len(f), f in self.weights, f + "*" in self.weights))
            self.finder.make_automaton()
        for last, (size, word, stem) in self.finder.iter(low):
            if last >= size and _letter(low[last - size]):
                continue
            if stem if last + 1 < len(low) and _letter(low[last + 1]) else word:
                return True
        return False

    def score(self, text: str | None) -> float:
        """Noisy-or over the sentences of a whole text. Where no word has a weight, their number is enough."""
        if not text or not self.weights:
            return 0.0
        low, found, plain = text.lower(), [], 0
        telling = self._telling({*WORD.findall(low)}) if self._told(low) else {}
        for s in SENTENCE.split(low):
            if telling and (words := telling.keys() & WORD.findall(s)):
                found.append(self._logit(telling, words))
            elif s and not s.isspace():
                plain += 1
        z = np.array(found)
        return float(-np.expm1(-np.logaddexp(0, z).sum() - plain * np.logaddexp(0, self.bias)))

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[int, float, str]]:
        """(number, probability, sentence) of sentences at or above ``least``."""
        scored = [(i, 1 / (1 + np.exp(-self.logit(s))), s) for i, s in enumerate(sentences(text or ""))]
        return [(i, float(p), s) for i, p, s in scored if p >= least]


class Bags:
    """Labelled documents as bags of sentences, laid out for the loss."""

    def __init__(self, bags: list[list[list[int]]], plain: list[int], labels: list[int]):
        sent = [s for ss in bags for s in ss]
        self.doc = np.array([d for d, ss in enumerate(bags) for _ in ss], np.int64)
        self.word = np.array([w for s in sent for w in s], np.int64)
        self.of = np.repeat(np.arange(len(sent)), [len(s) for s in sent]) if sent else np.empty(0, np.int64)
        self.sent, self.y, self.plain = len(sent), np.array(labels, float), np.array(plain, float)

    def loss(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean negative log likelihood of the labels, and its gradient. theta: weights, base rate, leak."""
        size, n = len(theta) - 2, max(1, len(self.y))
        base, leak = theta[size:]
        z = base + np.bincount(self.of, theta[self.word], self.sent)
        p, p0, pl = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-base)), 1 / (1 + np.exp(-leak))
        log_clean = -np.bincount(self.doc, np.logaddexp(0, z), len(self.y)) - self.plain * np.logaddexp(0, base) - np.logaddexp(0, leak)
        clean = np.exp(log_clean)
        toxic = np.maximum(1 - clean, 1e-9)
        share = np.where(self.y > 0, -clean / toxic, 1.0)  # d loss / d log(1 - P), negated
        g = p * share[self.doc]
        grad = np.append(np.bincount(self.word, g[self.of], size), [g.sum() + (share * self.plain).sum() * p0, share.sum() * pl]) / n
        return float(-np.where(self.y > 0, np.log(toxic), log_clean).sum() / n), grad


def fit_bags(bags: list[list[list[int]]], plain: list[int], labels: list[int], size: int, rounds: int = 600, rate: float = 0.1, penalty: float = 6e-5) -> tuple[float, np.ndarray]:
    """(bias, weights) by gradient steps. A bag: its sentences that hold known features (as indices); plain: how many hold none."""
    data = Bags(bags, plain, labels)
    theta, m, v = np.zeros(size + 2), 0.0, 0.0
    theta[size:] = -8.0, -3.0  # base rate of a sentence, leak of a document
    for t in range(1, rounds + 1):
        grad = data.loss(theta)[1]
        grad[:size] += penalty * (np.sign(theta[:size]) + 0.1 * theta[:size])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[size]), theta[:size]


def training_rows(doc_id: Column) -> Column:
    """The rows whose labels may be learnt."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> Model:
    """Fits on at most ``rows`` labelled texts, chosen by hashes of their ids and, where ids repeat, of the texts, and at most
    ``vocabulary`` features."""
    chosen = labels.filter(training_rows(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = chosen.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `rows` ids at most
    sample = written(sample.groupBy(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic")), "toxic-texts")
    digests = sample.select(F.sha2("text", 256).alias("digest"))
    if digests.count() > rows:  # one id may stand for any number of texts
        sample = sample.join(F.broadcast(digests.orderBy("digest").limit(rows)), F.sha2("text", 256) == F.col("digest"), "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, toxic = Counter(), Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {f for w in {*WORD.findall(text.lower())} for f in features(w)}
                every.update(own)
                if y:
                    toxic.update(own)
            yield pa.RecordBatch.from_arrays([pa.array([*every], pa.string()), pa.array([*every.values()], pa.int64()), pa.array([toxic[f] for f in every], pa.int64())], ["feature", "n", "t"])

    total = sample.agg(F.count("*"), F.sum("toxic")).first()
    n, bad = total[0], total[1] or 0
    if not 0 < bad < n:
        return Model()
    counts = sample.mapInArrow(count, "feature string, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    top = counts.filter(F.col("n") >= max(3, n // 1000)).select("feature", _likelihood_ratio(F.col("n"), F.col("t"), n, bad).alias("g")).orderBy(F.desc("g"), "feature").limit(vocabulary)
    place = {r.feature: i for i, r in enumerate(top.collect())}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, plain = [], []
            for text in batch.column(0).to_pylist():
                own = [sorted({place[f] for w in {*WORD.findall(s)} for f in features(w) if f in place}) for s in sentences(text.lower())]
                found.append([s for s in own if s])
                plain.append(sum(not s for s in own))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.list_(pa.int32()))), pa.array(plain, pa.int32()), batch.column(1)], ["found", "plain", "toxic"])

    rows_ = sample.mapInArrow(bags, "found array<array<int>>, plain int, toxic int").collect()  # `rows` at most
    rows_.sort(key=lambda r: (r.toxic, r.plain, r.found))
    bias, weights = fit_bags([r.found for r in rows_], [r.plain for r in rows_], [r.toxic for r in rows_], len(place))
    return Model(bias, {w: float(weights[i]) for w, i in place.items() if abs(weights[i]) > 0.05})


def _likelihood_ratio(n: Column, t: Column, rows: int, toxic: int) -> Column:
    """Twice the log likelihood ratio of a feature in ``n`` of ``rows`` documents, ``t`` of them toxic, against chance."""

    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    clean, e = rows - toxic, n * toxic / rows
    return 2 * (cell(t, e) + cell(n - t, n - e) + cell(toxic - t, toxic - e) + cell(clean - (n - t), clean - (n - e)))


def score_column(model: Model) -> Column:
    """A column of scores of ``text``."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return score(F.col("text").cast("string"))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    out = docs.select("doc_id", (~training_rows(F.col("doc_id"))).alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence_no, probability, sentence of every sentence at or above ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *x) for d, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in model.offending(text, least)]
            cols = [*zip(*rows, strict=True)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.string()), strict=True)], ["doc_id", "sentence_no", "probability", "sentence"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, sentence_no int, probability double, sentence string")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the documents that a model fitted on them rejects; all columns stay."""
    return docs.filter(score_column(fit(docs, labels)) < threshold)
