"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Each white-space word gives two views: the word itself and its shape (letters to a or A, digits to 0, runs squeezed,
punctuation kept). Word unigrams and bigrams, shape unigrams to trigrams and repeated words are hashed into buckets; a
feature's value is its share of the document's positions, so length has no effect. Training streams the sample, in a
fixed order and several passes, through one task that holds only the weights; scoring is a sparse dot product inside
the scan, without a shuffle. The weights have a fixed size (`bits`). The sample may hold the classes in another mix than all
training labels do; the bias is shifted by the difference of the log odds.

Null texts count as empty. An empty text is scored by the bias alone. Repeated rows get the same score each; an empty
training set gives the score 0.5 everywhere. Columns of the input other than those named stay untouched.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import Numbered, labelled_sample, passed, small_batches, training_labels

_RULES = [(re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0")]
_RUN = re.compile(r"(.)\1+")
_WORDS_KEPT = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Training parameters; `sample_rows` bounds the labelled rows that are read."""

    bits: int = 18
    sample_rows: int = 6_000
    passes: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.2
    scale: float = 8.0


class Featurizer:
    """Bucket numbers of the n-grams of some texts, by view; keeps hashes of words seen, up to a bound."""

    def __init__(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.forget()

    def forget(self) -> None:
        self.words, self.own, self.shape = Numbered(), array("Q"), array("Q")

    def learn(self) -> None:
        for w in self.words.new:
            shape = w
            for pattern, sign in _RULES:
                shape = pattern.sub(sign, shape)
            shape = _RUN.sub(r"\1\1", shape)
            self.own.append(xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 1))
            self.shape.append(xxhash.xxh64_intdigest(shape.encode("utf-8", "replace"), 2))
        self.words.new.clear()

    def views(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every view the text number and the bucket of each n-gram."""
        if len(self.words) > _WORDS_KEPT:
            self.forget()
        split = [t.split() for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        number = self.words.numbers(list(chain.from_iterable(split)))
        self.learn()
        own, shape = np.frombuffer(self.own, np.uint64), np.frombuffer(self.shape, np.uint64)
        own, shape = (own[number], shape[number]) if len(number) else (own[:0], shape[:0])
        two, three = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
        same = (own[:-1] == own[1:]).astype(np.uint64) + np.uint64(3)
        pair = shape[:-1] * _MIX + shape[1:]
        out = [(doc, own), (doc, shape), (doc[1:][two], (own[:-1] * _MIX + own[1:])[two]),
               (doc[1:][two], (pair + np.uint64(1))[two]), (doc[1:][two], same[two]),
               (doc[2:][three], (pair[:-1] * _MIX + shape[2:] + np.uint64(2))[three])]
        return [(d, ((v * _MIX) >> self.shift).astype(np.int64)) for d, v in out]

    def sparse(self, text: str, scale: float) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values of one text."""
        views = [v for _, v in self.views([text])]
        index, where = np.unique(np.concatenate(views), return_inverse=True)
        share = np.concatenate([np.full(len(v), scale / max(len(v), 1)) for v in views])
        return index, np.bincount(where, share)

    def margins(self, texts: list[str], weights: np.ndarray, scale: float) -> np.ndarray:
        """Sparse dot products of the texts with the weights, bias included."""
        out = np.full(len(texts), weights[-1])
        for doc, bucket in self.views(texts):
            out += scale * np.bincount(doc, weights[bucket], len(texts)) / np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        return out


def ftrl_updates(settings: Settings):
    """For mapInArrow: streams (label, text) rows in their order, ends with one row of weights."""

    def run(batches):
        size = 1 << settings.bits
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        s, maker = settings, Featurizer(settings.bits)
        weights = lambda i: np.where(np.abs(z[i]) <= s.l1, 0.0, -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                i, x = maker.sparse(text, s.scale)
                i, x = np.append(i, size), np.append(x, 1.0)
                w = weights(i)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha * w
                n[i] += g * g
        yield pa.RecordBatch.from_pydict({"weights": [weights(np.arange(size + 1)).astype("<f4").tobytes()]})

    return run


@dataclass(frozen=True)
class QualityModel:
    settings: Settings
    weights: bytes


def fit(sample: DataFrame, settings: Settings = Settings()) -> QualityModel:
    """Fits on rows (doc_key, label, text), a bounded sample; passes over it are rows in a fixed order."""
    rows = (sample.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(settings.passes))))
            .repartition(1).sortWithinPartitions("step", F.xxhash64("doc_key", "step"), "text").select("label", "text"))
    got = rows.mapInArrow(ftrl_updates(settings), "weights binary").first()  # no row if the sample is empty
    return QualityModel(settings, bytes(got[0]) if got else bytes(4 * ((1 << settings.bits) + 1)))


def score(docs: DataFrame, model: QualityModel, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """The kept columns with score (0 to 1) and predicted (1 from the threshold on)."""
    text = "text" if "text" in keep else "__text"
    source = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(text))

    def run(batches):
        weights = np.frombuffer(model.weights, "<f4").astype(np.float64)
        maker, scale = Featurizer(model.settings.bits), model.settings.scale
        for batch, texts in small_batches(batches, text):
            out = maker.margins(texts, weights, scale)
            out = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out), pa.array((out >= threshold).astype(np.int32))],
                                             names=[*keep, "score", "predicted"])

    return source.mapInArrow(run, passed(source, keep, "score double, predicted int"))


def fit_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 5,
                  held_out: int = 0) -> QualityModel:
    """Fits on labelled documents outside the held-out fold; the bias is moved from the sample's class mix to that of all
    those labels, so scores mean the same whatever the sample leaves out."""
    sample = labelled_sample(docs, labels, "quality", folds, held_out, settings.sample_rows)
    model = fit(sample, settings)
    known = training_labels(labels, "quality", folds, held_out)
    share, rate = (x.agg(F.avg("label")).first()[0] for x in (known, sample))
    if not share or not rate or share == 1 or rate == 1:  # labels of one kind have no odds
        return model
    weights = np.frombuffer(model.weights, "<f4").copy()
    weights[-1] += np.log(share / (1 - share)) - np.log(rate / (1 - rate))
    return QualityModel(settings, weights.tobytes())
