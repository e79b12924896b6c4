"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two words counts common subsequences of three characters, each weighted by a decay for every character it
spans, normalised and raised to a power. Gaps and inserted characters ("idixot") only weaken it; marks inside a
word ("i.d.i.o.t") are dropped and runs of single characters ("i d i o t") joined first. Between a word and a landmark
of which it lacks over a quarter of the letters the kernel counts as zero. Sentences are bags of words under the sum of word kernels.
Landmarks are the words of the training sample that mark toxic documents best; projecting on them (Nyström) makes the
machine linear, so a sentence's margin is a sum of one number a word, computed once for each distinct word a worker
meets. A document scores by its worst sentence, since its label tells only that some sentence is toxic: training picks
each document's worst sentence anew in every round. Scores are calibrated to the label's share.

Training reads a bounded sample (`sample_rows`); scoring runs inside the scan, without a shuffle. Words over 16
characters are judged in overlapping windows, so texts count whole. Null texts count as empty; an empty text scores as
a sentence without words. Repeated rows score alike. Without labels of both kinds every score is the share of label 1
(0 if there are no labels). Other columns are not looked at.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import Numbered, crc32_mod, labelled_sample, passed, small_batches

_SPACED = re.compile(r"(?<!\S)\w(?:\s\w){3,}(?!\S)")
_MARKS = re.compile(r"[\W_]+")
_END = re.compile(r"[.!?][\"')\]]*$")
_LINE = "  . "
WORD, STEP, PIECES_KEPT = 16, 8, 200_000


@dataclass(frozen=True)
class Settings:
    """Parameters of kernel and training; `sample_rows` bounds the labelled documents read."""

    length: int = 3
    decay: float = 0.8
    power: int = 3
    landmarks: int = 40
    sample_rows: int = 4_000
    rounds: int = 5
    penalty: float = 1.0


def subsequence_kernel(words: np.ndarray, others: np.ndarray, length: int, decay: float) -> np.ndarray:
    """Kernel values [B, L] of words [B, S] and others [L, T] or [B, 1, T]: character codes, negative where padded."""
    others = others[None] if others.ndim == 2 else others
    count, wide = len(words), others.shape[-1]
    weigh = np.float32(decay) ** np.maximum(np.arange(wide)[None, :] - np.arange(wide)[:, None], 0).astype(np.float32)
    weigh = np.triu(weigh).astype(np.float32)
    # ends[i][..., j]: common subsequences of i characters in the prefixes so far and before place j
    shape = (count, others.shape[1], wide)
    ends = [np.ones(shape, np.float32)] + [np.zeros(shape, np.float32) for _ in range(length - 1)]
    out = np.zeros(shape[:2], np.float32)
    square = np.float32(decay * decay)
    for p in range(words.shape[1]):
        code = words[:, p]
        live = code >= 0
        if not live.any():
            break
        hit = ((code[:, None, None] == others) & live[:, None, None]).astype(np.float32) * square
        out += (hit * ends[-1]).sum(-1)
        fade = np.where(live, np.float32(decay), np.float32(1))[:, None, None]
        for i in range(length - 1, 0, -1):
            met = (hit * ends[i - 1]) @ weigh
            ends[i] *= fade
            ends[i][..., 1:] += met[..., :-1]
    return out


def coded(words: list[str], wide: int) -> np.ndarray:
    out = np.full((len(words), wide), -1, np.int32)
    for k, w in enumerate(words):
        out[k, :len(w)] = list(map(ord, w))
    return out


class Kernel:
    """Normalised, powered kernel of words with the landmarks."""

    def __init__(self, landmarks: list[str], settings: Settings) -> None:
        self.s = settings
        codes = coded(landmarks, max(map(len, landmarks)))
        codes[codes < 0] = -2  # padding never meets padding
        self.codes, self.norms = codes, self.own(coded(landmarks, codes.shape[1]))
        self.letters = np.unique(codes[codes >= 0])
        self.marks = (codes[:, :, None] == self.letters[None, None, :]).any(1).astype(np.float32)
        self.need = np.ceil(0.75 * self.marks.sum(1) - 1e-6)

    def own(self, codes: np.ndarray) -> np.ndarray:
        other = np.where(codes < 0, -2, codes)[:, None, :]
        return subsequence_kernel(codes, other, self.s.length, self.s.decay)[:, 0]

    def values(self, words: list[str]) -> np.ndarray:
        """[words, landmarks]; zero for words that lack over a quarter of the landmark's letters."""
        out = np.zeros((len(words), len(self.codes)), np.float32)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for k in range(0, len(order), 4_000):
            at = np.array(order[k:k + 4_000])
            codes = coded([words[i] for i in at], len(words[at[-1]]) or 1)
            letters = (codes[:, :, None] == self.letters[None, None, :]).any(1).astype(np.float32)
            word, mark = np.nonzero(letters @ self.marks.T >= self.need)
            if not len(word):
                continue
            own = np.ones(len(at), np.float32)
            some = np.unique(word)
            own[some] = self.own(codes[some])
            cross = subsequence_kernel(codes[word], self.codes[mark][:, None, :], self.s.length, self.s.decay)[:, 0]
            out[at[word], mark] = (cross / np.sqrt(np.maximum(own[word] * self.norms[mark], 1e-20))) ** self.s.power
        return out


def units(piece: str) -> list[str]:
    """The words to judge in a white-space piece: lower case, without marks, cut into windows if long."""
    w = _MARKS.sub("", piece.lower())
    if len(w) <= WORD:
        return [w] if w else []
    return [w[k:k + WORD] for k in range(0, len(w) - WORD + STEP, STEP)]


def joined(text: str) -> str:
    return _SPACED.sub(lambda m: "".join(m[0].split()), text)


class Reader:
    """Splits texts into sentences and keeps a row of numbers for each distinct piece."""

    def __init__(self, width: int, values) -> None:
        self.width, self.values = width, values
        self.forget()

    def forget(self) -> None:
        self.pieces, self.rows, self.ends, self.single = Numbered(), array("f"), array("b"), array("b")

    def learn(self) -> None:
        new = self.pieces.new
        split = [units(p) for p in new]
        index = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        known = self.values(list(index)) if index else np.zeros((0, self.width), np.float32)
        rows = np.zeros((len(new), self.width), np.float32)
        owner = np.repeat(np.arange(len(new)), [len(s) for s in split])
        if len(owner):
            np.add.at(rows, owner, known[[index[w] for w in chain.from_iterable(split)]])
        self.rows.frombytes(rows.tobytes())
        self.ends.extend([1 if _END.search(p) else 0 for p in new])
        self.single.extend([len(p) == 1 for p in new])
        new.clear()

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The text number and the summed numbers [sentences, width] of every sentence."""
        if len(self.pieces) > PIECES_KEPT:
            self.forget()
        split = [t.replace("\n", _LINE).split() for t in texts]
        number = self.pieces.numbers(list(chain.from_iterable(split)))
        doc = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        alone = np.fromiter((len(p) == 1 for p in self.pieces.new), bool, len(self.pieces.new))
        single = np.concatenate([np.frombuffer(self.single, np.int8).astype(bool), alone])[number] if len(number) else np.zeros(0, bool)
        run = single[:-3] & single[1:-2] & single[2:-1] & single[3:] if len(single) > 3 else np.zeros(0, bool)
        if run.any():  # some text spells words with spaces
            for d in np.unique(doc[:-3][run]):
                split[d] = joined(texts[d]).replace("\n", _LINE).split()
            number = self.pieces.numbers(list(chain.from_iterable(split)))
            doc = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        self.learn()
        if not len(number):
            return doc, np.zeros((0, self.width), np.float32)
        last = np.frombuffer(self.ends, np.int8).astype(bool)[number]
        starts = np.nonzero(np.concatenate([[True], last[:-1] | (doc[1:] != doc[:-1])]))[0]
        rows = np.frombuffer(self.rows, np.float32).reshape(-1, self.width)[number]
        return doc[starts], np.add.reduceat(rows, starts, axis=0)


def svm(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; classes weigh the same. The last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)) * len(y)
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        on = sign * (x @ w) < 1
        xs = x[on] * share[on][:, None]
        new = np.linalg.solve(ridge + 2 * penalty * xs.T @ x[on], 2 * penalty * xs.T @ sign[on])
        done = np.abs(new - w).max() < 1e-8
        w = new
        if done:
            break
    return w


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the chance of label 1 given margins."""
    x, w = np.stack([m, np.ones(len(m))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6]), x.T @ (y - p) - np.array([1e-2 * w[0], 0]))
    return float(w[0]), float(w[1])


@dataclass(frozen=True)
class ToxicModel:
    settings: Settings
    landmarks: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    slope: float
    intercept: float


def pick_landmarks(sample: DataFrame, count: int) -> list[str]:
    """Words that mark toxic documents of the sample best, by log odds times the root of their number."""

    def run(batches):
        for batch, texts in small_batches(batches, "text"):
            labels = batch.column("label").to_pylist()
            words = [sorted({u for p in joined(t).split() for u in units(p) if len(u) > 2}) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(list(chain.from_iterable(words)), pa.string()),
                                              pa.array(np.repeat(np.array(labels, np.int32), [len(w) for w in words]))], names=["word", "label"])

    n1, n0 = sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    rows = sample.select("text", "label").mapInArrow(run, "word string, label int").groupBy("word").agg(
        F.sum("label").alias("k1"), F.sum(1 - F.col("label")).alias("k0")).where("k1 >= 3")
    odds = F.log((F.col("k1") + 0.5) / ((n1 or 0) + 1)) - F.log((F.col("k0") + 0.5) / ((n0 or 0) + 1))
    best = rows.withColumn("z", odds * F.sqrt("k1")).orderBy(F.desc("z"), "word").limit(count)
    return [r[0] for r in best.select("word").collect()]


def trained(settings: Settings, landmarks: list[str], share: float):
    """For mapInArrow over one partition of the sample: ends with one row of weights, bias, slope and intercept."""

    def run(batches):
        kernel = Kernel(landmarks, settings)
        values, vectors = np.linalg.eigh(kernel.values(landmarks).astype(np.float64))
        root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        reader = Reader(len(landmarks), kernel.values)
        docs, rows, labels, n = [], [], [], 0
        for batch, texts in small_batches(batches, "text"):
            doc, row = reader.sentences(texts)
            docs.append(doc + n)
            rows.append(row)
            labels += batch.column("label").to_pylist()
            n += len(texts)
        doc, x, y = np.concatenate(docs), np.concatenate(rows).astype(np.float64) @ root, np.array(labels, float)
        starts = np.nonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[0]
        w = np.append(root @ np.ones(len(landmarks)), 0.0)
        for _ in range(settings.rounds):
            margin = x @ w[:-1] + w[-1]
            worst = np.lexsort((-margin, doc))[starts]
            w = svm(x[worst], y[doc[worst]], settings.penalty)
        top = np.full(n, w[-1])
        top[doc[starts]] = np.maximum.reduceat(x @ w[:-1] + w[-1], starts)
        slope, intercept = logistic(top, y)
        rate = y.mean()
        intercept += np.log(share / (1 - share)) - np.log(rate / (1 - rate))
        yield pa.RecordBatch.from_pydict({"weights": [(root @ w[:-1]).tolist()], "bias": [float(w[-1])], "slope": [slope], "intercept": [float(intercept)]})

    return run


def fit_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 3, held_out: int = 1) -> ToxicModel:
    """Fits on labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", folds, held_out, settings.sample_rows)
    known = labels.where(F.col("toxic").isNotNull() & (crc32_mod(F.col("doc_id"), folds) != held_out))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    landmarks = pick_landmarks(sample, settings.landmarks) if share and share < 1 else []
    if not landmarks or sample.select("label").distinct().count() < 2:
        odds = np.log(share / (1 - share)) if share and share < 1 else (30.0 if share else -30.0)
        return ToxicModel(settings, (), (), 0.0, 0.0, float(odds))
    rows = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_key"), "text").select("label", "text")
    got = rows.mapInArrow(trained(settings, landmarks, share), "weights array<double>, bias double, slope double, intercept double").first()
    return ToxicModel(settings, tuple(landmarks), tuple(got["weights"]), got["bias"], got["slope"], got["intercept"])


def score(docs: DataFrame, model: ToxicModel, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """The kept columns with score (0 to 1) and predicted (1 from the threshold on)."""
    source = docs.select(*keep, docs["text"].alias("__text"))

    def run(batches):
        if model.landmarks:
            kernel, weights = Kernel(list(model.landmarks), model.settings), np.array(model.weights)
            reader = Reader(1, lambda words: (kernel.values(words) @ weights)[:, None].astype(np.float32))
        for batch, texts in small_batches(batches, "__text"):
            top = np.full(len(texts), model.bias)
            if model.landmarks:
                doc, rows = reader.sentences(texts)
                if len(doc):
                    starts = np.nonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[0]
                    top[doc[starts]] = np.maximum.reduceat(rows[:, 0] + model.bias, starts)
            out = 1 / (1 + np.exp(-np.clip(model.slope * top + model.intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out), pa.array((out >= threshold).astype(np.int32))],
                                             names=[*keep, "score", "predicted"])

    return source.mapInArrow(run, passed(source, keep, "score double, predicted int"))
