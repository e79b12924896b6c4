"""Byte-level BPE by a prefix-sharing trie: encoding, decoding, and the digest query's columns.

A word's encoding ends with the only token t for which the encoding of the word without t, itself ending with the token
s, stays unmerged before t ("s t" encodes to itself). So the last token of every prefix describes the whole encoding.
The distinct words of a batch are walked in sorted order, which is a depth-first walk of their trie: the states of the
prefix shared with the word before stay on the stack and are computed once. Texts are cut at spaces first, each
distinct piece is split by the pattern once, and pieces already encoded are kept up to a bound, so frequent words cost
one lookup. All of it runs inside the scan: no shuffle, memory bounded by block size and cache bound.

Special tokens of the vocabulary are found in a text before the pattern is applied. Null and empty texts have no
tokens. Repeated rows get equal results; ids and other columns are passed through untouched, nulls included.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from echotrail.llm.common import Numbered, passed, pieces, ranges, small_batches

#: Pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces with their tokens that a worker keeps; of steps and pairs met on the walks, half as many again.
PIECES_KEPT = 400_000


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as bytes, merge ranks and special tokens of a tokenizer file's content."""

    def __init__(self, file: str, merges: bool = True) -> None:
        spec = json.loads(file)
        of = printable_bytes()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*spec["model"]["vocab"].values(), *self.special.values()])
        self.tokens: list[bytes] = [b""] * size
        self.ids: dict[bytes, int] = {}
        for text, i in spec["model"]["vocab"].items():
            if text not in self.special:
                self.tokens[i] = bytes(of[c] for c in text)
                self.ids[self.tokens[i]] = i
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(spec["model"]["merges"] if merges else []):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = (self.ids[bytes(of[c] for c in a)], self.ids[bytes(of[c] for c in b)])
            whole = self.ids[self.tokens[pair[0]] + self.tokens[pair[1]]]
            self.rank[pair] = r
            self.made[pair] = whole
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, data: bytes) -> list[int]:
        """Plain pair merging by rank, for single pairs of tokens."""
        out = [self.ids[bytes([b])] for b in data]
        while len(out) > 1:
            at = min(range(len(out) - 1), key=lambda k: self.rank.get((out[k], out[k + 1]), 1 << 60))
            if (out[at], out[at + 1]) not in self.rank:
                break
            out[at:at + 2] = [self.made[out[at], out[at + 1]]]
        return out


class Trie:
    """Depth-first walk over sorted words that keeps the last-token states of the shared prefix."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.begins = {t[:k] for t in vocabulary.ids for k in range(1, len(t) + 1)}
        self.forget()

    def forget(self) -> None:
        """Empties the pairs tested and the suffix states: name (a beginning of tokens), tokens that end it (longest
        first), steps taken so far."""
        self.stays: dict[int, bool] = {}
        self.state, self.names, self.ending, self.step = {b"": 0}, [b""], [[]], {}

    def apart(self, s: int, t: int) -> bool:
        """Whether the tokens s and t side by side are what their bytes encode to."""
        key = s << 20 | t
        got = self.stays.get(key)
        if got is None:
            v = self.v
            got = self.stays[key] = v.merged(v.tokens[s] + v.tokens[t]) == [s, t]
        return got

    def follow(self, state: int, byte: int) -> int:
        """The longest suffix of a state and one more byte that begins a token; states are numbered when first met."""
        name = self.names[state] + bytes([byte])
        while name and name not in self.begins:
            name = name[1:]
        if name not in self.state:
            self.state[name] = len(self.names)
            self.names.append(name)
            ends = [(self.v.ids[name[k:]], len(name) - k) for k in range(len(name)) if name[k:] in self.v.ids]
            self.ending.append([(t, n) for t, n in ends if self.v.merged(name[-n:]) == [t]])
        got = self.step[state << 8 | byte] = self.state[name]
        return got

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """The tokens of each distinct word."""
        out: dict[bytes, list[int]] = {}
        step, follow, ending, stays, apart = self.step.get, self.follow, self.ending, self.stays, self.apart
        last, back, states = [-1], [0], [0]  # of the prefix of each length: last token, length before it, suffix state
        before = b""
        for word in sorted(words):
            share, most = 0, min(len(before), len(word))
            while share < most and before[share] == word[share]:
                share += 1
            del last[share + 1:], back[share + 1:], states[share + 1:]
            state = states[share]
            for end in range(share, len(word)):
                byte = word[end]
                state = step(state << 8 | byte) or follow(state, byte)
                states.append(state)
                for t, n in ending[state]:
                    start = end + 1 - n
                    if not start or (stays[k] if (k := last[start] << 20 | t) in stays else apart(last[start], t)):
                        last.append(t)
                        back.append(start)
                        break
            tokens, end = [], len(word)
            while end:
                tokens.append(last[end])
                end = back[end]
            out[word] = tokens[::-1]
            before = word
        return out


class Encoder:
    """Token ids of texts, with the tokens of pieces seen before."""

    def __init__(self, vocabulary: Vocabulary, kept: int = PIECES_KEPT) -> None:
        self.v, self.trie, self.kept = vocabulary, Trie(vocabulary), kept
        self.pattern = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.known, self.flat, self.starts = Numbered(), array("I"), array("q", [0])

    def code(self, new: list[str]) -> list[list[int]]:
        """Tokens of pieces: their words are found by the pattern and walked as a trie."""
        split = [[w.encode("utf-8", "replace") for w in self.pattern.findall(p)] for p in new]
        coded = self.trie.encode(list(set(chain.from_iterable(split))))
        return [list(chain.from_iterable(map(coded.__getitem__, words))) for words in split]

    def learn(self) -> None:
        """Encodes the pieces seen for the first time; special tokens stand for themselves."""
        new = self.known.new
        coded = iter(self.code([p for p in new if not isinstance(p, int)]))
        for p in new:
            self.flat.extend([p] if isinstance(p, int) else next(coded))
            self.starts.append(len(self.flat))
        new.clear()

    def cut(self, text: str) -> list:
        """Pieces of a text; a special token is an int."""
        if not text:
            return []
        if not self.v.splitter or not self.v.splitter.search(text):
            return pieces(text)
        return [p for k, part in enumerate(self.v.splitter.split(text)) if part
                for p in ([self.v.special[part]] if k % 2 else pieces(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of the texts one after the other, and the number of each text."""
        if len(self.known) > self.kept:
            self.forget()
        if len(self.trie.step) + len(self.trie.stays) > 1.5 * self.kept:
            self.trie.forget()
        cut = [self.cut(t) for t in texts]
        counts = np.array([len(c) for c in cut], np.int64)
        number = self.known.numbers(list(chain.from_iterable(cut)))
        self.learn()
        starts = np.frombuffer(self.starts, np.int64)
        length = starts[number + 1] - starts[number]
        ids = np.frombuffer(self.flat, np.uint32)[ranges(starts[number], length)] if len(number) else np.zeros(0, np.uint32)
        ends = np.concatenate([[0], np.cumsum(length)])
        at = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[at[1:]] - ends[at[:-1]]


@lru_cache(1)
def encoder(file: str, kept: int) -> Encoder:
    """One for each Python worker: what it has learnt serves the worker's next tasks."""
    return Encoder(Vocabulary(file), kept)


@lru_cache(1)
def token_bytes(file: str) -> list[bytes]:
    """Tokens as bytes, without the merges, which decoding does not need."""
    return Vocabulary(file, merges=False).tokens


def vocabulary_file(path: str) -> str:
    """The content of a vocabulary file, of a fixed size; it travels to the executors with the function."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", kept: int = PIECES_KEPT) -> DataFrame:
    """The kept columns with ids (binary: unsigned 32-bit little-endian token ids) and n_tokens."""
    file, source = vocabulary_file(path), docs.select(*keep, docs[text].alias("__text"))

    def run(batches):
        for batch, texts in small_batches(batches, "__text"):
            flat, counts = encoder(file, kept).encode(texts)
            data, ends = flat.astype("<u4").tobytes(), np.cumsum(counts) * 4
            ids = [data[e - 4 * k:e] for e, k in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(ids, pa.binary()), pa.array(counts, pa.int64())],
                                             names=[*keep, "ids", "n_tokens"])

    return source.mapInArrow(run, passed(source, keep, "ids binary, n_tokens long"))


def recode(docs: DataFrame, path: str, keep: list[str], text: str = "text", kept: int = PIECES_KEPT) -> DataFrame:
    """The kept columns with ids and n_tokens as `encode` gives them and decoded as `decode` does, in one pass: a worker holds
    one vocabulary, and the ids do not go back and forth."""
    file, source = vocabulary_file(path), docs.select(*keep, docs[text].alias("__text"))

    def run(batches):
        for batch, texts in small_batches(batches, "__text"):
            coder = encoder(file, kept)
            flat, counts = coder.encode(texts)
            token, ends = coder.v.tokens.__getitem__, np.cumsum(counts)
            spans = [slice(e - k, e) for e, k in zip(ends.tolist(), counts.tolist(), strict=True)]
            ids = pa.array([flat[s].astype("<u4").tobytes() for s in spans], pa.binary())
            back = pa.array([b"".join(map(token, flat[s].tolist())).decode("utf-8", "replace") for s in spans], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], ids, pa.array(counts, pa.int64()), back],
                                             names=[*keep, "ids", "n_tokens", "decoded"])

    return source.mapInArrow(run, passed(source, keep, "ids binary, n_tokens long, decoded string"))


def decode(frame: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The kept columns with the text that the ids stand for; bytes that are no UTF-8 become U+FFFD, null ids empty."""
    file, source = vocabulary_file(path), frame.select(*keep, frame[ids].alias("__ids"))

    def run(batches):
        token = token_bytes(file).__getitem__
        for batch in batches:
            texts = (b"".join(map(token, np.frombuffer(x.as_py() or b"", "<u4").tolist())).decode("utf-8", "replace")
                     for x in batch.column("__ids"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())],
                                             names=[*keep, "decoded"])

    return source.mapInArrow(run, passed(source, keep, "decoded string"))
