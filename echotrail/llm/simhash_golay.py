"""SimHash near-dedup with keys from the binary Golay code.

Every text gets a 64-bit fingerprint of its word shingles. The 64 bits are dealt into three segments (22, 21 and 21 bits,
filled up with zeros to the 23 bits of the code). The code is perfect: each 23-bit word lies within 3 bits of exactly
one codeword. If two fingerprints differ in at most 4 bits, some two of the three segments differ in at most 2 bits
together (pigeonhole); if they differ in e bits in a segment, the codeword nearest to the one lies within 3 + e bits of
the other. So a fingerprint is filed under the nearest codewords of each two segments (3 keys), and looks up all pairs
of codewords within (3, 5), (4, 4) or (5, 3) bits of its own (about 60 keys for each two segments). Every linked pair
meets, whatever the data; pairs are verified by counting bits. Keys belong to distinct fingerprints, so copies never
meet each other, and the number of keys is fixed.

Null and empty texts have no words: fingerprint zero, linked like any other. Repeated rows share a fingerprint and a
component. The component is the smallest doc_id reachable (null ids are passed over; null if all are null). Other
columns are passed through.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import components, passed, settled, small_batches

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Widths of the segments, lowest bits first, and the generator polynomial of the code (fixed values).
WIDTHS, GENERATOR, LENGTH = (22, 21, 21), 0b110001110101, 23


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Bit k is set if it is set in over half of the shingles' hashes, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str], size: int = SHINGLE) -> DataFrame:
    """The kept columns with fp, the fingerprint as a signed long."""
    source = docs.select(*keep, docs["text"].alias("__text"))

    def run(batches):
        for batch, texts in small_batches(batches, "__text"):
            prints = [fingerprint(t, size) for t in texts]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(np.array(prints, np.uint64).view(np.int64))],
                                             names=[*keep, "fp"])

    return source.mapInArrow(run, passed(source, keep, "fp long"))


class Golay:
    """Codewords near 23-bit words, by syndrome."""

    def __init__(self, reach: int = 5) -> None:
        weights = [(w, sum(1 << b for b in bits)) for w in range(reach + 1) for bits in combinations(range(LENGTH), w)]
        self.errors = np.array([e for _, e in weights], np.int64)
        weight, syndrome = np.array([w for w, _ in weights]), self.syndrome(self.errors)
        order = np.lexsort((weight, syndrome))
        self.errors, self.weight = self.errors[order], weight[order]
        self.start = np.searchsorted(syndrome[order], np.arange((1 << 11) + 1))

    @staticmethod
    def syndrome(words: np.ndarray) -> np.ndarray:
        """Remainder of division by the generator polynomial."""
        rest = words.copy()
        for bit in range(LENGTH - 1, 10, -1):
            rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
        return rest

    def near(self, word: int, syndrome: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices (12 bits) of the codewords in reach, nearest first, and their distances."""
        part = slice(self.start[syndrome], self.start[syndrome + 1])
        return (word ^ self.errors[part]) >> 11, self.weight[part]


def key_rows(prints: DataFrame, filed: bool) -> DataFrame:
    """Rows (key, fp) for distinct fingerprints: the three keys each is filed under, or all keys it looks up."""

    def run(batches):
        code = Golay(3 if filed else 5)
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for begin in range(0, len(fps), 2_000):
                own = fps[begin:begin + 2_000]
                parts, at = [], 0
                for width in WIDTHS:
                    words = (own.view(np.uint64) >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
                    parts.append([code.near(w, s) for w, s in zip(words.tolist(), code.syndrome(words).tolist(), strict=True)])
                    at += width
                keys = []
                for row in zip(*parts, strict=True):
                    for k, (a, b) in enumerate(combinations(range(3), 2)):
                        (x, dx), (y, dy) = row[a], row[b]
                        spare = np.maximum(dx - 3, 0)[:, None] + np.maximum(dy - 3, 0)[None, :]
                        keys.append(((x[:, None] << 12 | y[None, :]) + (k << 24))[spare <= 2])
                counts = np.array([len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)),
                                                  pa.array(np.repeat(np.repeat(own, 3), counts))], names=["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key int, fp long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Linked pairs (a, b), a > b, of distinct fingerprints that differ in at most `radius` (up to 4) bits."""
    if radius > RADIUS:
        raise ValueError("the keys reach 4 bits")
    asked, filed = key_rows(prints, False).withColumnRenamed("fp", "a"), key_rows(prints, True).withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return asked.join(filed, "key").where(near & (F.col("a") != F.col("b"))).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, keep: list[str], radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """The kept columns (doc_id among them) with fp, group_fp (a fingerprint that names the component) and component_id."""
    marked = settled(fingerprints(docs, keep, size), "fingerprints")
    prints = settled(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = components(links(prints, radius), "fingerprint-components")
    named = prints.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("group_fp"))
    least = named.groupBy("group_fp").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(least, "group_fp").select("fp", "group_fp", "component_id"), "fp")
