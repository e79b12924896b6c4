"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from echotrail.session import scratch_path

#: A space after a character that no definition counts as white space: no token of the byte-level pattern crosses it.
_GAP = re.compile(r"(?<=\S) ")
_ODD_GAP = re.compile(r"\s ")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settled(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table written to the shared scratch folder: lost executors do not undo it."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def crc32_mod(ids: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; null ids count as the text "null"."""
    return F.pmod(F.crc32(F.coalesce(ids.cast("string"), F.lit("null")).cast("binary")), F.lit(n))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def training_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """One row (doc_key, label) for each labelled doc_id whose crc32 mod `folds` is not `held_out`."""
    return (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
            .where(crc32_mod(F.col("doc_id"), folds) != held_out)
            .groupBy(F.col("doc_id").alias("doc_key")).agg(F.max(F.col(label).cast("int")).alias("label")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """At most `rows` labelled training documents: (doc_key, label, text), the same ones on any partitioning.

    Only labels of rows whose crc32(doc_id) mod `folds` is not `held_out` are read. Half of the rows is kept for
    each class, so a rare class is not lost. The label rows are cut before the join, hence the broadcast is bounded. Of the
    documents of one doc_id, the one whose text has the smallest hash is taken, however many there are.
    """
    known = training_labels(labels, label, folds, held_out)
    order = F.xxhash64("doc_key")
    parts = [known.where(F.col("label") == k).orderBy(order, "doc_key").limit(rows // 2) for k in (0, 1)]
    picked = parts[0].unionByName(parts[1])
    texts = docs.select(F.col("doc_id").alias("doc_key"), F.coalesce("text", F.lit("")).alias("text"))
    return (texts.join(F.broadcast(picked), "doc_key").groupBy("doc_key", "label")
            .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")).select("doc_key", "label", "first.text"))


class Numbered(dict):
    """Numbers keys in order of first sight; `new` lists those not dealt with yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def numbers(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


def small_batches(batches, column: str, size: int = 2_000_000):
    """Slices of Arrow batches with about so many bytes of text each (one text at least), and their texts (null: empty)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            part = batch.slice(start, stop - start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start = stop


def pieces(text: str) -> list[str]:
    """Splits before single spaces that follow a visible character; joined, the pieces are the text again."""
    parts = text.split(" ") if not _ODD_GAP.search(text) else _GAP.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, component), the component by its least node.

    Large-star and small-star steps, each written to shared storage. Every step holds at most the edges; hubs are
    reduced by partial minima before the shuffle, and the join that deals a minimum back is a plain one that adaptive
    execution may split.
    """
    current = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), name)
    mark = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settled(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        current = settled(small, name)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, also where the body uses it in a loop over elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def passed(frame: DataFrame, keep: list[str], more: str) -> StructType:
    """Schema of the kept columns and some more."""
    out = StructType([f for c in keep for f in frame.schema.fields if f.name == c])
    for f in StructType.fromDDL(more).fields:
        out = out.add(f)
    return out
