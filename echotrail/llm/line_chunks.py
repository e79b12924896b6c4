"""Line dedup: content-defined chunks of lines, removed where they repeat anywhere in the corpus.

Lines are hashed; a line ends a chunk where the hash over it and the line before falls on a mask, so boundaries depend
on content alone and shift with it. The last line of a text ends its last chunk. Chunks of two lines or more meet by
their hash over all documents. Counting needs hashes alone and combines before the shuffle; only chunks whose hash
repeats carry their text into the comparison of bytes. The first copy in the order (doc_id, position) stays, all other
copies go; what is left of a text is joined again with line breaks.

A chunk's copies within one document count as repeats as well. Null and empty texts pass unchanged; a text whose every
chunk goes becomes empty (the row stays). Rows equal in doc_id and text are one document: they share one decision. A
null doc_id sorts before all others. Further columns are passed on; helper columns cannot clash with them.

Chunks miss what stands between their boundaries. `dedup_passages` finds every repeated passage: each two neighbouring
lines (blank lines between them included) and each line of `LONG_LINE` words or more meet by their md5. All pairs of a
repeated passage repeat, so it goes whole and nothing beside it does; the first place of a line is never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import let, settled

#: One boundary in so many lines on average, and the fewest lines of a chunk that may be removed.
MEAN_LINES, LEAST_LINES = 3, 2
#: Words from which a repeated line goes on its own.
LONG_LINE = 50


def chunk_ends(lines: Column, mean: int = MEAN_LINES) -> Column:
    """Numbers (from 1) of the lines that end a chunk, ascending; the last line always does."""
    hashes = F.transform(lines, lambda x: F.md5(x.cast("binary")))
    rows = F.arrays_zip(F.sequence(F.lit(1), F.size(lines)).alias("n"), hashes.alias("h"), F.concat(F.array(F.lit("")), hashes).alias("p"))
    rolled = lambda x: F.conv(F.substring(F.md5(F.concat(x["p"], x["h"]).cast("binary")), 1, 6), 16, 10).cast("int")
    ends = F.filter(rows, lambda x: x["n"].isNotNull() & ((x["n"] == F.size(lines)) | (rolled(x) % mean == 0)))
    return F.transform(ends, lambda x: x["n"])


def chunks(docs: DataFrame, mean: int = MEAN_LINES) -> DataFrame:
    """Rows (id, mark, at, size, chunk) for every chunk of every text; mark tells texts of one id apart."""
    def cut(lines: Column, starts: Column) -> Column:
        return F.transform(F.slice(starts, 1, F.size(starts) - 1), lambda at, k: F.struct(
            at.alias("at"), (F.element_at(starts, k + 2) - at).alias("size"),
            F.array_join(F.slice(lines, at + 1, F.element_at(starts, k + 2) - at), "\n").alias("chunk")))

    found = let(F.split("text", "\n"), lambda lines: let(
        F.concat(F.array(F.lit(0)), chunk_ends(lines, mean)), lambda starts: cut(lines, starts)))
    return (docs.where(F.col("text").isNotNull())
            .select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), F.explode(found).alias("c"))
            .select("id", "mark", "c.*"))


def repeats(docs: DataFrame, mean: int = MEAN_LINES, least: int = LEAST_LINES) -> DataFrame:
    """Rows (id, mark, at, size) of the copies that go."""
    long = chunks(docs, mean).where(F.col("size") >= least).withColumn("hash", F.xxhash64("chunk"))
    often = long.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    copies = settled(long.join(often, "hash"), "repeated-chunks")
    place = F.struct("id", "at", "mark")
    first = copies.groupBy("hash", "chunk").agg(F.min(place).alias("first"))
    return (copies.join(first, ["hash", "chunk"]).where(~place.eqNullSafe(F.col("first")))
            .select("id", "mark", "at", "size").distinct())


def passages(docs: DataFrame, long_line: int = LONG_LINE) -> DataFrame:
    """Rows (id, mark, at, size, hash) for every two neighbouring lines that are not blank, and for every long line."""
    def cut(lines: Column, full: Column) -> Column:
        pairs = F.transform(F.slice(full, 1, F.greatest(F.size(full) - 1, F.lit(0))), lambda at, k: F.struct(
            at.alias("at"), (F.element_at(full, k + 2) - at + 1).alias("size"),
            F.unhex(F.md5(F.array_join(F.slice(lines, at + 1, F.element_at(full, k + 2) - at + 1), "\n").cast("binary"))).alias("hash")))
        words = lambda at: F.size(F.filter(F.split(F.element_at(lines, at + 1), r"\s+"), lambda w: w != ""))
        alone = F.transform(F.filter(full, lambda at: words(at) >= long_line), lambda at: F.struct(
            at.alias("at"), F.lit(1).alias("size"), F.unhex(F.md5(F.element_at(lines, at + 1).cast("binary"))).alias("hash")))
        return F.concat(pairs, alone)

    found = let(F.split("text", "\n"), lambda lines: let(
        F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda k: F.element_at(lines, k + 1).rlike(r"\S")), lambda full: cut(lines, full)))
    return (docs.where(F.col("text").isNotNull())
            .select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), F.explode(found).alias("c"))
            .select("id", "mark", "c.*"))


def repeated_passages(docs: DataFrame, long_line: int = LONG_LINE) -> DataFrame:
    """Rows (id, mark, at, size) of the copies that go; they may overlap."""
    rows = passages(docs, long_line)
    place = F.struct("id", "at", "mark")
    first = rows.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, "hash").where(~place.eqNullSafe(F.col("first"))).select("id", "mark", "at", "size").distinct()


def dedup_passages(docs: DataFrame, long_line: int = LONG_LINE, count: str = "n_cut") -> DataFrame:
    """The documents without repeated passages, and the number of lines cut in a column named by `count`."""
    return without(docs, repeated_passages(docs.select("doc_id", "text"), long_line), count)


def dedup(docs: DataFrame, mean: int = MEAN_LINES, least: int = LEAST_LINES, count: str = "n_cut") -> DataFrame:
    """The documents with repeated chunks cut out of `text`, and the number of lines cut in a column named by `count`."""
    return without(docs, repeats(docs.select("doc_id", "text"), mean, least), count)


def without(docs: DataFrame, copies: DataFrame, count: str) -> DataFrame:
    """The documents without the lines of the copies (id, mark, at, size), and how many distinct lines went."""
    gone = (copies.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark"))
            .agg(F.collect_list(F.struct("at", "size")).alias("__gone")))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__mark")), "left")
    cut = F.flatten(F.transform("__gone", lambda g: F.sequence(g["at"], g["at"] + g["size"] - 1)))
    left = let(F.split("text", "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut), lambda k: F.element_at(lines, k + 1)), "\n"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)
    kept = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != count]
    return joined.select(*kept, F.when(F.col("__gone").isNull(), 0).otherwise(F.size(F.array_distinct(cut))).alias(count))
