"""Removal of long repeated byte strings by suffix arrays over shards of the corpus.

A byte goes if a string of `length` bytes that covers it starts at another place too, in any document or the same one;
places are judged on the input and never cross documents. The steps:

1. *Anchors.* Of the `GRAM`-byte strings inside each window of `length` bytes, the one with the least hash (leftmost on ties)
   is the window's anchor. Equal windows have equal anchors at equal distances, so a window can only repeat if its anchor's
   hash does. Anchors with a unique hash are dropped; what is left carries a context, the bytes of all windows it can
   anchor. One place in about 50 is an anchor, and texts stay where they are: only hashes and places are shuffled.
2. *Contexts.* Equal contexts of a key are one with a count; two or more repeat whole. A key with several different
   contexts has their bytes fetched, once for each.
3. *Shards.* Contexts are dealt by key to shards of about `SHARD` contexts. A shard builds the suffix array of its contexts by
   Larsson-Sadakane refinement in numpy (sort by eight bytes, then by rank pairs of doubled length, unsettled groups alone)
   and common prefixes by Kasai's pass in text order, in lockstep over the contexts. Runs of the array that share
   `length` bytes are the repeated windows.
4. *Merging.* A key with more than `SPREAD` different contexts spans several shards. Each of them hands on its distinct
   windows as 128-bit fingerprints, dealt to slices; in each slice the shards' runs are merged and every window is looked up
   in them by binary search. So no group has to fit one task, and the work grows with the contexts, not with pairs of shards.
5. Every anchor's repeated stretch becomes a span of its document; spans are united and cut out.

Keys and fingerprints are hashes: keys alone decide nothing (shards compare bytes), but equal contexts and windows of several
shards are told by 128 bits. Null texts count as empty; texts under `length` bytes stay whole; repeated rows are documents of
their own and remove each other; null ids are allowed; an empty table gives an empty result. Kept columns may have any
name but those of the result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import passed, ranges, settled
from echotrail.llm.token_files import opened
from echotrail.session import scratch_path

LENGTH, GRAM, SHARD = 200, 100, 4_000
#: Different contexts of one key that a shard holds; keys with more are spread and merged.
SPREAD = 16_000
#: Window starts handled at once, and rows of a merge slice.
STEP, SLICE = 1 << 20, 1 << 20
#: Rows of the parts: the upper bits of an id are the partition that wrote the row.
PART_BITS = 33
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32)) ^ np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(4)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class Hashes:
    """Polynomial hashes of all stretches of a byte string."""

    def __init__(self, data: np.ndarray, base: np.uint64) -> None:
        size = max(STEP + 4 * LENGTH, 1 << int(len(data)).bit_length())
        up, self.down = powers(int(base), size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def all(self, size: int) -> np.ndarray:
        """Of every stretch of so many bytes."""
        return (self.sums[size:] - self.sums[:-size]) * self.down[:len(self.sums) - size]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    n = len(values)
    filled = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    filled[:n] = values
    blocks = filled.reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(before[:n - width + 1], after[width - 1:n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Yields (document, place in the document, key, context hash) arrays for texts laid end to end in `data`."""
    starts = np.concatenate([[0], ends[:-1]])
    last = -1
    for low in range(0, len(data) - length + 1, STEP):
        high = min(low + STEP, len(data) - length + 1)
        base, top = max(0, low - length + gram), min(len(data), high + 2 * length)
        part = Hashes(data[base:top], BASES[0])
        grams = mixed(part.all(gram))
        first = low - base
        packed = ((grams[first:first + high - low + length - gram] >> np.uint64(32)) << np.uint64(32)) | np.arange(
            high - low + length - gram, dtype=np.uint64)
        least = (sliding_least(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64) + low
        near, far = np.searchsorted(ends, [low, high - 1], "right")
        doc = np.repeat(np.arange(near, far + 1), np.diff(np.minimum(ends[near:far + 1], high), prepend=low))
        fits = np.arange(low, high) + length <= ends[doc]
        at, doc = least[fits], doc[fits]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        at, doc = at[new], doc[new]
        if len(at) and at[0] == last:
            at, doc = at[1:], doc[1:]
        if not len(at):
            continue
        last = int(at[-1])
        left, right = np.maximum(starts[doc], at - (length - gram)), np.minimum(ends[doc], at + length)
        context = mixed(part.of(left - base, right - base), 0x51ED) ^ mixed(((at - left) * 4 * length + (right - left)).astype(np.uint64))
        yield doc, at - starts[doc], grams[at - base].view(np.int64), context.view(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and where each text ends."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets[1:] - offsets[0]


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (key, context, id, place) of all anchors."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for doc, place, key, context in anchors(*bytes_of(batch.column("text")), length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(context), pa.array(ids[doc]), pa.array(place.astype(np.int32))],
                                                 names=["key", "context", "id", "place"])

    return texts.select("id", "text").mapInArrow(run, "key long, context long, id long, place int")


# Suffix arrays ------------------------------------------------------------------------------------------------------------


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number that sorts like them; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k:len(data) + k]
    return out


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Places sorted by the bytes from them to the end, by Larsson-Sadakane refinement.

    A place's rank is where its group of equals begins. Each pass sorts the groups of two and more by the rank of the place
    as far ahead as the groups are settled, which doubles that distance; settled places are not touched again.
    """
    n = len(words)
    order = np.argsort(words).astype(np.int32)
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1

    def regroup(slots: np.ndarray, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Sets the ranks of sorted places and returns the slots of those still tied."""
        fresh = heads(keys)
        rank[places] = slots[fresh[:-1]][np.cumsum(fresh[:-1]) - 1]
        return slots[~(fresh[:-1] & fresh[1:])]

    tied = regroup(np.arange(n, dtype=np.int32), order, words[order])
    done = 8
    while len(tied):
        places = order[tied]
        keys = rank[places] * np.int64(n + 1) + rank[np.minimum(places + done, n)] + 1
        by = np.argsort(keys)
        places, keys = places[by], keys[by]
        order[tied] = places
        tied = regroup(tied, places, keys)
        done *= 2
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cap: int) -> np.ndarray:
    """For every place the bytes, `cap` at most, it shares with the one before it in the suffix array.

    Kasai's pass: going on by one byte in the text, a common prefix shortens by one byte at most, so it is only read on
    from there. All texts advance together, eight bytes a comparison.
    """
    n = len(words)
    before = np.empty(n, np.int32)
    before[order[1:]] = order[:-1]
    before[order[:1]] = -1
    out, known = np.zeros(n, np.int32), np.zeros(len(starts), np.int64)
    for k in range(int(sizes.max(initial=0))):
        texts = np.nonzero(sizes > k)[0]
        place = starts[texts] + k
        other = before[place]
        room = np.minimum(cap, n - np.maximum(place, other))
        same = np.where(other < 0, 0, np.minimum(np.maximum(known[texts] - 1, 0), room))
        going = np.nonzero((other >= 0) & (same < room))[0]
        while len(going):
            gap = words[place[going] + same[going]] ^ words[other[going] + same[going]]
            equal = sum((gap < np.uint64(1 << (8 * j))).astype(np.int64) for j in range(8))
            same[going] = np.minimum(same[going] + equal, room[going])
            going = going[(equal == 8) & (same[going] < room[going])]
        out[place] = known[texts] = same
    return out


def heads(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in any of the sorted columns, and a last True."""
    out = np.zeros(len(columns[0]) + 1, bool)
    for c in columns:
        out[1:-1] |= c[1:] != c[:-1]
    out[[0, -1]] = True
    return out


def repeated_windows(contexts: list[bytes], offsets: np.ndarray, keys: np.ndarray, length: int, gram: int):
    """Windows around the anchors of a shard, equal ones together: (context number, distance before the anchor, whether it is
    the first of its equals, whether other contexts of its key hold it too), and the shard's data with the contexts' starts."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    words = words_at(data)
    order = suffix_array(words)
    shared = common_prefixes(words, order, starts, sizes, length)
    classes = np.empty(len(data), np.int64)
    classes[order] = np.cumsum(shared[order] < length)
    low = np.maximum(0, offsets - (length - gram))
    counts = np.maximum(np.minimum(offsets, sizes - length) - low + 1, 0)
    owner = np.repeat(np.arange(len(contexts)), counts)
    place = ranges(low, counts)
    ahead, kind = offsets[owner] - place, classes[starts[owner] + place]
    _, group = np.unique(keys, return_inverse=True)
    by = np.lexsort((ahead, group[owner], kind))
    fresh = heads(kind[by], group[owner][by], ahead[by])
    return owner[by], ahead[by], fresh[:-1], ~(fresh[:-1] & fresh[1:]), data, starts


FOUND = "key long, context long, ahead int, left int, right int, first long, second long"


def shard_findings(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of FOUND: stretches (left, right) around anchors repeated within a shard; of keys that span several shards also
    one row for each distinct window, with its fingerprint."""

    def run(group: pa.Table) -> pa.Table:
        keys, context = group.column("key").to_numpy(), group.column("context").to_numpy()
        spread = bool(group.column("spread")[0].as_py())
        owner, ahead, fresh, twice, data, starts = repeated_windows(
            group.column("bytes").to_pylist(), group.column("offset").to_numpy().astype(np.int64), keys, length, gram)
        left, right = np.full(len(keys), -1), np.full(len(keys), -1)
        np.maximum.at(left, owner[twice], ahead[twice])
        np.maximum.at(right, owner[twice], length - ahead[twice])
        hit = np.nonzero(left >= 0)[0]
        empty = pa.nulls(len(hit), pa.int64())
        parts = [pa.table([pa.array(keys[hit]), pa.array(context[hit]), empty.cast(pa.int32()), pa.array(left[hit], pa.int32()),
                           pa.array(right[hit], pa.int32()), empty, empty], names=names)]
        if spread:
            owner, ahead = owner[fresh], ahead[fresh]
            at = starts[owner] + group.column("offset").to_numpy()[owner] - ahead
            prints = [mixed(Hashes(data, b).of(at, at + length), 0xA5A5).view(np.int64) for b in BASES]
            none = pa.nulls(len(owner), pa.int32())
            parts.append(pa.table([pa.array(keys[owner]), pa.array(context[owner]), pa.array(ahead, pa.int32()), none, none,
                                   pa.array(prints[0]), pa.array(prints[1])], names=names))
        return pa.concat_tables(parts)

    names = [f.split()[0] for f in FOUND.split(", ")]
    return contexts.groupBy("spread", "shard", "sub").applyInArrow(run, FOUND)


def merged(windows: DataFrame, length: int) -> DataFrame:
    """Rows (key, context, left, right) of windows that stand in several shards: each is looked up by binary search in the
    merged runs of its slice."""

    def run(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_numpy() for c in ("first", "second", "key", "ahead")]
        every = np.sort(columns[0])
        at = np.nonzero(np.searchsorted(every, columns[0], "right") - np.searchsorted(every, columns[0], "left") > 1)[0]
        at = at[np.lexsort([c[at] for c in columns])]
        fresh = heads(*[c[at] for c in columns])
        at = at[~(fresh[:-1] & fresh[1:])]
        ahead = columns[3][at]
        return pa.table({"key": columns[2][at], "context": group.column("context").to_numpy()[at], "left": pa.array(ahead, pa.int32()),
                         "right": pa.array(length - ahead, pa.int32())})

    slices = max(1, windows.count() // SLICE * 2)
    return (windows.withColumn("slice", F.pmod("first", F.lit(slices))).groupBy("slice")
            .applyInArrow(run, "key long, context long, left int, right int"))


# Passes over the texts ----------------------------------------------------------------------------------------------------


def beside(rows: DataFrame, name: str) -> str:
    """Writes rows with an id next to the texts, a folder for each part of them, sorted by id; returns the folder."""
    path = scratch_path(rows.sparkSession, name)
    (rows.withColumn("part", F.shiftright("id", PART_BITS)).repartition("part").sortWithinPartitions("part", "id")
     .write.partitionBy("part").parquet(path))
    return path


@lru_cache(1)
def part_rows(folder: str, part: int, columns: tuple[str, ...]) -> list[np.ndarray]:
    """Columns of a part's rows; empty if there are none."""
    system, base = opened(folder)
    path = f"{base}/part={part}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return [np.zeros(0, np.int64) for _ in columns]
    files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
    found = pa.concat_tables([pq.read_table(f, columns=list(columns), filesystem=system, partitioning=None) for f in sorted(files)])
    by = np.argsort(found.column("id").to_numpy(), kind="stable")
    return [found.column(c).to_numpy()[by] for c in columns]


def rows_beside(folder: str, ids: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
    """Row number among `ids`, then the columns, of all side rows of a batch."""
    out = []
    for part in np.unique(ids >> PART_BITS).tolist():
        mine, *rest = part_rows(folder, part, ("id", *columns))
        low, high = np.searchsorted(mine, [ids[ids >> PART_BITS == part].min(), ids[ids >> PART_BITS == part].max() + 1])
        by = np.argsort(ids)
        out.append([by[np.searchsorted(ids, mine[low:high], sorter=by)], *[c[low:high] for c in rest]])
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def context_rows(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (key, context, shards, offset, bytes): the contexts of the wanted rows (id, place, key, context, shards)."""
    folder = beside(wanted, "suffix-contexts")

    def run(batches):
        for batch in batches:
            data, ends = bytes_of(batch.column("text"))
            starts = np.concatenate([[0], ends[:-1]])
            doc, place, key, context, shards = rows_beside(folder, batch.column("id").to_numpy(), ("place", "key", "context", "shards"))
            raw = memoryview(data)
            for low in range(0, len(doc), 20_000):
                some = slice(low, low + 20_000)
                at = starts[doc[some]] + place[some]
                left, right = np.maximum(starts[doc[some]], at - (length - gram)), np.minimum(ends[doc[some]], at + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[some]), pa.array(context[some]), pa.array(shards[some]), pa.array((at - left).astype(np.int32)),
                     pa.array([bytes(raw[a:b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)], pa.binary())],
                    names=["key", "context", "shards", "offset", "bytes"])

    return texts.select("id", "text").mapInArrow(run, "key long, context long, shards long, offset int, bytes binary")


def stretches(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (id, place, left, right): around an anchor, the bytes from place - left to place + right repeat, as far as the
    text goes."""
    found = settled(anchor_rows(texts, length, gram), "suffix-anchors")
    often = settled(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "suffix-keys")
    hits = settled(found.join(often, "key"), "suffix-hits")
    contexts = settled(hits.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("first")), "suffix-contexts")
    several = contexts.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = settled(several.withColumn("shards", F.ceil(F.col("kinds") / SPREAD)), "suffix-several")
    wanted = settled(contexts.join(several, "key").select("first.id", "first.place", "key", "context", "shards"), "suffix-wanted")
    shards = wanted.count() * 2 // SHARD + 1
    spread = F.col("shards") > 1
    dealt = context_rows(texts, wanted, length, gram).select(
        "key", "context", "offset", "bytes", spread.alias("spread"),
        F.when(spread, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))).alias("shard"),
        F.when(spread, F.pmod(F.xxhash64("context"), F.col("shards"))).otherwise(F.lit(0)).alias("sub"))
    findings = settled(shard_findings(dealt, length, gram), "suffix-findings")
    whole = contexts.where("n > 1").select("key", "context", F.lit(length - gram).alias("left"), F.lit(length).alias("right"))
    inside = findings.where("left IS NOT NULL").select("key", "context", "left", "right")
    across = merged(findings.where("ahead IS NOT NULL"), length)
    reach = settled(whole.unionByName(inside).unionByName(across).groupBy("key", "context")
                    .agg(F.max("left").alias("left"), F.max("right").alias("right")), "suffix-reach")
    return hits.join(reach, ["key", "context"]).select("id", "place", "left", "right")


def united(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of stretches, touching ones joined."""
    by = np.argsort(low, kind="stable")
    low, high = low[by], np.maximum.accumulate(high[by])
    fresh = np.ones(len(low), bool)
    fresh[1:] = low[1:] > high[:-1]
    return low[fresh], high[np.append(np.nonzero(fresh)[0][1:] - 1, len(low) - 1)] if len(low) else high


def dedup(docs: DataFrame, keep: list[str], length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The kept columns and, for every document: n_bytes, spans (array of start and end of the removed bytes, in order) and
    kept (the remaining bytes)."""
    if not 8 <= gram < length:
        raise ValueError("gram must be at least 8 and below length")
    texts = settled(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
                    .withColumn("id", F.monotonically_increasing_id()), "suffix-texts")
    folder = beside(stretches(texts, length, gram), "suffix-spans")

    def run(batches):
        for batch in batches:
            data, ends = bytes_of(batch.column("text"))
            starts = np.concatenate([[0], ends[:-1]])
            doc, place, left, right = rows_beside(folder, batch.column("id").to_numpy(), ("place", "left", "right"))
            by = np.argsort(doc, kind="stable")
            doc, place, left, right = doc[by], place[by], left[by], right[by]
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            spans, kept, raw = [], [], memoryview(data)
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                mine = slice(bounds[k], bounds[k + 1])
                low, high = united(np.maximum(place[mine].astype(np.int64) - left[mine], 0), np.minimum(place[mine].astype(np.int64) + right[mine], b - a))
                cuts = list(zip(low.tolist(), high.tolist(), strict=True))
                spans.append([{"start": i, "end": j} for i, j in cuts])
                kept.append(b"".join(raw[a + i:a + j] for i, j in zip([0, *high.tolist()], [*low.tolist(), b - a], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(ends - starts), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=["row", "n_bytes", "spans", "kept"])

    schema = passed(texts, ["row"], "n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return texts.mapInArrow(run, schema).select("row.*", "n_bytes", "spans", "kept")
