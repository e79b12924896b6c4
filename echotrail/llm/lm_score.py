"""LM scoring: stupid-backoff scores from n-gram counts over the whole corpus, summed per document.

A word's score is log(count of its n-gram / count of the n-gram's context) for the longest order whose n-gram occurs at
least `min_count` times; each order backed off adds log(0.4); a single word scores log(count / all words). Documents
stay where they are: a part is a block of rows of one input file, known by file and row number, so that another reading
or a lost executor finds the same parts. Passages of a part list their distinct n-grams (64-bit hashes) with their counts,
cut into ranges of the hash; the count table of a range is their sum, and a join in that range answers every part with
the totals of its own n-grams, as small files by part in the shared folder. An n-gram can reach `min_count` only if
its first and last n - 1 words do, so longer orders are asked in a second pass, where both shorter ones were answered; n-grams
below `min_count` get no answer. Tasks then look up all positions and sum per document. Texts are never shuffled; documents
that do not come from a plain scan are written first. An
n-gram leaves a passage once however often it occurs, so a frequent n-gram is no hot key; rows of a part and the number
of ranges follow the corpus, so groups keep their size.

Hash equality stands for n-gram equality (64 bits). Words are separated by ASCII white space. Null and empty texts have
no words and the score 0. Repeated rows count, and are scored, each. An empty table gives no rows. Ids, nulls included,
pass through; other columns are not kept unless named.
"""

from __future__ import annotations

import itertools
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import Numbered, passed, settled, small_batches
from echotrail.llm.token_files import opened
from echotrail.session import scratch_path

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 2
#: Bytes of text of a passage (and, on average, of a part), and of the corpus for each range of hashes.
PART, RANGE, WORDS_KEPT = 12_000_000, 8_000_000, 300_000
ASKED = pa.schema([("part", pa.int64()), ("gram", pa.int32()), ("slot", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
ANSWERED = pa.schema([("part", pa.int64()), ("gram", pa.int32()), ("slot", pa.int32()), ("shift", pa.int32()), ("hashes", pa.binary()),
                      ("totals", pa.binary()), ("words", pa.int64())])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers byte plane by byte plane: planes of small numbers are zeros and compress away."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def unpacked(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def gram_hashes(table: pa.Table, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words in each text, and for every order the hash of the n-gram that ends at each word (0 where there is none)."""
    words, hashes = Numbered(), array("Q")
    counts, own = [], []
    for _, texts in small_batches(table.to_batches(), "text"):
        if len(words) > WORDS_KEPT:
            words, hashes = Numbered(), array("Q")
        split = [t.encode("utf-8", "replace").split() for t in texts]
        number = words.numbers([w for s in split for w in s])
        hashes.extend([xxhash.xxh64_intdigest(w) | 1 for w in words.new])
        words.new.clear()
        own.append(np.frombuffer(hashes, np.uint64)[number] if len(number) else np.zeros(0, np.uint64))
        counts += [len(s) for s in split]
    counts = np.array(counts, np.int64)
    first = np.concatenate([*own, np.zeros(0, np.uint64)])
    place = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = [first]
    for n in range(2, order + 1):
        longer = np.zeros_like(first)
        longer[1:] = (out[-1][:-1] * _MIX ^ (first[1:] >> np.uint64(7))) * _MIX + first[1:] + np.uint64(n)
        longer[place < n - 1] = 0
        out.append(longer)
    return counts, out


def passages(batches, keep: list[str]):
    """Tables of consecutive rows of one part with at most about PART bytes of text (one text at least)."""
    held, size = [], 0
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = [0, *(np.nonzero(np.diff(parts))[0] + 1), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            for piece, _ in small_batches([batch.slice(a, b - a)], "text", PART):
                more = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
                if held and (size + more > PART or held[0].column("part")[0] != piece.column("part")[0]):
                    yield pa.Table.from_batches(held).select([*keep, "part", "text"])
                    held, size = [], 0
                held.append(piece)
                size += more
    if held:
        yield pa.Table.from_batches(held).select([*keep, "part", "text"])


def known(folder: str, part: int) -> list[dict]:
    """The answers for a part's n-grams: rows (gram, slot, shift, hashes, totals)."""
    system, base = opened(folder)
    path = f"{base}/part={part}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return []
    files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
    columns = ["gram", "slot", "shift", "hashes", "totals"]
    return pa.concat_tables([pq.read_table(f, columns=columns, filesystem=system, partitioning=None) for f in files]).to_pylist()


def looked_up(values: np.ndarray, answers: list[dict], gram: int, edges: np.ndarray, missing: int) -> np.ndarray:
    """Totals of n-gram hashes that were asked for; `missing` for those not answered."""
    kinds, where = np.unique(values, return_inverse=True)
    found = np.full(len(kinds), missing, np.uint64)
    cuts = np.append(np.searchsorted(kinds, edges), len(kinds))
    for row in answers:
        own = slice(cuts[row["slot"]], cuts[row["slot"] + 1])
        grams = np.cumsum(unpacked(row["hashes"], "<u8"), dtype=np.uint64)
        if row["gram"] == gram and own.start < own.stop and len(grams):
            short = kinds[own] >> np.uint64(row["shift"])
            at = np.minimum(np.searchsorted(grams, short), len(grams) - 1)
            found[own] = np.where(grams[at] == short, unpacked(row["totals"], "<u8")[at], np.uint64(missing))
    return found[where]


def live(totals: np.ndarray) -> np.ndarray:
    """Where an n-gram can count: both n-grams one word shorter were answered."""
    out = totals > 0
    out[1:] &= out[:-1].copy()
    return out


def slot_edges(ranges: int) -> np.ndarray:
    return np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)


def ask(orders: list[int], ranges: int, shorter: str | None):
    """Rows (part, gram, slot, hashes, counts): the distinct n-grams of each passage, by range of hash.

    With `shorter`, the folder of the answers for the order below, only n-grams whose two shorter ones were answered.
    """
    edges = slot_edges(ranges)

    def run(batches):
        part, answers = None, []
        for texts in passages(batches, []):
            own = texts.column("part")[0].as_py()
            if shorter and own != part:
                part, answers = own, known(shorter, own)
            hashes, rows = gram_hashes(texts, max(orders))[1], []
            for n in orders:
                values = hashes[n - 1]
                if shorter:
                    values = values[live(looked_up(hashes[n - 2], answers, n - 1, edges, 0))]
                grams, times = np.unique(values[values > 0], return_counts=True)
                cuts = np.append(np.searchsorted(grams, edges), len(grams))
                for slot in np.nonzero(np.diff(cuts))[0]:
                    a, b = cuts[slot], cuts[slot + 1]
                    rows.append((own, n, int(slot), packed(np.diff(grams[a:b], prepend=np.uint64(0))), packed(times[a:b].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ASKED)], schema=ASKED)

    return run


def shortest(grams: np.ndarray) -> int:
    """The most low bits that sorted distinct numbers can lose and still differ."""
    return int(np.min(grams[1:] ^ grams[:-1])).bit_length() - 1 if len(grams) > 1 else 0


def answer(min_count: int):
    """For one order and range: the count table summed over all passages, joined back to each part's n-grams.

    N-grams below `min_count` get no answer; single words get one from two occurrences on. Hashes are cut to the leading
    bits that tell the n-grams which the part asked for apart, unanswered ones included, so a lookup stays exact.
    """
    def run(key, table):
        least = 2 if key[0].as_py() == 1 else min_count
        table = table.sort_by("part")
        parts = table.column("part").to_numpy()
        grams = [np.cumsum(unpacked(x, "<u8"), dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        times = np.concatenate([unpacked(x, "<u4") for x in table.column("counts").to_pylist()])
        ends = np.cumsum([len(g) for g in grams])
        grams = np.concatenate(grams)
        kinds, where = np.unique(grams, return_inverse=True)
        totals = np.bincount(where, times, len(kinds)).astype(np.uint64)
        del grams
        first = np.nonzero(np.append(True, parts[1:] != parts[:-1]))[0]
        stops = ends[np.append(first[1:], len(parts)) - 1]
        rows = []
        for part, a, b in zip(parts[first], np.append(0, stops[:-1]), stops, strict=True):
            own = np.unique(where[a:b])
            shift = np.uint64(shortest(kinds[own]))
            seen = own[totals[own] >= least]
            rows.append((part, key[0].as_py(), key[1].as_py(), int(shift), packed(np.diff(kinds[seen] >> shift, prepend=np.uint64(0))), packed(totals[seen]), int(times[a:b].sum())))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ANSWERED)], schema=ANSWERED)

    return run


def backed_off(counts: np.ndarray, totals: list[np.ndarray], words: int, min_count: int, backoff: float) -> np.ndarray:
    """Sum of the words' scores of each text; totals holds for every order the count of the n-gram ending at each word."""
    place = np.arange(len(totals[0])) - np.repeat(np.cumsum(counts) - counts, counts)
    value = np.log(totals[0] / max(words, 1))
    for n in range(2, len(totals) + 1):
        context = np.concatenate([[1], totals[n - 2][:-1]])
        seen = (place >= n - 1) & (totals[n - 1] >= min_count)
        found = np.log(np.maximum(totals[n - 1], 1) / np.maximum(context, 1))
        value = np.where(seen, found, np.where(place >= n - 1, value + np.log(backoff), value))
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(owner, value, len(counts)).astype(float)


def score(docs: DataFrame, keep: list[str], order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """The kept columns with n_words and lm_score, the sum of the words' log scores."""
    spark, names = docs.sparkSession, [f"__{k}" for k in range(len(keep))]
    place = ["_metadata.file_path", "_metadata.row_index"]
    try:
        docs.select(*place)
    except AnalysisException:  # not a plain scan: write it, so that rows have places
        docs = settled(docs.select(*dict.fromkeys([*keep, "text"])), "placed-documents")
    size, count = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    ranges, rows = -(-(size or 0) // RANGE) or 1, max(1, PART * count // (size or 1))
    placed = docs.select(*[F.col(c).alias(n) for n, c in zip(names, keep, strict=True)], "text",
                         F.xxhash64(place[0], F.floor(F.col(place[1]) / rows)).alias("part"))
    texts = placed.select("text", "part")

    def answered(orders: list[int], shorter: str | None) -> str:
        asked = texts.mapInArrow(ask(orders, ranges, shorter), "part long, gram int, slot int, hashes binary, counts binary")
        replies = asked.groupBy("gram", "slot").applyInArrow(answer(min_count), "part long, gram int, slot int, shift int, hashes binary, totals binary, words long")
        path = scratch_path(spark, "gram-totals")
        replies.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(path)
        return path

    folders = [answered([1, 2][:order], None)]
    for n in range(3, order + 1):
        folders.append(answered([n], folders[-1]))
    schema = "gram int, words long, part long"
    words = spark.read.schema(schema).parquet(folders[0]).where("gram = 1").agg(F.sum("words")).first()[0] or 0

    def run(batches):
        part, answers, edges = None, [], slot_edges(ranges)
        for table in passages(batches, names):
            own = table.column("part")[0].as_py()
            if own != part:
                part, answers = own, [row for folder in folders for row in known(folder, own)]
            counts, grams = gram_hashes(table, order)
            totals = []
            for n, values in enumerate(grams, 1):
                asked = values > 0 if n < 3 else live(totals[-1]) & (values > 0)
                found = np.zeros(len(values))
                found[asked] = looked_up(values[asked], answers, n, edges, int(n == 1))
                totals.append(found)
            columns = [*[table.column(c) for c in names], pa.array(counts, pa.int64()), pa.array(backed_off(counts, totals, words, min_count, backoff), pa.float64())]
            yield from pa.Table.from_arrays(columns, names=[*names, "n_words", "lm_score"]).to_batches()

    out = placed.mapInArrow(run, passed(placed, names, "n_words long, lm_score double"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_words", "lm_score")
