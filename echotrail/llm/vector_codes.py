"""Vector code compression: product codes trained by equal-average nearest-neighbour search.

A vector's components become the integers floor(`SCALE` * x), cut into `PARTS` equal consecutive parts. Every part position
has a codebook of `ENTRIES` entries, at first that part of the vectors with the smallest vec_ids. Each round assigns every
part to its nearest entry (squared Euclidean distance, ties to the lower index) and replaces an entry by the
componentwise floor of its parts' mean; unused entries stay.

Equal-average search: for a part with component sum t and an entry with sum s, (t - s)^2 / dimension is at most their squared
distance. Entries are sorted by their sums; the search starts at the part's own sum and goes outward, always to the side with the
smaller gap, and ends only when gap^2 / dimension strictly exceeds the best distance, so that ties are still seen. All in
integers, hence exact; blocks of parts go outward together.

Assigning runs where the vectors lie; a round shuffles one row for each entry and partition, and brings entries * parts
rows of sums to the driver, a number that does not depend on the data. Codebooks travel with the tasks.

Dropped are vectors that are null, empty or hold null or non-finite components, those with a component of 2^25 or more in
absolute value after scaling (squares would leave 64 bits), and those whose length is not that of the smallest kept vec_id
or not a multiple of `PARTS`. Ties on vec_id are broken by the vector; null vec_ids come last. With fewer than
`ENTRIES` vectors the codebooks are that much smaller. Repeated rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import settled

SCALE, PARTS, ENTRIES, ROUNDS, LIMIT = 256, 16, 64, 2, 1 << 25
#: Vectors that are assigned together.
BLOCK = 4_000


def whole_numbers(vectors: DataFrame, scale: int, parts: int) -> DataFrame:
    """Rows (vec_id, label, x) of the usable vectors, x the scaled integers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT)
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.forall("embedding", fine))
    rows = settled(usable.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("x")), "code-vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x").alias("n")).first()
    size = first["n"] if first else 0
    return rows.where((F.size("x") == size) & (F.lit(size) % parts == 0))


def first_entries(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks (part, entry, component) from the smallest vec_ids."""
    found = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    whole = np.array([r["x"] for r in found], np.int64)
    return whole.reshape(len(whole), parts, -1).transpose(1, 0, 2) if len(whole) else np.zeros((parts, 0, 1), np.int64)


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each row, ties to the lower index, by equal-average search."""
    size, dims = entries.shape
    sums = entries.sum(1)
    order = np.argsort(sums, kind="stable")
    ordered, total = sums[order], part.sum(1)
    up = np.searchsorted(ordered, total)
    down = up - 1
    best, index = np.full(len(part), np.iinfo(np.int64).max), np.full(len(part), size)
    live = np.arange(len(part))
    far = np.iinfo(np.int64).max
    while len(live):
        above, below = up[live], down[live]
        rise = np.where(above < size, ordered[np.minimum(above, size - 1)] - total[live], far)
        fall = np.where(below >= 0, total[live] - ordered[np.maximum(below, 0)], far)
        gap = np.minimum(rise, fall)
        left = gap < far
        left[left] = ~((best[live][left] < far) & (gap[left] * gap[left] > best[live][left] * dims))
        live, above, below, rises = live[left], above[left], below[left], (rise <= fall)[left]
        at = order[np.where(rises, above, below)]
        gaps = part[live] - entries[at]
        distance = (gaps * gaps).sum(1)
        better = (distance < best[live]) | ((distance == best[live]) & (at < index[live]))
        best[live] = np.where(better, distance, best[live])
        index[live] = np.where(better, at, index[live])
        up[live] += rises
        down[live] -= ~rises
    return index, best


def blocks(batch: pa.RecordBatch):
    """Row slices of a batch with their vectors as a matrix."""
    lists = batch.column("x")
    if len(lists):
        matrix = lists.flatten().to_numpy().reshape(len(lists), -1)
        for low in range(0, len(lists), BLOCK):
            yield slice(low, low + BLOCK), matrix[low:low + BLOCK]


def trained(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round of assigning and averaging."""
    parts, entries, dims = books.shape

    def run(batches):
        sums, counts = np.zeros((parts, entries, dims), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, matrix in blocks(batch):
                for p in range(parts):
                    mine = matrix[:, p * dims:(p + 1) * dims]
                    at, _ = nearest(mine, books[p])
                    np.add.at(sums[p], at, mine)
                    counts[p] += np.bincount(at, minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]),
                                          pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    partial = rows.select("x").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dims)]).collect()
    out = books.copy()
    for r in found:
        out[r["part"], r["entry"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    return out


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after all rounds."""
    books = first_entries(rows, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = trained(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Rows (vec_id, label, codes, error): an entry index for each part, and the squared distance over all parts."""
    parts, entries, dims = books.shape

    def run(batches):
        for batch in batches:
            for some, matrix in blocks(batch):
                found = [nearest(matrix[:, p * dims:(p + 1) * dims], books[p]) for p in range(parts)]
                codes = np.stack([f[0] for f in found], 1).astype(np.int32)
                error = np.sum([f[1] for f in found], axis=0)
                kept = batch.slice(some.start, len(matrix))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("vec_id"), kept.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), parts).cast(pa.list_(pa.int32())),
                     pa.array(error, pa.int64())], names=["vec_id", "label", "codes", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """Adds `restored`, the vector that the codes stand for: the middles of the entries' integer cells, scaled back."""
    cells = F.lit([[[(int(v) + 0.5) / scale for v in entry] for entry in part] for part in books])
    return codes.withColumn("restored", F.flatten(F.transform("codes", lambda c, p: cells[p][c])))


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors, rows (vec_id, label, codes, error, label_error), and the codebooks.

    label_error is the error summed over equal labels, null labels together.
    """
    rows = whole_numbers(vectors, scale, parts)
    books = codebooks(rows, parts, entries, rounds)
    coded = settled(encode(rows, books), "codes")
    sums = settled(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "code-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
