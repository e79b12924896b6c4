"""Embedding near-dedup: a pigeonhole join over subspaces of rotated vectors.

For unit vectors a cosine of at least c is a squared distance of at most 2 - 2c. All vectors of a label are turned by
one fixed random rotation, which spreads distance evenly, and split into blocks of few dimensions. If two vectors link,
some block holds no more than its share of the squared distance, in proportion to its dimensions. Each block is a range
join: a grid on the block's first coordinates, cells two radii wide, deals every vector to its cell and to those half of
the neighbouring cells that its radius reaches; inside a cell the block distances decide. The union of the candidates is
verified by the exact cosine in double precision, so no link is lost and none below c is kept. The grid has `GRID`
coordinates, and one more for each doubling of a label's distinct vectors above `TILE` * 2^`GRID`, up to the block's.

Equal vectors of a label are one representative with a count. A crowded cell is split into tiles, its home rows by `TILE`
and the rows that look for partners by `LOOKS` times as many; every tile of the one kind meets every tile of the other in
a group of its own. So neither side of a group outgrows its size by more than chance, whatever a label or a cell holds.
The work still grows with the square of what shares a cell: a label of n distinct vectors, spread over the grid, costs
about n * n / 2^coordinates distances a block, times the cells a vector looks into. Candidates carry ids alone.

Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing:
no links, their own component, kept. Vectors of different length never link. Repeated rows count as vectors of their
own. The component of vectors without vec_id is null if no member has one. Other columns are not passed through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import components, settled

COSINE, BLOCK, GRID, TILE, SEED = 0.93, 8, 2, 2_000, 7
#: Looking rows of a group for each home row it may hold.
LOOKS = 4


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link at all."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)
    return F.coalesce(label.isNotNull() & vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def cells(scaled: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code of the cell, whether it is the row's own): the own cell and, of the neighbours within half a cell, those
    after it in the order of steps; rows of the others look this way."""
    cell = np.floor(scaled).astype(np.int64)
    row, code = np.arange(len(scaled)), np.zeros(len(scaled), np.int64)
    gone, own = np.zeros(len(scaled)), np.ones(len(scaled), bool)
    for k in range(dims):
        parts = []
        for move in (-1, 0, 1):
            gap = (cell[row, k] + 1 - scaled[row, k]) if move > 0 else (scaled[row, k] - cell[row, k]) if move < 0 else np.zeros(len(row))
            far = gone + gap * gap
            near = (far <= 0.25) & (~own if move < 0 else True)
            parts.append((row[near], code[near] * 1_000_003 + cell[row[near], k] + move, far[near], own[near] & (move == 0)))
        row, code, gone, own = (np.concatenate(x) for x in zip(*parts, strict=True))
    return row, code, own


def grid_sizes(reps: DataFrame, grid: int = GRID, block: int = BLOCK, tile: int | None = None) -> DataFrame:
    """Rows (label, grid): how many coordinates a label's grid has."""
    n = F.ceil(F.log2(F.count("*") / (tile or TILE))).cast("int")
    return reps.groupBy("label").agg(F.least(F.greatest(n, F.lit(grid)), F.lit(block)).alias("grid"))


def block_rows(reps: DataFrame, cosine: float, block: int = BLOCK, grid: int = GRID) -> DataFrame:
    """Rows (label, size, block, cell, rep, home, inside, place): a vector at home in its cell, or looking into a cell."""
    total = 2 - 2 * cosine

    def run(batches):
        for batch in batches:
            labels, ids = batch.column("label").to_numpy(zero_copy_only=False), batch.column("rep").to_numpy()
            grids = batch.column("grid").to_numpy()
            lists = batch.column("embedding")
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for size, wide in sorted(set(zip(lengths.tolist(), grids.tolist(), strict=True))):
                rows = np.nonzero((lengths == size) & (grids == wide))[0]
                x = flat[(starts[rows][:, None] + np.arange(size))]
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(int(size))
                for b, at in enumerate(range(0, size, block)):
                    part = x[:, at:at + block]
                    radius = math.sqrt(total * part.shape[1] / size * (1 + 1e-4) + 1e-6)
                    dims = min(wide, part.shape[1])
                    for begin in range(0, len(rows), 2_000):
                        near, code, own = cells(part[begin:begin + 2_000, :dims] / (2 * radius), dims)
                        near = near + begin
                        for home, picked in ((True, own), (False, np.ones(len(near), bool))):
                            at_home, where, inside = near[picked], code[picked], own[picked]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(labels[rows][at_home]), pa.array(np.full(len(at_home), size, np.int32)), pa.array(np.full(len(at_home), b, np.int32)),
                                 pa.array(where), pa.array(ids[rows][at_home]), pa.array(np.full(len(at_home), home)), pa.array(inside),
                                 pa.FixedSizeListArray.from_arrays(pa.array(part[at_home].astype(np.float32).ravel()), part.shape[1]).cast(pa.list_(pa.float32()))],
                                names=["label", "size", "block", "cell", "rep", "home", "inside", "place"])

    label = reps.schema["label"].dataType.simpleString()
    return reps.join(grid_sizes(reps, grid, block), "label").select("label", "rep", "embedding", "grid").mapInArrow(
        run, f"label {label}, size int, block int, cell long, rep long, home boolean, inside boolean, place array<float>")


def candidates(rows: DataFrame, cosine: float, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """Distinct pairs (a, b), a < b, whose distance in some block is within the block's share."""
    total, key = 2 - 2 * cosine, ["label", "size", "block", "cell"]
    tiles = lambda mine, n: F.greatest(F.ceil(F.sum(mine.cast("int")) / n), F.lit(1)).cast("int")
    crowded = rows.groupBy(*key).agg(tiles(F.col("home"), tile).alias("tiles"), tiles(~F.col("home"), LOOKS * tile).alias("looks")).where(
        "tiles > 1 OR looks > 1")
    dealt = rows.join(crowded, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("looks", F.coalesce("looks", F.lit(1)))
    own = lambda n: F.array(F.pmod(F.xxhash64("rep"), n).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = (dealt.withColumn("tile", F.explode(F.when(F.col("home"), own("tiles")).otherwise(every("tiles"))))
             .withColumn("look", F.explode(F.when(F.col("home"), every("looks")).otherwise(own("looks")))))

    def pairs(group: pa.Table) -> pa.Table:
        home = group.column("home").to_numpy()
        inside, ids = group.column("inside").to_numpy(), group.column("rep").to_numpy()
        lists = group.column("place").combine_chunks()
        place = lists.flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)
        limit = total * place.shape[1] / int(group.column("size")[0].as_py()) * (1 + 1e-4) + 1e-6
        at, look = np.nonzero(home)[0], np.nonzero(~home)[0]
        out = []
        squares = (place * place).sum(1)
        for k in range(0, len(look), 512):
            probe = look[k:k + 512]
            near = squares[probe][:, None] + squares[at][None, :] - 2 * place[probe] @ place[at].T <= limit
            i, j = np.nonzero(near)
            i, j = probe[i], at[j]
            ok = np.where(inside[i], ids[i] < ids[j], ids[i] != ids[j])
            out.append(np.stack([np.minimum(ids[i[ok]], ids[j[ok]]), np.maximum(ids[i[ok]], ids[j[ok]])]))
        a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy(*key, "tile", "look").applyInArrow(pairs, "a long, b long").distinct()


def cosine_of(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def classes(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each vector."""
    marked = vectors.select("vec_id", F.col("label"), "embedding", usable(F.col("embedding"), F.col("label")).alias("fine"))
    marked = settled(marked.withColumn("rep", F.when(F.col("fine"), F.xxhash64("label", "embedding"))), "vectors")
    reps = settled(marked.where("fine").groupBy("rep", "label", "embedding")
                   .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")), "vector-representatives")
    rows = settled(block_rows(reps, cosine), "vector-blocks")
    sides = [reps.select(F.col("rep").alias(n), F.col("embedding").alias(f"v{n}"), F.col("copies").alias(f"n{n}")) for n in "ab"]
    exact = candidates(rows, cosine).join(sides[0], "a").join(sides[1], "b").where(cosine_of(F.col("va"), F.col("vb")) >= cosine)
    links = settled(exact.select("a", "b", "na", "nb"), "vector-links")
    counts = links.select(F.col("a").alias("rep"), F.col("nb").alias("n")).unionByName(
        links.select(F.col("b").alias("rep"), F.col("na").alias("n"))).groupBy("rep").agg(F.sum("n").alias("n"))
    groups = components(links.select("a", "b"), "vector-components").withColumnRenamed("node", "rep")
    named = (reps.select("rep", "copies", "least").join(counts, "rep", "left").join(groups, "rep", "left")
             .withColumn("component", F.coalesce("component", "rep")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    info = named.join(least, "component").select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = marked.join(info, "rep", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
