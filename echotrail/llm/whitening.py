"""Embedding whitening: principal axes by mixed-precision refinement of a distributed covariance.

Components become the integers floor(`SCALE` * c) + `SHIFT`; equal integer vectors count once. Sums of the distinct vectors are
exact integers. A second pass centres every vector and adds up outer products in each partition; the partitions' matrices,
dimension^2 numbers each, are added by an aggregation, so the driver sees one matrix whose size the data's rows do not
change.

Its eigenvectors are first found in float32 and then corrected by Ogita-Aishima steps: with X the
current vectors, R = I - X'X and S = X'AX, every step adds X E, where E has (S + lambda R) / (lambda_j - lambda_i) off the
diagonal and R / 2 on it and wherever two eigenvalues are too close to be told apart. The products run in the widest
floating-point type of the platform (80 bits on x86), or in double precision above `WIDE` dimensions. A cluster of close
eigenvalues is solved on its own between the steps: the small matrix X_c' A X_c, shifted by its mean, is diagonalised in
double precision and its rotation applied, which separates directions that float32 mixed up.

A vector's whitened value on a component is its centred projection over the root of the eigenvalue. The covariance of
the whitened fit vectors is measured in a further pass and compared with the identity.

Dropped are vectors that are null, empty or hold null or non-finite components, those with a component of 2^31 or more after
scaling, and those whose length is not the commonest one (ties: the shorter). If the covariance has no more than k
independent directions, the components after the k-th have a null whitened value and are left out of identity_error.
deviation is null where it leaves 64 bits. Repeated rows are returned each. An empty table gives an empty result. Vectors
without vec_id are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import settled

SCALE, SHIFT, COMPONENTS, WIDE = 64, 1_000_000, 16, 256
#: Vectors multiplied at once; refinement steps at most.
BLOCK, STEPS = 4_000, 12


def whole_numbers(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """Rows (vec_id, x) of the usable vectors of the commonest length."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float(1 << 31))
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.forall("embedding", fine))
    rows = settled(usable.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale) + shift).alias("x")), "whitening-vectors")
    common = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("x") == (common["size"] if common else 0))


def matrices(batches):
    """Vectors of Arrow batches as integer matrices, block by block."""
    for batch in batches:
        if batch.num_rows:
            whole = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            for low in range(0, len(whole), BLOCK):
                yield whole[low:low + BLOCK]


def added_up(rows: DataFrame, value, kind: str) -> list:
    """Sum over all blocks of value(block), a matrix; one row a partition and line of the matrix meets in the sum."""

    def run(batches):
        total = None
        for block in matrices(batches):
            part = value(block)
            total = part if total is None else total + part
        for k, line in enumerate(total if total is not None else []):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([line.tolist()])], names=["line", "cells"])

    cells = rows.select("x").mapInArrow(run, f"line int, cells array<{kind}>")
    sums = cells.select("line", F.posexplode("cells").alias("at", "cell")).groupBy("line", "at").agg(F.sum("cell").alias("cell"))
    found = sums.groupBy("line").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "cell"))), lambda c: c["cell"]).alias("cells"))
    return [r["cells"] for r in found.orderBy("line").collect()]


def refined(matrix: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, from a float32 start."""
    size = len(matrix)
    wide = np.longdouble if size <= WIDE else np.float64
    scale = float(np.abs(matrix).max()) if size else 0.0
    if scale == 0:
        return np.zeros(size), np.eye(size)
    a = matrix.astype(wide) / wide(scale)
    x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(wide)
    bound = 0.0
    for _ in range(steps):
        r = np.eye(size, dtype=wide) - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        size_of = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum()))
        bound = 2 * (size_of(s - np.diag(values)) + size_of(a) * size_of(r))
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > bound
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
        e = (e - e.T + r) / 2  # rounding over a small gap must not bend right angles: E + E' is R
        x = x + x @ e
        x = separated(a, x, values, bound)
        if size_of(e[apart]) + size_of(r) < 1e-17 * size:
            break
    x = x / np.sqrt((x * x).sum(0))
    values = (x * (a @ x)).sum(0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * wide(scale)).astype(np.float64), x[:, order].astype(np.float64)


def separated(a: np.ndarray, x: np.ndarray, values: np.ndarray, bound: float) -> np.ndarray:
    """Sub-solves: directions of every cluster of eigenvalues no further apart than the bound are turned onto its own axes."""
    order = np.argsort(-values, kind="stable")
    out = x.copy()
    start = 0
    for k in range(1, len(order) + 1):
        if k < len(order) and abs(values[order[k]] - values[order[k - 1]]) <= bound:
            continue
        mine = order[start:k]
        start = k
        if len(mine) > 1:
            part = x[:, mine]
            gram = np.linalg.inv(np.linalg.cholesky((part.T @ part).astype(np.float64))).astype(x.dtype)
            part = part @ gram.T
            part = part + part @ ((np.eye(len(mine), dtype=x.dtype) - part.T @ part) / 2)
            small = part.T @ (a @ part)
            mean = np.trace(small) / len(mine)
            turn = np.linalg.eigh((small - mean * np.eye(len(mine), dtype=x.dtype)).astype(np.float64))[1][:, ::-1]
            out[:, mine] = part @ turn.astype(x.dtype)
    return out


class Model:
    """n, exact sums, eigenvalues and eigenvectors of a fit; `axes` are the directions over the roots of their eigenvalues."""

    def __init__(self, n: int, sums: list[int], matrix: np.ndarray, components: int) -> None:
        self.n, self.sums = n, sums
        self.values, self.vectors = refined(matrix)
        self.trace = float(np.trace(matrix))
        self.count = min(components, len(sums))
        least = len(sums) * np.finfo(float).eps * max(self.trace, 0.0)
        self.known = self.values[:self.count] > least
        self.axes = self.vectors[:, :self.count] / np.sqrt(np.where(self.known, self.values[:self.count], 1.0))
        #: Whole and fractional part of the mean, so that centring loses nothing.
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def centred(self, block: np.ndarray) -> np.ndarray:
        return (block - self.whole).astype(np.float64) - self.rest


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Model | None, float | None]:
    """Model of the distinct vectors of `rows` (column x), and the largest entry of their whitened covariance minus the
    identity."""
    distinct = settled(rows.select("x").distinct(), "whitening-distinct")
    n = distinct.count()
    if not n:
        return None, None
    sums = [int(v) for v in added_up(distinct, lambda b: b.sum(0, keepdims=True), "long")[0]]
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])

    def outer(block):
        near = (block - whole).astype(np.float64) - rest
        return near.T @ near

    matrix = np.array(added_up(distinct, outer, "double")) / n
    model = Model(n, sums, (matrix + matrix.T) / 2, components)
    axes, known = model.axes, model.known
    if not known.any():
        return model, None

    def products(block):
        w = ((block - whole).astype(np.float64) - rest) @ axes
        return np.concatenate([w.T @ w, w.sum(0, keepdims=True)])

    found = np.array(added_up(distinct, products, "double")) / n
    spread = (found[:-1] - np.outer(found[-1], found[-1]))[known][:, known]
    return model, float(np.abs(spread - np.eye(len(spread))).max())


def whiten(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), one for each usable vector and component."""
    rows = whole_numbers(vectors, scale, shift)
    model, error = fit(rows, components)
    schema = (f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    sums, n, count = model.sums, model.n, model.count
    explained = model.values[:count] / model.trace if model.trace > 0 else np.full(count, np.nan)

    def run(batches):
        for batch in batches:
            done = 0
            for block in matrices([batch]):
                ids = batch.column("vec_id").slice(done, len(block))
                done += len(block)
                off, rest = block - model.whole, np.array([s % n for s in sums])
                if (int(np.abs(off).max()) * n + n) ** 2 * block.shape[1] < 1 << 63:
                    gap = off * n - rest
                    deviation = pa.array((gap * gap).sum(1))
                else:
                    gaps = [[int(v) * n - int(r) for v, r in zip(line, rest, strict=True)] for line in off.tolist()]
                    total = [sum(g * g for g in line) for line in gaps]
                    deviation = pa.array([t if t < 1 << 63 else None for t in total], pa.int64())
                values = model.centred(block) @ model.axes
                rows_of = np.repeat(np.arange(len(block)), count)
                empty = np.tile(~model.known, len(block))
                each = np.tile(explained, len(block))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(block))),
                     pa.array(np.full(len(rows_of), n)), deviation.take(pa.array(rows_of)), pa.array(values.ravel(), mask=empty),
                     pa.array(each, mask=np.isnan(each)), pa.array([error] * len(rows_of), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
