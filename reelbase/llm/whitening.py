"""Whitening of embeddings: centred rows are reduced by blockwise QR, the factor R is made bidiagonal, its singular values come from the qd algorithm with shifts and its
right singular vectors from twisted factorisations.

Each task folds its rows, block by block, into one triangle of the vectors' dimension; triangles are stacked and reduced again in a tree, so that no task and not
the driver sees more than some of them. The triangle has the singular values of all rows: the covariance itself is never formed, which would square their spread. What is left is a
matrix of the vectors' dimension, whose decomposition runs on the driver and does not grow with the input.
"""

from __future__ import annotations

import math
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbase.llm.common import cut, small_batches

EPS = float(np.finfo(float).eps)
BASE = 1_000_000


# ---- the small matrix: bidiagonal form, singular values, vectors


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and upper diagonal of U' r V by Householder reflections, and the unit vectors of those that make up V."""
    a, rights = r.astype(float).copy(), []
    n = a.shape[1]

    def reflection(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        v[0] += math.copysign(float(np.linalg.norm(x)), x[0])
        size = np.linalg.norm(v)
        return v / size if size else v

    for k in range(n):
        v = reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            w = reflection(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            rights.append(w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), rights


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd transform; None if the shift was too large. Also returns the d values."""
    d, ds, new_q, new_e = q[0] - shift, [], [], []
    for k in range(len(e)):
        if d < 0:
            return None
        ds.append(d)
        top = d + e[k]
        new_q.append(top)
        ratio = q[k + 1] / top if top else 0.0
        new_e.append(e[k] * ratio)
        d = d * ratio - shift if top else q[k + 1] - shift
    if d < 0:
        return None
    return [*new_q, d], new_e, [*ds, d]


def singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, falling, by dqds: each shift is the lower bound of the smallest eigenvalue that the d values of a transform without
    shift give (one over the sum of their inverses), so nothing is ever subtracted that would leave an inaccurate rest."""
    out, waiting = [], [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while waiting:
        q, e, shifted = waiting.pop()
        while q:
            if len(q) == 1:
                out.append(shifted + q.pop())
                break
            split = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * (shifted + min(q[k], q[k + 1])) or e[k] == 0), None)
            if split is not None:
                waiting.append((q[: split + 1], e[:split], shifted))
                q, e = q[split + 1 :], e[split + 1 :]
                continue
            plain = qd_step(q, e, 0.0)
            q, e, ds = plain
            if min(ds) <= 0:
                continue
            bound = 1 / sum(1 / d for d in ds)
            # of the transformed matrix: the same eigenvalues, so the same bound
            for share in (1 - 1e-12, 0.9, 0.5, 0.1):
                if shifted + bound * share > shifted and (got := qd_step(q, e, bound * share)):
                    q, e, _ = got
                    shifted += bound * share
                    break
    return np.sqrt(np.sort(np.array(out))[::-1])


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of B'B at ``value`` (a singular value's square): stationary qd from the top, progressive qd from the bottom, twisted where they nearly
    meet."""
    n, q, e, ab = len(a), a * a, b * b, a[:-1] * b
    tiny = np.finfo(float).tiny / EPS
    safe = lambda x: x if x else tiny
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        down[i] = safe(s[i] + q[i])
        s[i + 1] = e[i] * (s[i] / down[i]) - value
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        up[i] = safe(e[i] + p[i + 1])
        p[i] = q[i] * (p[i + 1] / up[i]) - value
    r = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -ab[i] / down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -ab[i] / up[i] * z[i]
    return z / np.linalg.norm(z)


def decompose(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of ``r`` (``most`` at most, none that is zero but for rounding) and their right singular vectors, as columns. Values that lie close share a
    space: their vectors are made orthogonal, and one that is lost by that comes from inverse iteration inside what is left."""
    scale = float(np.abs(r).max()) if r.size else 0.0
    if not scale:
        return np.empty(0), np.empty((r.shape[1], 0))
    a, b, rights = bidiagonal(r / scale)
    values = singular_values(a, b)
    values = values[values > 16 * len(a) * EPS * values[0]][:most]
    rng, vectors = np.random.default_rng(3), []
    full = np.diag(a) + np.diag(b, 1)
    for k, v in enumerate(values):
        near = [vectors[j] for j in range(k) if values[j] - v <= 1e-3 * values[j]]
        z = twisted(a, b, v * v)
        for _ in range(2):
            for y in near:
                z = z - (y @ z) * y
        if near and np.linalg.norm(z) < 0.5:
            z = rng.normal(size=len(a))
            m = full.T @ full - v * v * (1 + 4 * EPS) * np.eye(len(a))
            for _ in range(4):
                for y in near * 2:
                    z = z - (y @ z) * y
                z = np.linalg.lstsq(m, z, rcond=EPS / 16)[0] if np.linalg.matrix_rank(m) < len(a) else np.linalg.solve(m, z)
                z /= np.linalg.norm(z)
            for y in near * 2:
                z = z - (y @ z) * y
        vectors.append(z / np.linalg.norm(z))
    out = np.array(vectors).T
    for k in range(len(rights) - 1, -1, -1):
        w = rights[k]
        out[k + 1 :] -= 2 * np.outer(w, w @ out[k + 1 :])
    return values * scale, out


# ---- over the rows


class Whitening(NamedTuple):
    """``whole`` + ``rest`` / ``n`` is the mean of the fit list, exactly. ``project`` maps a centred vector to its whitened components."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    project: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def quantized(vectors: DataFrame, vec_col: str = "embedding") -> tuple[DataFrame, Column]:
    """The rows whose vector is not null and has finite entries only, and their grid vector: floor(64 c) + 1000000 of each entry c."""
    good = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(good), F.transform(vec_col, lambda c: F.floor(F.lit(64.0) * c.cast("double")) + F.lit(BASE))


def reduced(rows: DataFrame, d: int, model: Whitening) -> np.ndarray:
    """The triangle of all centred rows, by a tree of QR steps. A task holds a block of rows and one triangle, later steps as many triangles as take 64 MB, two at least."""

    def fold(blocks) -> np.ndarray:
        r = np.zeros((0, d))
        for x in blocks:
            r = np.linalg.qr(np.vstack((r, x)), mode="r")
        return np.vstack((r, np.zeros((d - len(r), d))))

    def first(batches):
        filled = (b for b in batches if b.num_rows)
        for b in filled:  # one round: the rest is folded with the first
            r = fold(model.centred(matrix(x.column(1), d)) for x in chain([b], filled))
            yield pa.RecordBatch.from_arrays([b.column(0)[:1], pa.array([r.ravel()], pa.list_(pa.float64()))], ["node", "r"])

    def later(key, group):
        import pandas as pd

        return pd.DataFrame({"node": [key[0]], "r": [fold(np.asarray(x).reshape(d, d) for x in group.sort_values("node")["r"]).ravel()]})

    fan = max(2, min(32, (64 << 20) // (8 * d * d)))
    level = cut(rows.select(F.spark_partition_id().cast("long").alias("node"), "x").mapInArrow(first, "node long, r array<double>"), "triangles")
    while level.limit(2).count() > 1:
        level = cut(level.groupBy(F.floor(F.col("node") / fan).alias("parent")).applyInPandas(later, "node long, r array<double>"), "triangles")
    return np.array(level.first()["r"]).reshape(d, d)


def sums(rows: DataFrame, d: int, width: int, make) -> np.ndarray:
    """The total of ``make(matrix)``, ``width`` numbers, over all rows; one row a task is added up."""

    def run(batches):
        total = 0
        for b in batches:
            if b.num_rows:
                total = total + make(matrix(b.column(0), d))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64() if total.dtype.kind == "i" else pa.float64()))], ["part"])

    kind = "long" if make(np.zeros((1, d), np.int64)).dtype.kind == "i" else "double"
    parts = rows.mapInArrow(run, f"part array<{kind}>").select(F.posexplode("part").alias("at", "v"))
    got = {r["at"]: r["v"] for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect()}
    return np.array([got[k] for k in range(width)])


def fit(vectors: DataFrame, components: int = 16, vec_col: str = "embedding") -> tuple[Whitening | None, int]:
    """The whitening of the distinct grid vectors, and their dimension: that of most remaining rows, the larger one of ties. None without a row. Mean and counts are exact.
    The distinct vectors are written once; equal ones are dropped where they are read before they move."""
    small_batches(vectors.sparkSession)
    rows, x = quantized(vectors, vec_col)
    size = rows.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None or not size["d"]:
        return None, 0
    d = size["d"]
    distinct = cut(rows.where(F.size(vec_col) == d).select(x.alias("x")).distinct(), "distinct-vectors")
    halves = sums(distinct, d, 2 * d + 1, lambda m: np.concatenate(((m >> 32).sum(axis=0), (m & 0xFFFFFFFF).sum(axis=0), [len(m)])).astype(np.int64))
    n = int(halves[-1])
    mean = [divmod((int(h) << 32) + int(lo), n) for h, lo in zip(halves[:d], halves[d : 2 * d], strict=True)]
    model = Whitening(n, np.array([w for w, _ in mean], np.int64), np.array([r for _, r in mean], np.int64), np.empty((d, 0)), np.empty(0), 0.0, 0.0)
    r = reduced(distinct, d, model)
    values, v = decompose(r, components)
    k = len(values)
    model = model._replace(project=v * (math.sqrt(n) / values), eigenvalues=values**2 / n, trace=float((r * r).sum() / n))
    if k:

        def moments(m: np.ndarray) -> np.ndarray:
            y = model.centred(m) @ model.project
            return np.concatenate((y.sum(axis=0), (y.T @ y).ravel()))

        got = sums(distinct, d, k + k * k, moments) / n
        cov = got[k:].reshape(k, k) - np.outer(got[:k], got[:k])
        model = model._replace(identity_error=float(np.abs(cov - np.eye(k)).max()))
    return model, d


def deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """sum over dimensions of (n x - S)^2, exactly; null where that is no 64-bit integer."""
    u = model.n * (x - model.whole) - model.rest  # wraps around only where the result is null
    about = ((model.n * (x - model.whole).astype(float) - model.rest) ** 2).sum(axis=1)
    out = (u * u).sum(axis=1)  # exact modulo 2^64
    fits = about < 2.0**63
    for k in np.flatnonzero(np.abs(about - 2.0**63) < 2.0**40):
        fits[k] = sum((model.n * (int(a) - int(w)) - int(r)) ** 2 for a, w, r in zip(x[k], model.whole, model.rest, strict=True)) < 1 << 63
    return pa.array(out, mask=~fits)


def whiten(vectors: DataFrame, model: Whitening | None, d: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per remaining row: id, ``deviation`` (long) and ``whitened`` (array of double, in the order of the components). No shuffle; what is sent to the tasks is the model, of
    d times the number of components."""
    small_batches(vectors.sparkSession)
    rows, x = quantized(vectors, vec_col)
    chosen = rows.where(F.size(vec_col) == d).select(F.col(id_col).alias("id"), x.alias("x"))
    schema = f"id {chosen.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            x = matrix(b.column(1), d)
            y = m.centred(x) @ m.project
            at = pa.array(np.arange(len(x) + 1) * y.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), deviations(x, m), pa.ListArray.from_arrays(at, pa.array(y.ravel()))], ["id", "deviation", "whitened"])

    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per remaining row and component: id, ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null, or has a null or non-finite entry, or another dimension than most, are left out. Repeated rows and repeated or null ids stay; equal vectors count once in the
    fit. Directions without spread have no component, so a single vector, or only equal ones, give no row. A deviation beyond 64 bits is null. An entry whose grid
    value is no 64-bit integer is an error. Other columns are left out.
    """
    model, d = fit(vectors, components, vec_col)
    out = whiten(vectors, model, d, id_col, vec_col)
    shares = (model.eigenvalues / model.trace).tolist() if model is not None and model.trace else []
    explained = F.array(*map(F.lit, shares)) if shares else F.array().cast("array<double>")
    rows = out.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(explained, "at").alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"))
