"""Whitening against exact integer sums and a dense eigenvalue routine, and the small decomposition on hard matrices."""

import math
from fractions import Fraction

import numpy as np
import pytest

from reelbase.llm import whitening
from reelbase.llm.queries import QUERIES

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def check_against_plain(rows, got, d, most=16):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fits = sorted(set(map(tuple, (x for _, x in kept))))
    n, total = len(fits), [sum(c) for c in zip(*fits)]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, total)] for x in fits])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > values[0] * 1e-12).sum()))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len(got) == len(kept) * k and {r.n for r in got} == {n}
    assert all(0 <= r.identity_error < 1e-9 for r in got) and len({r.identity_error for r in got}) == 1
    scores = {}
    for i, x in kept:
        own = sorted(by[i, sum((n * c - t) ** 2 for c, t in zip(x, total))], key=lambda r: r.component)
        assert {r.component for r in own} == set(range(1, k + 1))
        c = np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, total)])
        scores[i] = (c @ vectors[:, :k] / np.sqrt(values[:k]), [r.whitened for r in own[:k]], [r.explained for r in own[:k]])
    mine, its = (np.array([s[j] for s in scores.values()]) for j in (0, 1))
    sign = np.sign((mine * its).sum(axis=0))
    assert np.abs(mine * sign - its).max() < 1e-6
    assert np.allclose(next(iter(scores.values()))[2], values[:k] / np.trace(cov), rtol=1e-9)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(300, 24)) @ np.diag(np.geomspace(3, 1e-2, 24)) @ rng.normal(size=(24, 24))).astype(np.float32).tolist()
    odd = [None, [], [1.0] * 23, [float("nan")] + [0.0] * 23, [None] + [0.0] * 23, [float("inf")] + [0.0] * 23]
    return list(enumerate(base)) + [(1000 + k, v) for k, v in enumerate(odd)] + [(2000 + k, base[0]) for k in range(200)] + [(None, base[5])]


def test_digest_against_plain(spark, rows):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, component int, n string")
    for parts in (1, 40):  # forty triangles go through the tree
        got = whitening.digest(frame.repartition(parts))
        assert got.columns == COLUMNS
        check_against_plain(rows, got.collect(), 24)


def test_given_table(spark):
    got = QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.01")
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check_against_plain(rows, got.collect(), 64)


def test_no_spread_no_rows_and_empty(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitening.digest(spark.createDataFrame(rows, schema))
        assert got.columns == COLUMNS and got.count() == 0
    got = whitening.digest(spark.createDataFrame([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [1.0, 5.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in got) == [(i, 1, 2, 64**2, 1.0, 1.0) for i in (1, 2, 3)]


def test_deviation_beyond_64_bits_is_null():
    model = whitening.Whitening(3, np.array([0, 0]), np.array([1, 2]), np.zeros((2, 0)), np.empty(0), 0.0, 0.0)
    edge = math.isqrt(1 << 63) // 3
    x = np.array([[5, 6], [edge, 0], [edge + 1, 0], [edge * 2, edge]])
    exact = [sum((3 * int(a) - r) ** 2 for a, r in zip(row, (1, 2))) for row in x]
    assert whitening.deviations(x, model).to_pylist() == [e if e < 1 << 63 else None for e in exact]


def matrices():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    other = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    wilkinson = np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    lost = rng.normal(size=(100, 30))
    lost[:, 7], lost[:, 9], lost[:, 20:] = 0, lost[:, 3], lost[:, :10] @ rng.normal(size=(10, 10))
    yield from (np.triu(rng.normal(size=(d, d))) for d in (1, 2, 3, 5, 64))
    yield from (np.eye(20), np.diag([3.0, 3, 3, 2, 2, 1, 0, 0]), np.triu(np.ones((30, 30))), np.zeros((4, 4)), wilkinson, lost)
    yield from (turn @ np.diag(x) @ other for x in (10.0 ** -np.arange(40), np.r_[np.ones(20), np.full(20, 1e-3)], np.geomspace(1, 1e-6, 40)))


def test_decomposition_of_hard_matrices():
    for m in matrices():
        r = np.linalg.qr(m, mode="r")
        s, v = whitening.decompose(r, 16)
        want = np.linalg.svd(m)[1]
        if not want[0]:
            assert not len(s)
            continue
        assert len(s) == min(16, int((want > 16 * len(want) * whitening.EPS * want[0]).sum()))
        assert np.abs(s - want[: len(s)]).max() <= 1e-13 * want[0] and np.abs(v.T @ v - np.eye(len(s))).max() < 1e-11
        assert np.abs(r.T @ (r @ v) - v * s**2).max() < 1e-13 * want[0] ** 2


def test_small_singular_values_keep_their_digits():
    """The bidiagonal matrix fixes each value to full relative precision, however small: the product of all is that of the diagonal."""
    a, b = np.geomspace(1, 1e-30, 25), np.geomspace(0.5, 1e-28, 24)
    s = whitening.singular_values(a, b)
    assert abs(np.log(s).sum() - np.log(a).sum()) < 1e-12 * abs(np.log(a).sum())
