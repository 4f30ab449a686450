"""Whitening against numpy's own eigenvalues and whole-number arithmetic, and its divide-and-conquer on hard matrices."""

import math
import random

import numpy as np
import pytest

from provena.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, x string, deviation string"
SF = "/root/testdata/sf0.001"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "n", "c", "x", "d") for r in rows], SCHEMA.replace("array<float>", f"array<{kind}>"))


def expected(rows, components=4):
    """By brute force: (vec_id, component) -> n, deviation, whitened up to sign, explained."""
    kept = [(k, tuple(math.floor(256 * c) for c in v)) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = []
    for k, x in kept:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        w = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) @ u / np.sqrt(e)
        out += [(k, i + 1, n, dev, w[i], e[i] / np.trace(cov)) for i in range(len(e))]
    return out


def same(found, want):
    found, want = sorted(found, key=lambda r: (r[0], r[1], r[3])), sorted(want, key=lambda r: (r[0], r[1], r[3]))
    assert [r[:4] for r in found] == [r[:4] for r in want]
    for c in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in rows if r[1] == c]) for rows in (found, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
    assert max(abs(a[5] - b[5]) for a, b in zip(found, want, strict=True)) < 1e-9
    assert {r[6] for r in found} == {found[0][6]} and found[0][6] < 1e-9


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same([tuple(r) for r in queries.op13_embedding_whitening(spark, SF).collect()], expected(rows))


def test_nulls_repeats_and_clashing_columns(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1), r.gauss(0, 3), r.gauss(0, 0.5), -0.0, r.gauss(0, 2)]) for i in range(60)]
    rows += [(7, rows[7][1]), (None, rows[3][1])] + [(100 + i, rows[5][1]) for i in range(40)]
    bad = [(201, None), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [float("nan")] * 5), (204, [1.0, float("inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in rows]
    found = [tuple(x) for x in whitening.whitened(table(spark, rows + bad)).collect()]
    assert {x[0] for x in found} == {k for k, _ in rows}
    fill = lambda rs: [(-1 if x[0] is None else x[0], *x[1:]) for x in rs]
    same(fill(found), fill(expected(rows)))


def test_few_dimensions_and_no_variance(spark):
    found = [tuple(x) for x in whitening.whitened(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.5]), (3, [0.5, 0.5])])).collect()]
    assert sorted((x[0], x[1]) for x in found) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert all(x[4] is None for x in found if x[1] == 2) and all(abs(abs(x[4]) - 1) < 1e-12 for x in found if x[1] == 1)
    one = whitening.whitened(table(spark, [(1, [0.5, 0.25])])).collect()
    assert [(x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in one] == [(1, 0, None, None, None)] * 2


def test_huge_entries_stay_exact_or_become_null(spark):
    rows = [(1, [1e9, 1.0]), (2, [-1e9, 2.0]), (3, [5e8, 0.0]), (4, [1e300, 0.0])]
    found = {x.vec_id: x.deviation for x in whitening.whitened(table(spark, rows[:3], "double")).where("component = 1").collect()}
    want = {x[0]: x[3] for x in expected(rows[:3])}
    assert found == {k: v if v < 1 << 63 else None for k, v in want.items()}
    assert whitening.whitened(table(spark, rows, "double")).count() == 8


def test_empty(spark):
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, [(1, None), (2, [])])).collect() == []


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 1, 1, 0.5, 0.5, 0, 0, 0], [1.0] * 10 + [1 + 1e-13] * 10, list(10.0 ** -np.arange(16)), [3.0], [1.0, -1.0], [1e6] + [0.0] * 20, list(np.linspace(0, 1, 64) ** 2), [0.0] * 31 + [1.0, 1.0],
    ],
)
def test_divide_and_conquer(values):
    r = np.random.default_rng(len(values))
    q = np.linalg.qr(r.standard_normal((len(values),) * 2))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    for wanted in (None, 4):
        e, u = whitening.eigen(a, wanted)
        top = max(map(abs, values))
        assert len(e) == min(len(values), wanted or len(values))
        assert np.abs(e - sorted(values, reverse=True)[: len(e)]).max() < 1e-13 * top
        assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13
        assert np.abs(a @ u - u * e).max() < 1e-13 * top


def test_polar_factor_of_an_ill_conditioned_matrix():
    r = np.random.default_rng(2)
    q = np.linalg.qr(r.standard_normal((12, 12)))[0]
    a = q @ np.diag([*(10.0 ** -np.arange(10)), -1e-7, -1.0]) @ q.T
    assert np.abs(whitening.polar((a + a.T) / 2) - q @ np.diag([1.0] * 10 + [-1.0] * 2) @ q.T).max() < 1e-6
