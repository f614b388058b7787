"""Whitening against a dense eigensolver, exact sums against Python's, and the odd cases."""

import math

import numpy as np
import pytest

from firmaforge.llm import whitening as w

DDL = "vec_id long, embedding array<double>, component string, n string, v int"


def spectrum(d, values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    v = (q * values) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("d", [1, 2, 5, 40, 100])
@pytest.mark.parametrize("kind", ["spread", "equal", "half", "steep", "pairs"])
def test_all_components_of_every_spectrum(d, kind):
    values = {
        "spread": np.linspace(1, 2, d),
        "equal": np.ones(d),
        "half": np.r_[np.ones(d // 2 + 1), np.zeros(d)][:d],
        "steep": 10.0 ** -np.minimum(np.arange(d), 8),
        "pairs": np.repeat(np.arange(1, d + 1), 2)[:d] / 7,
    }[kind]
    v = spectrum(d, values)
    found = [w.feast(v, p) for p in w.intervals(v, 32)]
    got = np.sort(np.concatenate([f[0] for f in found]))[::-1][:32]
    u = np.concatenate([f[1] for f in found], axis=1)
    want = np.sort(values[values > 0])[::-1][:32]
    assert len(got) == len(want) and np.abs(got - want).max() < 1e-12
    assert np.linalg.norm(v @ u - u * np.concatenate([f[0] for f in found]), axis=0).max() < 1e-11


def test_inertia_counts():
    rng = np.random.default_rng(4)
    for _ in range(50):
        d = int(rng.integers(1, 30))
        a = rng.standard_normal((d, d))
        a += a.T
        shift = float(rng.standard_normal())
        assert w.inertia_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    assert w.inertia_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert w.inertia_above(np.zeros((3, 3)), 0.0) == 0


def test_a_wrong_count_is_an_error():
    v = spectrum(10, np.arange(1, 11.0))
    with pytest.raises(ArithmeticError):
        w.feast(v, w.Interval(4.5, 7.5, 4))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((300, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.0]) + 0.25
    out = [(i, r.tolist()) for i, r in enumerate(base)] + [(7, base[7].tolist()), (None, base[8].tolist())]
    out += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 6), (903, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (904, [])]
    out += [(905, [1e300] + [0.0] * 5), (906, [1.0, 2.0]), (907, [-math.inf] * 6)]
    return [(i, v, "c", "n", 3) for i, v in out]


def test_like_a_dense_solver(spark, rows):
    got = w.whiten(spark.createDataFrame(rows, DDL).repartition(5)).collect()
    used = [(i, v) for i, v, *_ in rows if v and len(v) == 6 and all(e is not None and abs(e) < 1e299 for e in v)]
    x = [[math.floor(64 * e) + 1_000_000 for e in v] for _, v in used]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    c = np.array(x) - np.array(sums) / n
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values > 1e-9).sum())
    assert k == 5 and len(got) == k * n
    deviation = sorted((str(i), sum((n * e - s) ** 2 for e, s in zip(r, sums, strict=True))) for (i, _), r in zip(used, x, strict=True))
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == deviation
    assert {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    by_id = {r: (np.array(x[j]) - np.array(sums) / n) for j, (r, _) in enumerate(used)}
    for j in range(k):
        own = [r for r in got if r.component == j + 1]
        assert {round(r.explained, 12) for r in own} == {round(values[j] / values.sum(), 12)}
        want = np.array([by_id[r.vec_id] @ vectors[:, j] / math.sqrt(values[j]) for r in own])
        have = np.array([r.whitened for r in own])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [2.0]), (2, [2.0])], [(3, []), (4, [])]])
def test_nothing_to_whiten(spark, rows):
    out = w.whiten(spark.createDataFrame([(*r, "c", "n", 1) for r in rows], DDL))
    assert out.collect() == []
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(1 << 40) * (-1) ** i, float(i)], "c", "n", 1) for i in range(4)]
    got = {r.vec_id: r.deviation for r in w.whiten(spark.createDataFrame(rows, DDL)).collect() if r.component == 1}
    assert set(got) == {0, 1, 2, 3} and set(got.values()) == {None}
    rows = [(i, [float(1 << 20) * (-1) ** i, float(i)], "c", "n", 1) for i in range(4)]
    got = {r.vec_id: r.deviation for r in w.whiten(spark.createDataFrame(rows, DDL)).collect() if r.component == 1}
    assert got == {i: (4 * 64 << 20) ** 2 + (4 * 64 * i - 384) ** 2 for i in range(4)}


def test_other_column_names(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.0, 0.0])], "whitened long, vec array<float>")
    with pytest.raises(ValueError):
        w.whiten(df, vec_id="whitened", vector="vec")
    df = df.withColumnRenamed("whitened", "key")
    assert w.whiten(df, vec_id="key", vector="vec").columns[0] == "key"
