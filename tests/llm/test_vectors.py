import math

import numpy as np
import pytest

from tabspark.llm import mining, whiten
from tabspark.llm.vectors import usual_length


def vectors(seed, n, d=12):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in rng.standard_normal(d)], int(rng.integers(0, 4))) for k in range(n)]


def plain_negatives(rows, every, positives, negatives, scale=256, low=80, high=100):
    """Brute force over all pairs; rows are (id, vector, label) that take part."""
    x = [[math.floor(scale * c) for c in v] for _, v, _ in rows]
    out = []
    for a, (anchor, _, label) in enumerate(rows):
        if anchor % every:
            continue
        scores = [sum(p * q for p, q in zip(x[a], y)) for y in x]
        near = sorted((-scores[k], rows[k][0]) for k in range(len(rows)) if k != a and rows[k][2] == label)[:positives]
        for s, positive in near:
            fits = sorted((-scores[k], rows[k][0]) for k in range(len(rows)) if rows[k][2] != label and low * -s <= 100 * scores[k] <= high * -s)
            out += [(anchor, positive, r, i, -s, -t) for r, (t, i) in enumerate(fits[:negatives], 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<double>, label int, row long, anchor string"


def table(rows, data):
    return rows(SCHEMA, *((*r, 7, "x") for r in data))


@pytest.mark.parametrize("block_bytes", [1 << 24, 4000])
def test_negatives_equal_brute_force(rows, block_bytes):
    data = vectors(1, 300)
    data += [(1000 + k, data[5][1], k % 2) for k in range(60)]  # one vector many times: ties
    got = mining.mine(table(rows, data), every=10, block_bytes=block_bytes).collect()
    want = plain_negatives(data, 10, 5, 5)
    assert sorted(map(tuple, got)) == want and len(want) > 100


def test_bounds_hold_every_score():
    x = np.random.default_rng(3).integers(-300, 300, (40, 13))
    summary = mining.summaries(x, mining.LEVELS)
    scores = x @ x.T
    wide = None
    for means, deviations in mining.level_columns(13, mining.LEVELS):
        centre, spread = summary[:, means] @ summary[:, means].T, summary[:, deviations] @ summary[:, deviations].T
        assert (scores <= centre + spread + 1e-6).all() and (scores >= centre - spread - 1e-6).all()
        assert wide is None or spread.mean() <= wide
        wide = spread.mean()
    assert wide < 1e-6  # segments of one entry each


def test_rows_that_take_no_part_and_empty_tables(rows):
    good = vectors(2, 80)
    bad = [(None, good[0][1], 1), (200, None, 1), (201, good[1][1], None), (202, [*good[1][1][:-1], None], 2), (203, [*good[1][1][:-1], float("nan")], 2), (204, [*good[1][1][:-1], float("inf")], 2), (205, [], 1), (206, [1.0], 1)]
    got = mining.mine(table(rows, good + bad), every=10).collect()
    assert sorted(map(tuple, got)) == plain_negatives(good, 10, 5, 5)
    assert mining.mine(table(rows, [])).collect() == []
    assert mining.mine(table(rows, bad[1:5])).collect() == []
    assert mining.mine(table(rows, [(1, [1.0, 2.0], 0)])).collect() == []  # no anchors
    twice = mining.mine(table(rows, [(10, [1.0], 0), (10, [1.0], 0), (3, [0.9], 1)]), every=10).collect()
    assert sorted(map(tuple, twice)) == [(10, 10, 1, 3, 65536, 58880)] * 2
    with pytest.raises(Exception, match="too large"):
        mining.mine(table(rows, [(10, [1e12], 0)]), every=10)


def spectrum(d, values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [
    np.linspace(9, 1, 9), [5, 5, 5, 2, 2, 1], [3, 3 * (1 - 1e-10), 2, 2 * (1 - 1e-13), 1, 0, 0], [4.0], [1, 0, 0, 0], [2.0] * 5,
])
def test_spectrum_slicing_equals_a_full_decomposition(values):
    values = np.array(values, float)
    matrix = spectrum(len(values), values)
    matrix = (matrix + matrix.T) / 2
    found, vectors_ = whiten.leading(matrix, 4)
    n = min(4, len(values))
    assert np.allclose(found, np.sort(values)[::-1][:n], atol=1e-13) and np.allclose(vectors_.T @ vectors_, np.eye(n), atol=1e-11)
    assert np.allclose(matrix @ vectors_, vectors_ * found, atol=1e-12)


def test_pivots_count_eigenvalues_above_a_shift():
    matrix = spectrum(11, np.arange(-5, 6))
    assert [whiten.above(matrix, s) for s in (-6, -4.5, 0.5, 4.5, 6)] == [11, 10, 5, 1, 0]
    assert whiten.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0) == 1  # needs a 2x2 pivot


def test_whitening_equals_numpy(rows):
    data = [(k, v, y) for k, v, y in vectors(5, 200)]
    bad = [(300, None, 1), (301, [*data[0][1][:-1], None], 1), (302, [*data[0][1][:-1], float("-inf")], 1), (303, [], 1)]
    got = whiten.whiten(table(rows, data + bad + [(None, data[3][1], 0), (7, data[7][1], 0)]), components=5).toPandas()
    x = np.array([np.floor(1024 * np.array(v)) + 100000 for v in [r[1] for r in data] + [data[3][1], data[7][1]]])
    n = len(x)
    values, vectors_ = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    assert len(got) == 5 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-10 and got["identity_error"].nunique() == 1
    for c in range(5):
        own = got[got["component"] == c + 1].set_index("vec_id")
        want = (x - x.mean(axis=0)) @ vectors_[:, c] / values[c] ** 0.5
        ours = own.loc[range(1, 7), "whitened"].to_numpy()
        assert np.allclose(ours * np.sign(ours[0] * want[1]), want[1:7], atol=1e-9)
        assert np.allclose(own["explained"], values[c] / values.sum())
    assert len(got[got["vec_id"] == 7]) == 10 and got["vec_id"].isna().sum() == 5
    sums = x.astype(int).sum(axis=0)
    assert set(got[got["vec_id"] == 1]["deviation"]) == {int(((n * x[1].astype(int) - sums) ** 2).sum())}


def test_whitening_without_spread(rows):
    same = [(k, [0.5, -0.25, 3.0], 0) for k in range(5)]
    assert whiten.whiten(table(rows, same)).collect() == []
    assert whiten.whiten(table(rows, [])).collect() == []
    line = [(k, [float(k), 2.0 * k, 1.0], 0) for k in range(6)]  # one direction only
    got = whiten.whiten(table(rows, line)).collect()
    assert len(got) == 6 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-9
    large = whiten.whiten(table(rows, [(1, [1e9], 0), (2, [-1e9], 0)])).collect()
    assert [abs(r.whitened) for r in large] == pytest.approx([1, 1]) and {r.deviation for r in large} == {None}


def test_usual_length(rows):
    assert usual_length(table(rows, [(1, [1.0], 0), (2, [1.0, 2.0], 0), (3, [], 0), (4, None, 0)]), "embedding") == 2
