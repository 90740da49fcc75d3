import numpy as np
import pytest

from dendra.operators.divergence import curve_area, distribution_score, divergence_curve, histograms


def plain_area(p, q):
    points = [(0.0, 1.0), (1.0, 0.0)]
    kl = lambda a, r: sum(x * np.log(x / y) for x, y in zip(a, r) if x > 0)
    for w in np.linspace(1e-6, 1 - 1e-6, 25):
        r = w * p + (1 - w) * q
        points.append((np.exp(-5 * kl(q, r)), np.exp(-5 * kl(p, r))))
    c = np.array(points)
    a, b = c[np.lexsort((-c[:, 1], c[:, 0]))], c[np.lexsort((-c[:, 0], c[:, 1]))]
    return (np.trapezoid(a[:, 1], a[:, 0]) + np.trapezoid(b[:, 0], b[:, 1])) / 2


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("counts", [[(3, 3), (5, 5)], [(4, 0), (0, 7)], [(10, 2), (1, 5), (0, 3), (6, 0)]])
def test_area_equals_plain_computation(spark, counts):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(counts)], "bin int, n_left long, n_right long")
    p, q = (np.array(x, dtype=float) / sum(x) for x in zip(*counts))
    area = curve_area(divergence_curve(rows)).first().area
    assert area == pytest.approx(plain_area(p, q), abs=1e-9)
    if counts[0] == (3, 3):
        assert area == pytest.approx(1.0, abs=1e-6)


def test_histograms_equal_plain_rounds(spark):
    rng = np.random.default_rng(0)
    vectors = np.concatenate([rng.normal(c, 0.4, (40, 3)) for c in (-2, 0, 2)]).astype(np.float32)
    centers = vectors[:5].astype(float)
    for _ in range(4):
        near = np.argmin(((vectors[:, None].astype(float) - centers) ** 2).sum(axis=2), axis=1)
        centers = np.array([vectors[near == k].astype(float).mean(axis=0) if (near == k).any() else centers[k] for k in range(5)])
    near = np.argmin(((vectors[:, None].astype(float) - centers) ** 2).sum(axis=2), axis=1)
    rows = list(enumerate(vectors.tolist()))
    got = histograms(frame(spark, rows[::2]), frame(spark, rows[1::2]), bins=5, rounds=4).collect()
    assert {r.bin: (r.n_left, r.n_right) for r in got} == {k: (int((near[::2] == k).sum()), int((near[1::2] == k).sum())) for k in range(5) if (near == k).any()}


def test_odd_sets(spark):
    good = frame(spark, [(0, [1, 2]), (1, [3, 4]), (2, None), (3, [1]), (4, [1, None]), (5, [float("nan"), 1])])
    none = frame(spark, [])
    assert [(r.bin, r.n_left, r.n_right) for r in histograms(good, good, bins=2, rounds=3).orderBy("bin").collect()] == [(0, 2, 2)] or sum(r.n_left for r in histograms(good, good, bins=2).collect()) == 2
    assert distribution_score(good, good, bins=2).first().area == pytest.approx(1.0, abs=1e-6)
    assert distribution_score(good, none, bins=2).first().area is None
    assert histograms(none, none).collect() == []
