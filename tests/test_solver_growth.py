"""The solver passes a frame of many components once."""

import numpy as np

from weftline.functions import solver


def test_work_grows_with_pairs_and_not_with_components_times_pairs(monkeypatch):
    """Stars, which are most components, need no cost matrix."""
    rng = np.random.default_rng(1)
    a = np.repeat(np.arange(3000), 3)
    b = np.arange(9000)
    d = rng.integers(0, 5, b.size).astype(float)
    seen = []
    own = solver.assign
    monkeypatch.setattr(solver, "assign", lambda cost: seen.append(cost.shape) or own(cost))
    take = solver.match_pairs(a, b, d, 8.0)
    assert not seen
    best = [d[a == k].min() for k in range(3000)]
    assert take.sum() == 3000 and np.allclose(d[take][np.argsort(a[take])], best)


def test_given_components_give_the_same_pairs():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 14))
        keys = np.unique(rng.integers(0, 6, (n, 2)), axis=0)
        a, b, d = keys[:, 0], keys[:, 1], rng.integers(0, 4, len(keys)).astype(float)
        plain = solver.match_pairs(a, b, d, 8.0)
        # two copies under the same ids, apart by their numbers only
        group = solver.components(a, b)
        twice = solver.match_pairs(np.r_[a, a], np.r_[b, b], np.r_[d, d], 8.0, np.r_[group, group + group.max() + 1])
        assert (twice == np.r_[plain, plain]).all()
