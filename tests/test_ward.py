"""Ward clusters without a table of all pairs."""

import numpy as np
import pytest

from orrery.operators import geometry


def lance_williams(x, k):
    """All distances, updated after each merge; the first of the least ones is merged."""
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    size, owner, live = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - min(k, n)):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        others = live.copy()
        others[[i, j]] = False
        s = size[others]
        d[i, others] = ((size[i] + s) * d[i, others] + (size[j] + s) * d[j, others] - s * d[i, j]) / (size[i] + size[j] + s)
        d[others, i] = d[i, others]
        d[j, :] = d[:, j] = np.inf
        live[j] = False
        size[i] += size[j]
        owner[owner == j] = i
    return np.unique(owner, return_inverse=True)[1]


@pytest.mark.parametrize("n, k, copies", [(1, 3, 1), (3, 3, 1), (40, 1, 1), (300, 3, 1), (300, 7, 1), (90, 3, 3)])
def test_ward_agrees_with_updated_distances(n, k, copies):
    x = np.random.default_rng(n + k).normal(size=(n, 3))
    x = np.concatenate([x] * copies)
    assert geometry.ward_labels(x, k).tolist() == lance_williams(x, k).tolist()


def test_ward_needs_no_table_of_all_pairs():
    import time
    import tracemalloc

    x = np.random.default_rng(0).normal(size=(3000, 3))
    tracemalloc.start()
    start = time.time()
    geometry.ward_labels(x, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6 and time.time() - start < 30
