"""Paths of a small component by walks over its links."""

import numpy as np

from tessera.operators import graph


def test_links_are_looked_at_once_for_a_source(monkeypatch):
    """A street of houses wall to wall: 599 zero-weight links, and every pair's one path goes along them."""
    n, looked, inner = 600, [], graph._links_of

    def links_of(*args):
        found = inner(*args)
        looked.append(len(found[0]))
        return found

    monkeypatch.setattr(graph, "_links_of", links_of)
    u, v = np.r_[0 : n - 1, 1:n], np.r_[1:n, 0 : n - 1]
    found = graph.path_sums(n, u, v, np.zeros(2 * n - 2), np.arange(n), True, True)
    at = np.arange(n)
    assert np.allclose(found["dependency"], 2.0 * at * (n - 1 - at))
    assert (found["hop_max"] == np.maximum(at, n - 1 - at)).all() and not found["dist_sum"].any()
    assert sum(looked) <= 3 * n * len(u)
