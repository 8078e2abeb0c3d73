"""What the views of co-training teach each other."""

import numpy as np
import pytest

from palimpsest.llm import quality


def area(z, y):
    good, bad = z[y > 0], np.sort(z[y <= 0])
    return (np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")).mean() / (2 * len(bad))


def two_views(seed, n=6000, noise=40):
    """Views that tell the class independently, each in a few of many columns."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.5).astype(int)
    view = lambda s: np.column_stack([np.ones(n), s * (2 * y - 1) + rng.normal(size=n), s * (2 * y - 1) + rng.normal(size=n), rng.normal(size=(n, noise))])
    return view(2.0), view(1.0), y


@pytest.mark.parametrize("seed", range(4))
def test_a_view_with_few_labels_gains(monkeypatch, seed):
    xt, xm, truth = two_views(seed)
    order = np.random.default_rng(seed).permutation(len(truth))
    told, free, rest = order[:60], order[60:5000], order[5000:]
    held = np.arange(60) % 4 == 0

    def meta(rounds):
        monkeypatch.setattr(quality, "ROUNDS", rounds)
        pool = quality.Held(xt[free], xm[free], np.random.default_rng(9).integers(0, 2**31, len(free)))
        return area(xm[rest] @ quality.fit(xt[told], xm[told], truth[told], held, pool).meta, truth[rest])

    assert meta(4) > meta(0) + 0.005


def test_a_view_without_skill_teaches_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    xt, _, truth = two_views(1)
    xm = np.column_stack([np.ones(len(truth)), rng.normal(size=(len(truth), 40))])
    order = rng.permutation(len(truth))
    told, free, rest = order[:400], order[400:5000], order[5000:]
    text = {}
    for rounds in (0, 4):
        monkeypatch.setattr(quality, "ROUNDS", rounds)
        pool = quality.Held(xt[free], xm[free], rng.integers(0, 2**31, len(free)))
        text[rounds] = area(xt[rest] @ quality.fit(xt[told], xm[told], truth[told], np.arange(400) % 4 == 0, pool).text, truth[rest])
    assert text[4] > text[0] - 0.002


def test_skill():
    y = np.array([0, 1] * 200)
    assert quality.skill(y.astype(float), y) > 0.8 and quality.skill(-y.astype(float), y) == 0
    assert quality.skill(np.zeros(400), y) == 0 and quality.skill(np.arange(3.0), np.ones(3, dtype=int)) == 0
