"""Stretches of many pairs at once against one pair at a time."""

import numpy as np
import pytest

from tidewater.llm import passage_dedup as pd


def matching_stretches(x: np.ndarray, y: np.ndarray, t: int, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """Stretches of x whose tokens also stand in y, short gaps closed, with their Jaccard similarity."""
    order = np.argsort(y, kind="stable")
    k = np.minimum(np.searchsorted(y[order], x), len(y) - 1)
    place = np.where(y[order][k] == x, order[k], -1)
    hit = np.flatnonzero(place >= 0)
    out = []
    if len(hit) < 2:
        return out
    parts = [(hit, pd.GAP)]
    while parts:
        part, gap = parts.pop()
        for one in np.split(part, np.flatnonzero((np.diff(part) > gap) | (np.abs(np.diff(place[part])) > 4 * gap)) + 1):
            a, b = one[0], one[-1] + 1
            c, d = place[one].min(), place[one].max() + 1
            if max(b - a, d - c) < t:
                continue
            sx, sy = np.unique(x[a:b]), np.unique(y[c:d])
            both = len(np.intersect1d(sx, sy, assume_unique=True))
            sim = both / (len(sx) + len(sy) - both)
            if sim >= threshold:
                out.append((int(a), int(b), int(c), int(d), sim))
            elif gap > 1:  # a stretch that is too loose as a whole may hold tighter ones
                parts.append((one, gap // 2))
    return out


def edited(r, base, edits):
    out = base.copy()
    for _ in range(edits):
        k, what = int(r.integers(0, len(out))), r.random()
        if what < 0.4:
            out[k] = r.integers(0, 2**32, dtype=np.uint32)
        elif what < 0.7:
            out = np.delete(out, slice(k, k + int(r.integers(1, 6))))
        else:
            out = np.insert(out, k, r.integers(0, 2**32, int(r.integers(1, 20)), dtype=np.uint32))
        if not len(out):
            break
    return out


@pytest.mark.parametrize("seed", range(6))
def test_all_stretches_equal_one_at_a_time(seed):
    r = np.random.default_rng(seed)
    few = r.integers(0, 2**32, 8, dtype=np.uint32)  # some shingles come up again and again
    xs, ys = [], []
    for _ in range(120):
        base = r.integers(0, 2**32, int(r.integers(1, 160)), dtype=np.uint32)
        base[r.random(len(base)) < 0.1] = r.choice(few)
        y = edited(r, base, int(r.integers(0, 12))) if r.random() < 0.8 else r.integers(0, 2**32, 60, dtype=np.uint32)
        if r.random() < 0.2:  # moved
            cut = int(r.integers(0, len(y) + 1))
            y = np.concatenate([y[cut:], y[:cut]])
        xs.append(base)
        ys.append(y)
    xs += [np.zeros(0, np.uint32), xs[0], np.full(80, 7, np.uint32)]
    ys += [xs[0], np.zeros(0, np.uint32), np.full(90, 7, np.uint32)]
    for t, threshold in ((46, 0.8), (20, 0.5), (5, 0.9)):
        got = sorted(zip(*(v.tolist() for v in pd.all_stretches(xs, ys, t, threshold))))
        least = int(np.ceil(t * threshold / (1 + threshold)))
        want = []
        for k, (x, y) in enumerate(zip(xs, ys)):
            if len(x) and len(y) and len(np.intersect1d(x, y)) >= least:
                want += [(k, *one) for one in matching_stretches(x, y, t, threshold)]
        assert got == pytest.approx(sorted(want)) if not want else [g[:5] for g in got] == [w[:5] for w in sorted(want)]
        assert np.allclose([g[5] for g in got], [w[5] for w in sorted(want)])


def test_no_pairs():
    assert all(len(v) == 0 for v in pd.all_stretches([], [], 46, 0.8))
