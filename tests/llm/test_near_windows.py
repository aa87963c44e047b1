"""Passages that are changed at their edges, and passages whose shingles come up again, against all windows of both texts."""

import numpy as np
import pytest

from tidewater.llm import passage_dedup as pd


def best_window(x: np.ndarray, y: np.ndarray, t: int) -> float:
    """The highest Jaccard similarity of t tokens of x and t tokens of y."""
    a = [set(x[i : i + t].tolist()) for i in range(len(x) - t + 1)]
    b = [set(y[j : j + t].tolist()) for j in range(len(y) - t + 1)]
    return max((len(p & q) / len(p | q) for p in a for q in b), default=0.0)


@pytest.mark.parametrize("seed", range(3))
def test_no_window_is_lost(seed):
    r = np.random.default_rng(seed)
    fresh = lambda n: r.integers(0, 2**32, n, dtype=np.uint32)
    few, xs, ys = fresh(3), [], []
    for k in range(300):
        x = fresh(int(r.integers(15, 60)))
        if k % 3 == 0:  # some shingles come up again and again
            x[r.random(len(x)) < 0.15] = r.choice(few)
        y = x.copy()
        for _ in range(int(r.integers(0, 4))):
            i, n, what = int(r.integers(0, len(y))), int(r.integers(1, 6)), r.random()
            y = np.concatenate([y[:i], fresh(n) if what < 0.8 else fresh(0), y[i + n if what > 0.2 else i :]])
        for texts, v in ((xs, x), (ys, y)):
            texts.append(np.concatenate([fresh(int(r.integers(0, 12))), r.choice(few, int(r.integers(0, 2))), v, fresh(int(r.integers(0, 12)))]).astype(np.uint32))
    t, threshold = 20, 0.8
    found = pd.all_stretches(xs, ys, t, threshold)
    more = pd.near_windows(xs, ys, t, threshold, found)
    want = {k for k, (x, y) in enumerate(zip(xs, ys)) if best_window(x, y, t) >= threshold}
    assert want - set(found[0].tolist()), "stretches alone lose some"
    assert not want - set(found[0].tolist()) - set(more[0].tolist())
    for k, a, b, c, d, sim in zip(*(v.tolist() for v in more)):
        x, y = set(xs[k][a:b].tolist()), set(ys[k][c:d].tolist())
        assert b - a == d - c == t and sim == pytest.approx(len(x & y) / len(x | y)) and sim >= threshold


def test_one_changed_word_anywhere(spark):
    """50 words, one of them changed: 41 of 51 shingles are common wherever it stands."""
    r = np.random.default_rng(5)
    fresh = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    rows = []
    for at in range(50):
        passage = fresh(50)
        other = [*passage[:at], "changed", *passage[at + 1 :]]
        rows += [(2 * at, " ".join(fresh(30) + passage + fresh(30))), (2 * at + 1, " ".join(fresh(20) + other + fresh(40)))]
    got = pd.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    linked = {tuple(sorted((x["doc_id"], x["other_id"]))) for x in got}
    # a hash function agrees with probability 0.8, so all four miss one pair in 600
    assert len({(2 * at, 2 * at + 1) for at in range(50)} - linked) <= 1
    assert all(b == a + 1 and a % 2 == 0 for a, b in linked)
