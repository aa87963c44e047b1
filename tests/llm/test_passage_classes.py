"""Classes of passages against brute force: none is split, none has more rows than passages, in tasks, by rare shingles and in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import passage_classes as pc
from tidewater.llm import passage_dedup as pd
from tidewater.llm import queries


def root(top, x):
    while top.get(x, x) != x:
        x = top[x]
    return x


def families(seed=11):
    """(rows, pairs of documents that are near): copies of passages with one or two changed or added words, one line in unlike surroundings."""
    r = np.random.default_rng(seed)
    fresh = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    line, rows, group = fresh(13), [], {}
    for k in range(4):
        base = fresh(80)
        for j in range(60 if k == 0 else 12):
            w = list(base)
            for at in r.choice(80, r.integers(1, 3), replace=False) if j else ():
                w[at : at + int(r.integers(0, 2))] = [f"z{r.integers(10**9)}"]
            group[len(rows)] = k
            rows.append((len(rows), " ".join(w)))
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    near = {(a, b) for a in group for b in group if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    rows += [(1000 + k, " ".join(fresh(40) + line + fresh(40))) for k in range(60)]
    return rows, near, group


@pytest.mark.parametrize("parts,most", [(1, 20_000), (5, 20_000), (3, 10)])
def test_near_documents_are_in_one_class(spark, parts, most):
    rows, near, group = families()
    got = pc.passage_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), most=most).collect()
    of = {}
    for x in got:
        of.setdefault(x.doc_id, set()).add(x.class_id)
    assert all(of[a] & of[b] for a, b in near)
    assert not [d for d in of if d >= 1000]  # a line alone is no passage
    for k in {x.class_id for x in got}:
        assert len({group[x.doc_id] for x in got if x.class_id == k}) == 1
    names = {(x.doc_id, x.first_word, x.last_word) for x in got}
    assert len(names) == len(got) and {(x.other_id, x.other_first, x.other_last) for x in got} <= names


def test_rows_follow_the_passages(spark):
    """60 edited copies: a row for each passage, where pairs have many more."""
    rows, _, group = families()
    docs = spark.createDataFrame([x for x in rows if group.get(x[0]) == 0], "doc_id long, text string")
    assert len(queries.passage_classes.passage_classes(docs).collect()) <= 2 * 60


def test_links_connect_what_all_pairs_connect():
    """Windows of groups with substitutions, insertions and repeats: the same classes as all pairs, with fewer links than windows."""
    r = np.random.default_rng(3)
    fresh = lambda n: r.integers(0, 2**32, n, dtype=np.uint32)
    t, few = 20, fresh(4)
    group, dk, c, grams = [], [], [], []
    for k in range(12):
        base = fresh(2 * t - 1)
        if k % 3 == 0:
            base[r.random(len(base)) < 0.2] = r.choice(few)
        base[t - 1] = 7 + k
        for j in range(30 if k < 2 else 6):
            v = list(base)
            for _ in range(int(r.integers(0, 4))):
                i = int(r.integers(0, len(v)))
                v[i : i + int(r.integers(0, 4))] = fresh(int(r.integers(0, 3))).tolist()
            if 7 + k not in v:
                continue
            at = v.index(7 + k)
            lo, hi = max(0, at - t + 1 + int(r.integers(0, 4))), min(len(v), at + t)
            if hi - lo >= t and lo <= at:
                group.append(k), dk.append(len(dk)), c.append(at - lo), grams.append(np.array(v[lo:hi], np.uint32))
    n = np.array([len(v) for v in grams])
    group, dk, c = map(np.array, (group, dk, c))
    x, y, a, b, e, f = pc.near_links(group, dk, c, np.concatenate(grams), n, t, 0.8)
    top, want = {}, {}
    around = (a <= c[x]) & (c[x] < b) & (e <= c[y]) & (c[y] < f)
    for i, j in zip(x[around].tolist(), y[around].tolist()):
        top[root(top, i)] = root(top, j)
    i, j = (np.array(v) for v in zip(*[(i, j) for i in range(len(n)) for j in range(i) if group[i] == group[j]]))
    k, a1, b1, e1, f1, _ = pd.passages([grams[v] for v in i], [grams[v] for v in j], t, 0.8)
    # passages of t tokens on both sides that hold the token
    true = (b1 - a1 >= t) & (f1 - e1 >= t) & (a1 <= c[i[k]]) & (c[i[k]] < b1) & (e1 <= c[j[k]]) & (c[j[k]] < f1)
    assert true.sum() > 100
    for p, q in zip(i[k[true]].tolist(), j[k[true]].tolist()):
        assert root(top, p) == root(top, q)
    assert around.sum() < len(n)


def test_each_place_of_a_repeat_and_no_repeat_inside_one_document(spark):
    r = np.random.default_rng(4)
    fresh = lambda n: " ".join(f"w{x}" for x in r.integers(0, 10**9, n))
    p, q = fresh(70), fresh(70)
    rows = [(1, f"{fresh(30)} {p} {fresh(30)} {p} {fresh(30)}"), (2, f"{fresh(10)} {p} {fresh(9)}"), (3, f"{q} {fresh(20)} {q}"), (4, None), (5, "")]
    got = pc.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # a near window may reach over the edge of a passage by what the threshold allows
    want = [(1, 30, 99), (1, 130, 199), (2, 10, 79)]
    assert len(got) == len(want)
    for x, (d, a, b) in zip(sorted(got, key=lambda x: (x.doc_id, x.first_word)), want):
        assert x.doc_id == d and a - 5 <= x.first_word <= a and b <= x.last_word <= b + 5
    assert len({x.class_id for x in got}) == 1
    assert pc.passage_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
