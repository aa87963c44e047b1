"""Links of windows are taken as sorted rows, shingles of large groups are counted by cell, and pairs are sorted once for all that is asked of them."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import passage_dedup as pd

PAIR = "key long, h int, dx long, lx int, cx int, rx int, mx int, dy long, ly int, cy int, ry int, my int"


def test_windows_that_begin_alike_are_all_kept(spark):
    """By their begins only, one of two windows at a text's begin was dropped, whichever came second."""
    rows = [(k, 0, 1, 0, 10, r, 0, 2, 0, 10, r, 0) for k, r in ((1, 60), (2, 90), (3, 60))]
    got = pd.links(spark.createDataFrame(rows, PAIR), 1).collect()
    assert sorted((r.lx, r.rx, r.ly, r.ry) for r in got) == [(0, 60, 0, 60), (0, 90, 0, 90)]


def test_links_are_streamed_by_pair(spark):
    """No group of links is held whole: 80,000 pairs in one task, each with two windows that overlap and one apart."""
    n = 80_000
    links = spark.range(2 * n).select(
        (F.col("id") / 2).cast("long").alias("dx"), F.lit(-1).cast("long").alias("dy"), F.lit(0).alias("h"), F.lit(1).alias("need"),
        *[(F.pmod("id", F.lit(2)) * 20 + k).cast("int").alias(c) for c, k in (("lx", 5), ("rx", 60), ("ly", 7), ("ry", 62))],
    )
    far = links.where("pmod(dx, 2) = 0 and lx = 5").withColumns({c: (F.col(c) + 500).cast("int") for c in ("lx", "rx", "ly", "ry")})
    equal = spark.range(1).select(*[F.lit(v).cast(t).alias(c) for c, v, t in (("dx", -7, "long"), ("dy", 3, "long"), ("h", 0, "int"), ("need", 0, "int"), ("lx", 1, "int"), ("rx", 50, "int"), ("ly", 2, "int"), ("ry", 51, "int"))])
    found = pd.join_intervals(links.unionByName(far).unionByName(equal), 1)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().toString()
    got = found.groupBy("sx", "ex", "sy", "ey", "sure").agg(F.count("*").alias("n"), F.countDistinct("dx").alias("pairs")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 51, 2, 52, True, 1, 1), (5, 81, 7, 83, False, n, n), (505, 561, 507, 563, False, n // 2, n // 2)]


def test_rare_keys_against_brute_force(spark):
    rng = np.random.default_rng(5)
    least, same, cells = 4, 3, 3
    rows = sorted({(int(g), w): int(s) for w in range(40) for g, s in zip(rng.choice(60, 12, False), rng.integers(0, 4, 12))}.items())
    columns = {"gram": np.array([g for (g, _), _ in rows], np.uint64), "w": np.array([w for (_, w), _ in rows], np.uint64), "side": np.array([s for _, s in rows], np.uint8)}
    k, b = pd.by_cell(columns, pd.GRAM, columns["gram"], cells)
    got = pd.rare_keys(pd.shared_grams(spark.createDataFrame(list(zip(k, map(bytearray, b))), "cell int, blob binary"), cells), same, least, cells).collect()
    count = Counter(g for (g, _), _ in rows)
    want = []
    for w in range(40):
        mine = sorted((count[g], g, s) for (g, v), s in rows if v == w and count[g] > 1)
        for bit in (1, 2):
            on = [g for _, g, s in mine if s & bit]
            if len(mine) >= least:
                want += [(w, int(pd.mix(np.array([g + bit], np.uint64)).view(np.int64)[0])) for g in on[: max(0, len(on) - (same - 1))]]
    assert sorted((r.w, r._key) for r in got) == sorted(want) and want


def test_pairs_are_sorted_alike_with_and_without_room_for_places():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 40_000, 70_000).astype(np.uint32)
    x, y = [a, *[rng.integers(0, 9, 6).astype(np.uint32) for _ in range(40_000)]], [np.roll(a, 5), *[rng.integers(0, 9, 5).astype(np.uint32) for _ in range(40_000)]]
    assert len(x).bit_length() + 33 + len(a).bit_length() > 64
    whole, parts = pd.meeting(x, y), [pd.meeting(x[:1], y[:1]), pd.meeting(x[1:], y[1:])]
    for last in (False, True):
        got = pd._hits(whole, np.ones(len(x), bool), last)
        one, rest = (pd._hits(p, np.ones(p.m, bool), last) for p in parts)
        for j in range(3):
            assert np.array_equal(got[j], np.concatenate([one[j], rest[j] + (j == 0)]))
    # against places looked up one at a time
    pair, at, place = pd._hits(parts[1], np.ones(40_000, bool))
    want = [(k, i, y[k + 1].tolist().index(v)) for k in range(2_000) for i, v in enumerate(x[k + 1].tolist()) if v in y[k + 1].tolist()]
    assert list(zip(pair.tolist(), at.tolist(), place.tolist()))[: len(want)] == want
    assert np.array_equal(whole.twice[1:], parts[1].twice)


def test_searches_share_one_sort():
    x = [np.arange(100, dtype=np.uint32), np.arange(50, dtype=np.uint32) % 7]
    y = [np.arange(3, 103, dtype=np.uint32), np.arange(50, dtype=np.uint32) % 7]
    got = pd.passages(x, y, 46, 0.8)
    found = pd.all_stretches(x, y, 46, 0.8)
    more = pd.near_windows(x, y, 46, 0.8, found)
    assert all(np.array_equal(g, np.concatenate(v)) for g, v in zip(got, zip(found, more)))
    assert set(got[0].tolist()) == {0, 1}
