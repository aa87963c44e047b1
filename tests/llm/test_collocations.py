"""Collocations against counting every phrase in plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string, n long, rank long, phrase string, a string"


def brute(rows, min_count, max_words, top, inside_percent=80, scale=2_000_000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        gone = {p[i : i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= inside_percent * c[p[i : i + m]]}
        rank = []
        for p, a in cand.items():
            if p not in gone:
                score, _, left, right = min((scale * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rank.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(rank)[:top])]
    return sorted(out)


def corpus(seed=7):
    r = np.random.default_rng(seed)
    vocab = ["a", "The", "the", "of", "été", "x1", "日本", "state", "New", "york", "ab", "b", "ÀB"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "! ", "; ", "\x0b"]
    texts = ["".join(str(r.choice(vocab)) + str(r.choice(ends)) for _ in range(int(r.integers(1, 250)))) for _ in range(80)]
    rows = [(t, [None, "en", "de", "und"][k % 4]) for k, t in enumerate(texts)]
    return [*rows, (None, "en"), ("", None), ("  . ,", "fr"), ("one word", "fr"), *[("new york city is new york city", "en")] * 40, ("ab ab ab ab", None), ("x" * 300, "en")]


@pytest.mark.parametrize(("cells", "shard", "words"), [(None, 3_000_000, 1_000_000), (1 << 16, 500, 40), (1 << 24, 2000, 7)])
def test_against_counting(spark, monkeypatch, cells, shard, words):
    monkeypatch.setattr(col, "SHARD_BYTES", shard)
    monkeypatch.setattr(col, "SHARD_WORDS", words)
    rows = corpus()
    df = spark.createDataFrame([(1, t, lang, 1, 2, "clash", "clash") for t, lang in rows], SCHEMA).repartition(4)
    for min_count, max_words, top in ((3, 4, 2000), (30, 4, 20), (5, 2, 50), (2, 3, 7)):
        got = [tuple(r) for r in col.collocations(df, min_count, max_words, top, cells=cells).collect()]
        assert sorted(got) == brute(rows, min_count, max_words, top)


def test_shards_cut_inside_a_text():
    """Words of one long text in automata of a few words each: a phrase over a cut counts where it begins."""
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice(["a", "b", "c"], 500))
    import pyarrow as pa

    buf = np.frombuffer(text.encode(), np.uint8)
    low, s, e, piece, _, h = col._words(pa.RecordBatch.from_pydict({"lang": ["en"]}), buf, np.array([0, len(buf)]))
    passes = {k: np.arange(len(h)) <= len(h) - k for k in range(1, 5)}
    total = Counter()
    for a in range(0, len(h), 17):
        phrases, lengths, counts, places = col._shard(low, s, e, piece, h, passes, a, min(len(h), a + 17), 4)
        assert len(phrases) == len(lengths) == len(counts) == len(places)
        for p, c in zip(phrases, counts):
            total[p] += c
    w = text.split()
    assert total == Counter(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))


def test_sketch_bounds_from_above(spark):
    df = spark.createDataFrame([("a b " * 20, "en"), ("a b c", "en")], "text string, lang string")
    counts, sizes = col.phrase_counts(df, 20, 3)
    got = {r["phrase"]: r["a"] for r in counts.collect()}
    assert got == {"a": 21, "b": 21, "a b": 21}
    assert [tuple(r) for r in sizes.collect()] == [("en", 43)]


def test_counts_over_64_bits_are_exact(spark, monkeypatch):
    big = 3 * 10**18
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, words int, a long")
    monkeypatch.setattr(col, "phrase_counts", lambda *a, **k: (counts, spark.createDataFrame([("en", big)], "lang string, n long")))
    got = col.collocations(counts).collect()
    assert [(r["score"], r["a"]) for r in got] == [(2_000_000 * (big - 1) // (2 * big), big - 1)]


def test_empty_table(spark):
    assert col.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
