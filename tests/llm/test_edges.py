"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import decontamination, html_extract, mixing, near_dedup, passage_dedup, quality_rules, queries, suffix_dedup, token_files, toxicity, url_filter

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, n_words long, fp long, id long, node long"


def words(n, seed):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), 6)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    a, long = words(120, 1), words(30_000, 2)
    rows = [
        (1, a, "s"), (1, a, "s"), (2, a, "t"), (3, None, "s"), (4, "", None), (None, a + " tail", None), (None, None, None),
        (5, "one two", "s"), (6, "   \n\t ", "t"), (7, long, "s"), (8, long, "s"), (9, words(80, 3), "t"), (9, words(80, 4), "t"), (10, "word " * 400, "u"),
    ]
    return spark.createDataFrame([(i, t, s, "en", 0, 7, 1, 2, 3) for i, t, s in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def n(df):
    return len(df.collect())


def test_mixing(odd, empty):
    got = mixing.mix_sources(odd, queries.MIX_SCHEDULES).collect()
    assert len(got) == 14
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in got) == sorted(count(r["text"]) for r in odd.collect())
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in mine) == round(mine[0]["target"])
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - sum(r["size"] for r in got)) < 1e-6
    assert n(mixing.mix_sources(empty, queries.MIX_SCHEDULES)) == 0
    taken = mixing.take_mix(odd.where("doc_id in (7, 9, 10)").dropDuplicates(["doc_id"]), queries.MIX_SCHEDULES)
    assert taken.columns == odd.columns and n(taken) > 0


def test_mixing_inverts_schedules(spark):
    s = ((0, 1.5), (0.5, 3), (1, 4.5))
    df = spark.range(101).select((F.col("id") / 100).alias("u"))
    got = df.select("u", mixing.inverse(s, F.col("u")).alias("x")).collect()
    grid = np.linspace(0, 1, 20001)
    w = np.interp(grid, [0, 0.5, 1], [1.5, 3, 4.5])
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))])
    for r in got:
        assert abs(np.interp(r["x"], grid, area) - r["u"] * area[-1]) < 1e-4


def test_near_duplicates(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == 14
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by[1] == by[2] == {1} and 1 in by[None]
    assert by[7] == by[8] == {7} and by[5] == {5} and by[6] == {6}
    assert by[3] == by[4] == {3}  # a null text is an empty text
    assert by[9] == {9}
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 9, 9, 10]
    assert n(near_dedup.near_duplicates(empty)) == 0


def test_large_groups_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = words(300, 9).split()
    rows = [(1000, " ".join(base))]
    for k in range(60):
        w = list(base)
        for j in rng.choice(np.arange(0, 300, 10), 6, replace=False):
            w[j] = f"z{rng.integers(10**6)}"
        rows.append((k, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and sum(r["keep"] for r in got) == 1


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.uniform(0, 3, 400), rng.uniform(0, 3, 400)
    k = 4096
    sig = near_dedup.dart_signatures(np.repeat([0, 1], 400), np.concatenate([h, h]), np.concatenate([a, b]), 2, k)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_passages(odd, empty):
    got = passage_dedup.near_passages(odd).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in got}
    linked = {x for p in pairs for x in p}
    assert {1, 2, None, 7, 8} <= linked and not {3, 4, 5, 6} & linked
    assert n(passage_dedup.near_passages(empty)) == 0


def test_pages(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "plain text only"), (3, "u", "<p><b>x<div><!-- open"), (4, "u", "<article><h1>T&amp;t</h1><p>Hello  there\n you&nbsp;all. It is a fine day and we go on.</p></article><footer>&copy; me</footer>"), (5, "u", "<p a=\"" * 2000), (6, "u", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract_main_text(df).collect()
    assert len(got) == 7 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert next(r for r in got if r["page_id"] == 4)["text"] == "T&t\nHello there you all. It is a fine day and we go on."
    assert all(r["text"] == "" for r in got if r["page_id"] == 1)
    assert n(html_extract.extract_main_text(df.limit(0))) == 0


def test_labeller_on_held_out_pages():
    net = html_extract.trained_labeller()
    right = total = 0
    for x, y in html_extract.written_pages(150, 99):
        z = net.logits(x[:, None, :], np.ones((len(x), 1), bool))[:, 0] > 0
        right, total = right + int((z == y).sum()), total + len(y)
    assert right / total > 0.98


def test_labeller_gradients():
    net, rng = html_extract.Labeller(3), np.random.default_rng(0)
    x = rng.standard_normal((5, 2, html_extract.DIMS)).astype(np.float32)
    mask = np.array([[1, 1], [1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = rng.random((5, 2)) < 0.5
    _, grad = net.gradients(x, mask, y)
    for k, at in (("ub", (3, 7)), ("wf", (10, 50)), ("o", (5,)), ("cb", (30,))):
        old = net.p[k][at]
        loss = []
        for d in (1e-2, -1e-2):
            net.p[k][at] = old + d
            loss.append(net.gradients(x, mask, y)[0])
        net.p[k][at] = old
        assert abs((loss[0] - loss[1]) / 2e-2 - grad[k][at]) < 2e-3


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (77, 0), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd, labels)
    scored = toxicity.score_toxicity(odd, model)
    assert n(scored) == 14 and scored.columns[: len(odd.columns)] == odd.columns
    none = toxicity.fit_toxicity(odd, labels.limit(0))
    assert not any(r["toxic"] for r in toxicity.score_toxicity(odd, none).collect())
    assert n(toxicity.score_toxicity(empty, model)) == 0


def test_ordinal_regression_recovers_grades():
    rng = np.random.default_rng(1)
    x = (rng.random((3000, 12)) < 0.3).astype(np.float32)
    w = np.array([2.0, -1.5, 1.0] + [0.0] * 9)
    z = x @ w + rng.logistic(size=3000)
    y = np.digitize(z, [0.5, 2.0])
    got, theta = toxicity.fit_ordinal(x, y, 3)
    assert np.abs(got - w).max() < 0.4 and theta[0] < theta[1]
    assert abs(theta[0] - 0.5) < 0.3 and abs(theta[1] - 2.0) < 0.4


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        w = [f"w{rng.integers(3000)}" for _ in range(60)] + (["Vile!!", "awful,"] if bad else [])
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
        if k < 400:
            labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs.where("doc_id >= 400"), model).collect()
    assert all(r["toxic"] == (r["doc_id"] % 4 == 0) for r in got)


def test_urls(spark):
    rows = [(1, None), (1, "no scheme"), (None, "http://A.example.COM/en/9?x#y"), (3, "http://x.net?de/"), (4, "https://example.com/en/77"), (5, "://"), (6, "http://q.org/es/1"), (6, "http://q.org/es/1")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = url_filter.filter_urls(df, queries.URL_RULES).collect()
    assert len(got) == 8
    by = {(r["page_id"], r["host"], r["path"]): (r["rule"], r["verdict"]) for r in got}
    assert by[None, "a.example.com", "/en/9"] == ("com/en/", "block")
    assert by[4, "example.com", "/en/77"] == ("example.com/en/7", "allow")
    assert by[3, "x.net", ""][0] is None and by[1, "", ""][0] is None and by[5, "", ""][0] is None
    assert by[6, "q.org", "/es/1"] == ("org/es/", "block")
    assert n(url_filter.filter_urls(df.limit(0), queries.URL_RULES)) == 0


def test_suffixes_tell_registered_domains(spark):
    hosts = ["a.shop.co.uk", "shop.co.uk", "co.uk", "b.example.com", "x", "", "deep.a.b.city.kawasaki.jp"]
    df = spark.createDataFrame([(h, 1, 0) for h in hosts], "host string, n long, bad long")
    got = {r["host"]: (r["domain"], r["suffix"]) for r in url_filter.with_levels(df, ("uk", "co.uk", "com", "jp", "city.kawasaki.jp")).collect()}
    assert got == {
        "a.shop.co.uk": ("shop.co.uk", "co.uk"), "shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "b.example.com": ("example.com", "com"),
        "x": ("x", "x"), "": ("", ""), "deep.a.b.city.kawasaki.jp": ("b.city.kawasaki.jp", "city.kawasaki.jp"),
    }
    plain = {r["host"]: (r["domain"], r["suffix"]) for r in url_filter.with_levels(df).collect()}
    assert plain["a.shop.co.uk"] == ("co.uk", "uk") and plain[""] == ("", "")
    long = "http://" + "a." * 3000 + "example.com/" + "p" * 100_000
    rows = spark.createDataFrame([(1, long), (2, "http://bad.co.uk/en/1"), (3, "http://fine.co.uk/x")], "page_id long, url string")
    out = {r["page_id"]: r for r in url_filter.filter_urls(rows, (("block", "uk/en/"), ("allow", "uk/en/")), suffixes=("co.uk",)).collect()}
    assert len(out[1]["path"]) == 100_001 and out[2]["verdict"] == "block" and out[2]["rule"] == "uk/en/"  # of equal rules the blocking one


def test_host_reputation_blocks_bad_hosts(spark):
    hosts = spark.createDataFrame([("bad.example.com", 40, 40), ("good.example.com", 40, 0), ("new.example.com", 0, 0), ("a.fine.org", 30, 1), ("b.fine.org", 30, 0)], "host string, n long, bad long")
    got = {r["host"]: r["blocked"] for r in url_filter.host_reputation(hosts).collect()}
    assert got == {"bad.example.com": True, "good.example.com": False, "new.example.com": False, "a.fine.org": False, "b.fine.org": False}


def brute_removed(texts, length, keep):
    first, where = {}, {}
    for k, b in enumerate(texts):
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            where[s] = where.get(s, 0) + 1
            first.setdefault(s, (k, p))
    out = []
    for k, b in enumerate(texts):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if where[s] > 1 and (keep == "none" or first[s] != (k, p)):
                gone[p : p + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("split", [4000, 1])
def test_suffix_dedup_against_brute_force(spark, keep, split):
    r = np.random.default_rng(7)
    pieces = [words(14, 100 + k) for k in range(5)]
    texts = []
    for k in range(40):
        t = " ".join(pieces[j] if r.random() < 0.5 else words(8, 500 + 10 * k + j) for j in r.integers(0, 5, 4))
        texts.append(t)
    texts += ["é" * 90, "a" * 300, "", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: bytes(x["kept"]) for x in suffix_dedup.remove_repeats(df, length=60, gram=20, keep=keep, split=split).collect()}
    want = brute_removed([t.encode() for t in texts], 60, keep)
    assert [got[k] for k in range(len(texts))] == want


@pytest.mark.parametrize("split", [4000, 2])
def test_suffix_dedup_of_a_planted_corpus(spark, split):
    """At the default length: a passage in a third of the texts, each time in other surroundings, passages of over 50
    words on either side of 400 bytes, groups of copies, a long text, a text that repeats itself."""
    r = np.random.default_rng(11)
    hot, long, short = words(90, 1), words(75, 2), " ".join(w[:4] for w in words(60, 3).split())
    assert len(hot) > 400 and len(long) > 400 > len(short)
    texts = []
    for k in range(90):
        t = words(int(r.integers(30, 160)), 1000 + k)
        inner = hot if k % 3 == 0 else long if k % 7 == 0 else short if k % 5 == 0 else ""
        texts.append(f"{t} {inner} {words(int(r.integers(5, 90)), 2000 + k)}")
    texts += [texts[1]] * 12 + [texts[2] + " tail"] * 3 + [words(3000, 4), words(100, 5) * 2, hot, short, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {x["doc_id"]: bytes(x["kept"]) for x in suffix_dedup.remove_repeats(df, split=split).collect()}
    want = brute_removed([t.encode() for t in texts], 400, "none")
    assert [got[k] for k in range(len(texts))] == want
    assert len(want[0]) < len(texts[0]) and want[-2].decode() == short  # under 400 bytes a passage stays, whatever its words


def test_suffix_dedup_edges(odd, empty):
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(odd)).collect()
    assert len(got) == 14
    none = hashlib.sha256(b"").hexdigest()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["kept_sha256"] == none and r["n_removed"] == r["n_bytes"] > 0 for k in (1, 2, 7, 8) for r in by[k])
    assert by[3][0]["n_bytes"] == 0 and by[3][0]["kept_sha256"] == none and by[3][0]["n_spans"] == 0
    assert by[10][0]["n_removed"] == by[10][0]["n_bytes"] == 2000 and by[10][0]["n_spans"] == 1
    assert n(suffix_dedup.remove_repeats(empty)) == 0


def test_quality_rules(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (9, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality_rules.judge(odd, labels).collect()
    assert len(got) == 14
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in got if r["doc_id"] in (3, 4, 6))
    ten = next(r for r in got if r["doc_id"] == 10)
    assert ten["n_repeat_words"] == 400 and ten["base_failed"]
    assert n(quality_rules.judge(empty, labels)) == 0


def test_decision_list_held_out():
    rng = np.random.default_rng(4)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["c"] > 0.5))
    rules = quality_rules.learn_rules({k: v[:2000] for k, v in x.items()}, bad[:2000])
    hit = np.zeros(1000, bool)
    for rule in rules:
        hit |= quality_rules._covers(rule, {k: v[2000:] for k, v in x.items()}, 1000)
    assert (hit == bad[2000:]).mean() > 0.95


def test_ties_of_thresholds():
    """Equal values and equally good conditions: reruns agree, and rows at a threshold are covered alike by both forms of a rule."""
    x = {"a": np.repeat([0.0, 1.0], 300), "b": np.repeat([0.0, 1.0], 300), "same": np.zeros(600)}
    bad = np.repeat([False, True], 300)
    mix = np.random.default_rng(0).permutation(600)
    x, bad = {k: v[mix] for k, v in x.items()}, bad[mix]
    rules = quality_rules.learn_rules(x, bad)
    assert rules == quality_rules.learn_rules(x, bad) and len(rules) == 1 and len(rules[0]) == 1
    c = rules[0][0]
    assert c.name == "a" and c.threshold in (0.0, 1.0) and (c.holds(x) == bad).all()  # the first of equal columns


def test_decontamination(spark, odd, empty):
    item = words(120, 1).split()[20:60]
    paraphrase = [w if k % 4 else "other" for k, w in enumerate(item[:-8])] + item[-8:]
    docs = odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(50).cast("long")).withColumn("text", F.lit(words(200, 77) + " " + " ".join(paraphrase) + " " + words(90, 78))))
    bench = spark.createDataFrame([(7, " ".join(item).upper()), (8, None), (9, "")], "item_id long, text string").withColumn("id", F.lit(1))
    got = {(r["id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(1, 7), (2, 7), (None, 7), (50, 7)}
    left = decontamination.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 9, 10]
    assert n(decontamination.contaminated(empty, bench)) == 0
    assert n(decontamination.contaminated(docs, bench.limit(0))) == 0


def test_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 12)).tolist(), rng.integers(0, 6, rng.integers(0, 15)).tolist()
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        masks = {}
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        assert decontamination.lcs(masks, len(a), b) == t[-1, -1]


def test_token_files(spark, odd, empty, tmp_path):
    path = queries.tokenizer_path()
    got = token_files.token_digest(spark, odd, path).orderBy("start").collect()
    enc = token_files.Encoder(path)
    assert len(got) == 14 and [r["doc_id"] or 0 for r in got] == [0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10]
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    one = next(r for r in got if r["doc_id"] == 5)
    ids = [*enc.tok.encode("one two", add_special_tokens=False).ids, 0]
    assert one["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and one["n_tokens"] == len(ids)
    assert n(token_files.token_digest(spark, empty, path)) == 0
    with pytest.raises(ValueError):
        token_files.write_token_files(odd.withColumn("part", F.lit(1)), str(tmp_path / "x"), path, meta_cols=("part",))
    for encoding in ("dictionary", "delta"):
        out = str(tmp_path / encoding)
        token_files.write_token_files(odd, out, path, meta_cols=("lang",), encoding=encoding)
        back = token_files.read_token_files(spark, out, ("doc_id", "lang"))
        assert back.columns == ["doc_id", "lang", "start"] and n(back) == 14


def test_encoder_matches_library():
    import random

    enc, r = token_files.Encoder(queries.tokenizer_path()), random.Random(1)
    bits = ["foo", "Bar", "é", "12", "½", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "...", ",", "\x1c", "<|endoftext|>", "日本", "\r\n", " ", "_", " \n", "\n ", "!"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for t, raw in zip(texts, enc.encode(texts, b"")):
        assert np.frombuffer(raw, enc.dtype).tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_passages_against_brute_force(spark):
    """Copies of a passage with one or two changed words: every pair that all windows would show is linked, in small and in large groups."""
    from collections import Counter

    r = np.random.default_rng(11)
    rows, group = [], {}
    for k in range(8):
        base = words(80, 2000 + k).split()
        for j in range(40 if k == 0 else 12):
            w = list(base)
            for at in r.choice(80, r.integers(1, 3), replace=False) if j else ():
                w[at] = f"z{r.integers(10**9)}"
            group[len(rows)] = k
            rows.append((len(rows), " ".join(w)))
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    near = {(a, b) for a in group for b in group if a < b and group[a] == group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    for parts, limit in ((1, 24), (5, 24), (3, 6)):
        got = passage_dedup.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), all_pairs=limit).collect()
        pairs = {tuple(sorted((x["doc_id"], x["other_id"]))) for x in got}
        assert all(group[a] == group[b] and x["sim"] >= 0.8 for x in got for a, b in [(x["doc_id"], x["other_id"])])
        top = {}

        def root(x):
            while top.get(x, x) != x:
                x = top[x]
            return x

        for a, b in pairs:
            top[root(a)] = root(b)
        lost = Counter(group[a] for a, b in near if root(a) != root(b))
        assert not lost
        if limit == 24:
            small = {p for p in near if group[p[0]]}
            assert len(small - pairs) <= 0.03 * len(small)


@pytest.mark.parametrize("tag", ['<svg class="i"/>', "<math/>", "<svg>", "<noscript>", "<object data='x'>", "<select><option>", "<canvas/>", "<svg-icon></svg-icon>", "<title-bar>", "<select-box>", "<object-view/>", "<svg><title/><path/></svg>", "<svg><svg>x</svg>y</svg>", "<script>'<svg>'</script x>"])
def test_unclosed_elements_hide_nothing(tag):
    page = f"<article><p>one</p>{tag}<p>rest of article</p></article>"
    assert [b[0] for b in html_extract.cut_blocks(page)] == ["one", "rest of article"]
    again = html_extract.cut_blocks(page + "<svg><text>hidden</text></svg><p>end</p>")
    assert [b[0] for b in again] == ["one", "rest of article", "end"]


def test_raw_text_hides_the_rest():
    for name in ("script", "style", "title", "textarea", "iframe"):
        assert [b[0] for b in html_extract.cut_blocks(f"<p>one</p><{name}><p>not shown</p>")] == ["one"]


def test_take_mix_gives_each_row_its_own_passes(spark, odd, empty):
    rows = [(None, words(60, 700 + k), "s", "en", 0, 7, 1, 2, 3) for k in range(5)]
    for docs in (odd, odd.unionByName(spark.createDataFrame(rows, SCHEMA)).repartition(3)):
        mixed = mixing.mix_sources(docs, queries.MIX_SCHEDULES).collect()
        got = mixing.take_mix(docs, queries.MIX_SCHEDULES).collect()
        assert len(got) == sum(len(r["passes"]) for r in mixed)
        size = {}
        for r in got:
            size[r["source"]] = size.get(r["source"], 0) + len(r["text"].split())
        assert size == {r["source"]: round(r["target"]) for r in mixed if r["target"] > 0}
        times = {}
        for r in got:
            times[r["doc_id"], r["text"]] = times.get((r["doc_id"], r["text"]), 0) + 1
        copies = {}
        for r in docs.collect():
            copies[r["doc_id"], r["text"]] = copies.get((r["doc_id"], r["text"]), 0) + 1
        assert all(n <= 3 * copies.get(k, 1) for k, n in times.items())
    assert n(mixing.take_mix(empty, queries.MIX_SCHEDULES)) == 0


def test_take_mix_of_many_equal_rows(spark):
    """Copies without an id beside empty texts: each copy is in the mix as often as one place of it, none is lost or doubled."""
    rows = [(None, "the same words here", "s", "en", k % 2, 7, 1, 2, 3) for k in range(3000)] + [(None, "", "s", "en", 0, 7, 1, 2, 3)] * 500 + [(k, words(40, k), "t", "en", 0, 7, 1, 2, 3) for k in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    mixed = mixing.mix_sources(docs, queries.MIX_SCHEDULES).collect()
    got = mixing.take_mix(docs, queries.MIX_SCHEDULES).collect()
    assert len(got) == sum(len(r["passes"]) for r in mixed)
    assert sum(len(r["text"].split()) for r in got if r["source"] == "s") == round(next(r["target"] for r in mixed if r["source"] == "s"))
    assert all(r["text"] for r in got)


def test_decontamination_beyond_one_batch(spark):
    r = np.random.default_rng(3)
    p = 1 / np.arange(1, 6001) ** 0.8
    draw = lambda n: [f"w{x}" for x in r.choice(6000, n, p=p / p.sum())]
    items = [draw(16) for _ in range(1000)] + [["w0", "w1", "w2"]]
    docs = []
    for k, x in enumerate(items):
        near = list(x)
        for j in r.choice(len(x), len(x) // 5, replace=False):
            near[j] = f"other{k}"
        docs += [(2 * k, " ".join(draw(40) + x + draw(40))), (2 * k + 1, " ".join(draw(40) + near + draw(40)))]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(x["id"], x["item_id"]) for x in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), bench).collect()}
    exact = [k for k in range(len(items)) if (2 * k, k) not in got]
    near = [k for k in range(1000) if (2 * k + 1, k) not in got]
    print("lost", len(exact), "exact,", len(near), "near of", len(items))
    assert not exact and len(near) <= 10


def test_latent_cosine_finds_a_paraphrase_in_other_words(spark):
    r = np.random.default_rng(5)
    common, rare = [f"common{k}" for k in range(20)], [f"rare{k}" for k in range(10)]
    other = [f"other{k}" for k in range(10)]  # stand for the rare words: the corpus uses both in the same passages
    item = [w for k in range(10) for w in (common[2 * k], rare[k], common[2 * k + 1])] + common[:5]
    changed = [w if w not in rare else other[rare.index(w)] for w in item]
    items = [item] + [[f"item{j}word{k}" for k in range(12)] + other[j : j + 1] + common[:6] for j in range(18)]
    topic = [" ".join(r.permutation([*rare, *other])[:14]) + " " + " ".join(r.choice(common, 40)) for _ in range(400)]
    rest = [" ".join([*common, *r.choice([f"item{j}word{k}" for j in range(18) for k in range(12)], 40)]) for _ in range(1500)]
    docs = spark.createDataFrame([*enumerate(topic + rest), (5000, " ".join([*r.choice(common, 30), *changed, *r.choice(common, 30)]))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    find = lambda **o: {(x["id"], x["item_id"]) for x in decontamination.contaminated(docs, bench, **o).where("item_id = 0").collect()}
    assert (5000, 0) in find()
    # the plain TF-IDF cosine of item and paraphrase is far lower
    got = decontamination.read_items(bench, "item_id", "text", None, 5, 100)
    total, df = decontamination.document_frequencies(docs.select("text"), got)
    weight = decontamination.word_weights(got, total, df, 0.1)

    def vector(words):
        v = np.zeros(len(weight))
        for w in words:
            k = got.lookup(decontamination.term_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1])[0]
            v[k] += weight[k]
        return v / np.linalg.norm(v)

    assert vector(item) @ vector(changed) < 0.2


def test_decontamination_against_brute_force(spark):
    """Every pair of the longest common subsequence's definition, over all windows, on a small table."""
    r = np.random.default_rng(11)
    draw = lambda n: [f"w{x}" for x in r.integers(0, 4000, n)]
    items = [draw(int(r.integers(12, 30))) for _ in range(40)]
    docs = []
    for k in range(200):
        x = items[k % 40]
        edited = [w if r.random() > (k % 5) * 0.1 else f"new{k}" for w in x]
        docs.append(draw(int(r.integers(0, 90))) + (edited if k % 2 else []) + draw(int(r.integers(0, 90))))

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
        return row[-1]

    want = set()
    for d, text in enumerate(docs):
        for k, x in enumerate(items):
            if set(x) & set(text) and any(longest(x, text[s : s + 64]) / len(x) >= 0.8 for s in range(0, max(1, len(text)), 8)):
                want.add((d, k))
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate([*items, items[0]])], "item_id long, text string")
    rows = decontamination.contaminated(docs, bench).collect()
    got = {(x["id"], x["item_id"]) for x in rows if x["coverage"] >= 0.8}
    assert {(d, 40) for d, k in got if k == 0} == {p for p in got if p[1] == 40}  # a repeated item is judged alike
    got = {p for p in got if p[1] < 40}
    assert want and want <= got and len(got - want) <= 0.02 * len(want)  # windows at other places may hold a little more


#: Pages written by hand, with the text a reader would call the article.
BY_HAND = {
    "no names": (
        "<html><body><div><div><h1>A plain page</h1><p>The first paragraph has several words in it, and a comma.</p><p>The second paragraph goes on about the same thing for a while.</p></div></div></body></html>",
        ["A plain page", "The first paragraph has several words in it, and a comma.", "The second paragraph goes on about the same thing for a while."],
    ),
    "old style": (
        "<h1>Old style page</h1><p>Nothing here has a class, as it was written by hand long ago.<p>It still has some paragraphs.<p>And one more for good measure, with a few more words in it.<hr>",
        ["Old style page", "Nothing here has a class, as it was written by hand long ago.", "It still has some paragraphs.", "And one more for good measure, with a few more words in it."],
    ),
    "formula and no script": (
        "<article><h1>Title of it</h1><p>Some words before the image are here.</p><noscript><p>This text is shown when scripts are off.</p></noscript><p>Then <svg viewBox='0 0'/>the formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> follows in the text.</p></article><footer class='footer'>&copy; me</footer>",
        ["Title of it", "Some words before the image are here.", "This text is shown when scripts are off.", "Then the formula x=1 follows in the text."],
    ),
    "nested divisions": (
        "<div><div><div><h1>How to bake bread</h1></div><div><p>Take flour, water, salt and yeast, and mix them in a bowl.</p><p>Let it rise for two hours in a warm place.</p></div></div></div>",
        ["How to bake bread", "Take flour, water, salt and yeast, and mix them in a bowl.", "Let it rise for two hours in a warm place."],
    ),
    "blog": (
        "<body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>Posts</a></li></ul></nav><main><h1>Why we moved</h1><p>The office was too small for all of us &ndash; and too loud.</p><blockquote>It was never quiet.</blockquote><ul><li>More room</li><li>Less noise</li></ul></main>"
        "<section id='comments'><h3>Comments</h3><p>Good for you, I liked the old one better though.</p></section><div class='cookie-notice'>We use cookies.</div><footer class='site-footer'><p>All rights reserved.</p></footer></body>",
        ["Why we moved", "The office was too small for all of us \u2013 and too loud.", "It was never quiet.", "More room", "Less noise"],
    ),
}


def test_labeller_on_pages_written_by_hand():
    net = html_extract.trained_labeller()
    got = {k: html_extract.main_texts([page], net)[0].split("\n") for k, (page, _) in BY_HAND.items()}
    assert got == {k: want for k, (_, want) in BY_HAND.items()}


def test_blocks_against_a_parser():
    """The text of all blocks is what a parser of the standard library reads, for written pages with references and odd spaces."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.now, self.skip = [], "", 0

        def cut(self):
            if self.now.split():
                self.blocks.append(" ".join(self.now.split()))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("style", "title")
            if tag == "br":
                self.now += " "
            elif tag in html_extract.BLOCK:
                self.cut()

        def handle_endtag(self, tag):
            self.skip -= tag in ("style", "title")
            if tag in html_extract.BLOCK:
                self.cut()

        def handle_data(self, data):
            self.now += "" if self.skip else data

    writer = html_extract.PageWriter(31)
    for k in range(300):
        page = writer.page()[0].replace(" an", " &auml;n\n\t ", 3).replace("<p>", "<p title='a>b'> &#x41;&nbsp;", 2)
        reader = Reader()
        reader.feed(page)
        reader.close()
        reader.cut()
        assert [b[0] for b in html_extract.cut_blocks(page)] == reader.blocks, k


def test_toxicity_of_three_labelled_grades(spark):
    r = np.random.default_rng(8)
    rows, labels = [], []
    for k in range(900):
        grade = k % 3
        w = [f"w{x}" for x in r.integers(0, 2000, 50)] + ["rude"] * (grade == 1) + ["vile", "rude"] * (grade == 2)
        r.shuffle(w)
        rows.append((k, " ".join(w)))
        if k < 600:
            labels.append((k, grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = toxicity.score_toxicity(docs.where("doc_id >= 600"), model).collect()
    assert all(round(x["severity"]) == x["doc_id"] % 3 and x["toxic"] == (x["doc_id"] % 3 > 0) for x in got)


def test_own_columns_leave_a_users_alone(spark):
    own = {"_fp": F.lit("mine"), "_text": F.lit(3), "_at": F.lit(333.0), "_i": F.lit(-1), "_id": F.lit(5), "_key": F.lit("k"), "_k": F.lit(1), "_p": F.lit(2), "fp": F.lit(0)}
    docs = spark.createDataFrame([(k, words(80, k), "s") for k in range(6)], "doc_id long, text string, source string").withColumns(own)
    bench = spark.createDataFrame([(1, words(80, 3))], "item_id long, text string")
    model = toxicity.OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0]))
    for got in (near_dedup.keep_one(docs), decontamination.drop_contaminated(docs, bench), mixing.take_mix(docs, queries.MIX_SCHEDULES), toxicity.score_toxicity(docs, model)):
        rows = got.collect()
        assert rows and all((x["_fp"], x["_text"], x["_at"], x["_i"], x["_id"], x["_key"], x["_k"], x["_p"], x["fp"]) == ("mine", 3, 333.0, -1, 5, "k", 1, 2, 0) for x in rows)
    as_text = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert n(near_dedup.keep_one(as_text)) == 6
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        near_dedup.keep_one(docs.withColumn("doc_id", F.lit("x"))).collect()


def test_quality_counts_against_brute_force(spark, odd):
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("ab#$ \n\té\u00a0|<"), int(r.integers(0, 300)))) for _ in range(150)] + ["one two three one two three", "", None, " \n ", "a b\na b\n\n\na b", "x " * 3000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for x in quality_rules.judge(docs, labels).collect():
        t = texts[x["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, twice = {}, set()
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        for at in seen.values():
            if len(at) > 1:
                twice |= {j for k in at for j in (k, k + 1, k + 2)}
        lines = [y for y in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice))
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want, t
        failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
        assert x["base_failed"] == failed and not (failed and x["kept"])
