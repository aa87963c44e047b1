"""The whole pipeline on a small folder against a brute-force version in plain Python."""

import hashlib
import math
import zlib

import numpy as np

import corpus_pipeline
from tidewater.llm import queries, token_files


def words(n, r):
    return ["".join(r.choice(list("abcdefghijklm"), 6)) for _ in range(n)]


def shingle_set(t):
    w = t.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_dedup(docs):
    ids = sorted(docs)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingle_set(docs[i][0]) for i in ids}
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if docs[a][0] == docs[b][0] or (both and both / len(sets[a] | sets[b]) >= 0.8):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: docs[i] for i in ids if find(i) == i}


def brute_mix(docs):
    sources = sorted({s for _, s in docs.values()})
    size = {s: sum(len(t.split()) for t, x in docs.values() if x == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, fixed = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in fixed)
        free = [s for s in sources if s not in fixed]
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * size[s]]
        if not over:
            break
        fixed |= set(over)
    target |= {s: 3 * size[s] for s in fixed}
    out = []
    for s in sources:
        aim, at = math.floor(target[s] + 0.5), 0
        for i in sorted((i for i in docs if docs[i][1] == s), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            n = len(docs[i][0].split())
            for e in range(3):
                take = max(0, min(n, aim - at - e * size[s]))
                if take:
                    out.append((i, docs[i][0] if take == n else " ".join(docs[i][0].split()[:take])))
            at += n
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    r = np.random.default_rng(3)
    item = words(30, r)
    docs = {}
    for i in range(0, 300, 3):
        w = words(int(r.integers(60, 120)), r)
        if i % 5 == 0:
            for k in r.integers(0, len(w), 2):
                w.insert(int(k), str(r.choice(["vile", "awful"])))
            w.insert(3, "vile")
        if i % 33 == 0:
            w = w[:20] + item + w[20:]
        docs[i] = (" ".join(w), f"src{i % 4 if i % 7 else 9}")
    for i in (3, 9, 21, 27):
        docs[i + 1000] = docs[i]
        near = docs[i][0].split()
        near[30] = "changed"
        docs[i + 2000] = (" ".join(near), "src1")
    toxic = {i for i, (t, _) in docs.items() if "vile" in t.split()}
    folder = str(tmp_path)
    rows = [(i, t, "en", s, len(t)) for i, (t, s) in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in list(docs)[:80]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    left = {i: d for i, d in docs.items() if i not in toxic}
    left = brute_dedup(left)
    left = {i: d for i, d in left.items() if " ".join(item) not in d[0]}
    enc = token_files.Encoder(queries.tokenizer_path())
    want = []
    for i, t in brute_mix(left):
        ids = [*enc.tok.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    assert sorted((x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in got) == sorted(want)
    assert [x["doc_id"] for x in got] == sorted(x[0] for x in want)
    assert [x["start"] for x in got] == np.cumsum([0, *[x["n_tokens"] for x in got]])[:-1].tolist()
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_ids"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder_of(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids, texts, sources and labels, empty and equal texts: one text of each kind stays, and what stays is mixed whole."""
    r = np.random.default_rng(1)
    a, b, c, d = (" ".join(words(90, r)) for _ in range(4))
    rows = [(1, a, "en", "s", len(a)), (2, a, "en", "s", len(a)), (None, b, None, None, None), (None, b, "de", "t", 5), (None, c, "en", "s", 1), (7, None, "en", "s", None), (8, "", "en", "s", 0), (9, " \n\t", "en", None, 3), (9, d, "en", "s", 4), (10, "one", "en", "s", 3)]
    folder = folder_of(spark, tmp_path, rows, [(1, None, None), (None, 1, 1), (77, 0, 0)], [(None, None), (1, "")])
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, folder)
        assert kept.columns == [x.split()[0] for x in SCHEMA.split(", ")], name
    texts = sorted(x["text"] or "" for x in kept.collect())
    assert [t for t in texts if t.strip()] == sorted([a, b, c, d, "one"]) and len(texts) <= 7  # one empty text, one of white space
    got = corpus_pipeline.run(spark, folder).collect()
    enc = token_files.Encoder(queries.tokenizer_path())
    sizes = {len(enc.tok.encode(t, add_special_tokens=False).ids) + 1 for t in (a, b, c, d, "one")}
    assert {x["n_tokens"] for x in got} & sizes and sum(x["doc_id"] is None for x in got) >= 2
    assert sorted(x["start"] for x in got) == np.cumsum([0, *[x["n_tokens"] for x in sorted(got, key=lambda x: x["start"])]])[:-1].tolist()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = folder_of(spark, tmp_path, [], [], [])
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0
