"""Benchmark decontamination by latent semantic retrieval and sequence checks.

1. Document frequencies of the benchmark's words over all documents give TF-IDF weights. Words in
   over ``max_df`` of the documents weigh nothing, but an item of which fewer than half the words are left keeps all of them.
2. Passages are windows of ``window`` words at every half window of every document. One pass adds up Y = A'A G for
   the passage matrix A (and the items' rows, which together weigh as much as all passages) and a
   Gaussian G: a randomised SVD in Nystrom form, summed block by block over the cluster, whose
   right singular vectors of A come from Y alone. Items are factorised in batches of at most ``batch_items``, each in
   ``rank_share`` times as many dimensions as items, so that words that stand in the same passages and items share dimensions; Y
   is one for all batches.
3. A second pass projects every passage into the latent space and takes its cosine there with the items (a projection shorter than
   ``floor`` of the passage counts as that long); items with a cosine over ``min_cosine`` are candidates, and so are items
   all of whose words stand in a row.
4. The longest common subsequence of an item's words and the passage (widened by the item's length)
   must cover ``threshold`` of the item; a paraphrase with at least ``loose`` counts if
   it also holds the answer word for word (the answer column, or else the item's last ``answer_words`` words).

Words are runs of letters and digits, ASCII-lower-cased, compared by 64-bit hash. The benchmark is the stated query set: it is
collected (at most ``max_items`` items, else an error) and sent to all tasks with matrices of its words times the rank, of at
most ``max_bytes`` in all, else an error: such a benchmark is to be decontaminated in parts.

Edge cases: null and empty texts match nothing; null and empty items are ignored; items shorter than the
window, documents shorter than an item, repeated ids, equal rows and repeated items are all
judged alike; null ids are kept; ids of documents that are no integers raise; an empty table or benchmark gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import U64, own_name, row_keys, slices
from .toxicity import term_hashes

BLOCKS = 64
_BITS = 20


@dataclass
class Items:
    """The benchmark: ids, word numbers of each item and answer, sorted word hashes."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocab: np.ndarray
    table: np.ndarray

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Word number of each hash, -1 for words that no item has."""
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.table[(h >> U64(64 - _BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.vocab, h[at]), len(self.vocab) - 1)
        hit = self.vocab[k] == h[at]
        out[at[hit]] = k[hit]
        return out


def read_items(bench: DataFrame, item_col: str, text_col: str, answer_col: str | None, answer_words: int, max_items: int) -> Items:
    rows = bench.select(F.col(item_col), F.col(text_col).cast("string"), *([F.col(answer_col).cast("string")] if answer_col else [])).limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"the benchmark has over {max_items} items; decontaminate it in parts")

    def hashes(t: str | None) -> np.ndarray:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return term_hashes(raw, np.array([0, len(raw)]))[1]

    ids, words, answers = [], [], []
    for r in rows:
        h = hashes(r[1])
        if len(h):
            ids.append(r[0])
            words.append(h)
            a = hashes(r[2]) if answer_col else h[:0]
            answers.append(a if len(a) else h[-answer_words:])
    vocab = np.unique(np.concatenate([*words, *answers])) if words else np.zeros(0, np.uint64)
    table = np.zeros(1 << _BITS, bool)
    table[(vocab >> U64(64 - _BITS)).astype(np.int64)] = True
    number = lambda h: np.searchsorted(vocab, h)
    return Items(ids, [number(w) for w in words], [number(a) for a in answers], vocab, table)


def document_frequencies(rows: DataFrame, items: Items) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(len(items.vocab), np.int64), 0
        for part, buf, off in slices(batches):
            doc, h = term_hashes(buf, off)
            w = items.lookup(h)
            ok = w >= 0
            count += np.bincount(np.unique(doc[ok] * len(items.vocab) + w[ok]) % len(items.vocab), minlength=len(items.vocab))
            n += part.num_rows
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(count[at], n))], names=["word", "n"])

    got = rows.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(items.vocab), np.int64)
    seen = dict(zip(got["word"].tolist(), got["n"].tolist()))
    total = int(seen.pop(-1, 0))
    for k, n in seen.items():
        df[k] = n
    return total, df


def word_weights(items: Items, total: int, df: np.ndarray, max_df: float) -> np.ndarray:
    idf = np.log((total + 1) / (df + 1)) + 1e-3
    keep = df <= max_df * total
    whole = [w for w in items.words if keep[w].mean() < 0.5]
    for w in whole:
        keep[w] = True
    return np.where(keep, idf, 0.0)


def passages(buf: np.ndarray, off: np.ndarray, items: Items, weight: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, word numbers, first word of each text, passage number, its word, its value, passage's text, passage's first word).

    Values are tf-idf, each passage of length one; passages without weighted words are left out."""
    doc, h = term_hashes(buf, off)
    w = items.lookup(h)
    first = np.searchsorted(doc, np.arange(len(off)))
    at = np.flatnonzero((w >= 0) & (weight[w] > 0))
    half = window // 2
    k = (at - first[doc[at]]) // half
    # a word lies in the window that starts in its half and in the one before
    last = np.maximum(0, -(-(first[doc[at] + 1] - first[doc[at]]) // half) - 2)
    two = (k > 0) & (k <= last)
    starts = np.concatenate([np.minimum(k, last), k[two] - 1])
    d, t = np.concatenate([doc[at], doc[at][two]]), np.concatenate([w[at], w[at][two]])
    span = int(starts.max() + 1) if len(starts) else 1
    code = np.unique((d * span + starts) * len(items.vocab) + t, return_counts=True) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    word, place = code[0] % len(items.vocab), code[0] // len(items.vocab)
    value = weight[word] * (1 + np.log(code[1]))
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    number = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    if len(begin):
        value = value / np.sqrt(np.add.reduceat(value * value, begin))[number]
    return doc, w, first, number, word, value.astype(np.float32), place[begin] // span, place[begin] % span * half, begin


def gram_product(rows: DataFrame, items: Items, weight: np.ndarray, window: int, sketch: int, seed: int) -> tuple[np.ndarray, int]:
    """(A'A G, number of passages) over all passages, summed by blocks of words."""
    v = len(items.vocab)
    edges = np.linspace(0, v, BLOCKS + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.random.default_rng(seed).standard_normal((v, sketch), np.float32)
        y, n = np.zeros((v, sketch), np.float32), 0
        for _, buf, off in slices(batches, limit=1_000_000):
            *_, number, word, value, text, _, begin = passages(buf, off, items, weight, window)
            if not len(begin):
                continue
            n += len(begin)
            for a in range(0, len(begin), 4000):
                lo = begin[a]
                hi = begin[a + 4000] if a + 4000 < len(begin) else len(word)
                p = np.add.reduceat(g[word[lo:hi]] * value[lo:hi, None], begin[a : a + 4000] - lo, axis=0)
                order = np.argsort(word[lo:hi], kind="stable")
                ws = word[lo:hi][order]
                b = np.flatnonzero(np.append(True, ws[1:] != ws[:-1]))
                y[ws[b]] += np.add.reduceat(p[number[lo:hi][order] - a] * value[lo:hi][order, None], b, axis=0)
        blocks = [y[edges[k] : edges[k + 1]].tobytes() for k in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(blocks, pa.binary()), pa.array([n if k == 0 else 0 for k in range(BLOCKS)], pa.int64())], names=["block", "y", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = None
        for b in table.column("y").to_pylist():
            x = np.frombuffer(b, np.float32).astype(np.float64)
            total = x if total is None else total + x
        n = sum(table.column("n").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "y": pa.array([total.astype(np.float64).tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    part = rows.select("text").mapInArrow(run, "block int, y binary, n long")
    got = sorted(part.groupBy("block").applyInArrow(add, "block int, y binary, n long").collect())
    y = np.concatenate([np.frombuffer(r["y"], np.float64).reshape(-1, sketch) for r in got]) if got else np.zeros((v, sketch))
    return y, sum(r["n"] for r in got)


@dataclass
class Space:
    """The latent space of a batch of items: a vector of each word, and the unit vector of each item."""

    items: np.ndarray
    words: np.ndarray
    units: np.ndarray


def item_rows(items: Items, weight: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, items x words): unit tf-idf rows of some items, over the words that these have."""
    own = np.unique(np.concatenate([items.words[k] for k in at]))
    b = np.zeros((len(at), len(own)))
    for j, k in enumerate(at):
        u, n = np.unique(items.words[k], return_counts=True)
        b[j, np.searchsorted(own, u)] = weight[u] * (1 + np.log(n))
    return own, b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)


def latent_space(y: np.ndarray, n: int, own: np.ndarray, b: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (words x rank) of the n passages, given as A'A G, and of the rows ``b`` over the words ``own``."""
    sketch = y.shape[1]
    g = np.random.default_rng(seed).standard_normal(y.shape, np.float32).astype(np.float64)
    y = y.copy()
    y[own] += max(1.0, n / len(b)) * (b.T @ (b @ g[own]))
    y += 1e-10 * np.linalg.norm(y) * g
    values, vectors = np.linalg.eigh((g.T @ y + y.T @ g) / 2)
    ok = values > values.max() * 1e-12
    f = y @ (vectors[:, ok] / np.sqrt(values[ok]))
    u, _, _ = np.linalg.svd(f, full_matrices=False)
    return u[:, : min(rank, sketch)].astype(np.float32)


def latent_spaces(rows: DataFrame, items: Items, weight: np.ndarray, window: int, batch_items: int, rank_share: float, max_bytes: int, seed: int = 7) -> list[Space]:
    """The spaces of all batches of items; the pass over the documents is one for all."""
    batches = np.array_split(np.arange(len(items.ids)), -(-len(items.ids) // batch_items))
    rank = max(1, min(int(np.ceil(rank_share * len(batches[0]))), len(items.vocab)))
    sketch = min(rank + 8, len(items.vocab))
    if 4 * len(items.vocab) * max(sketch, rank * len(batches)) > max_bytes:
        raise ValueError(f"the latent spaces of this benchmark take over {max_bytes} bytes; decontaminate it in parts")
    y, n = gram_product(rows, items, weight, window, sketch, seed)
    spaces = []
    for at in batches:
        own, b = item_rows(items, weight, at)
        space = latent_space(y, n, own, b, rank, seed)
        z = b.astype(np.float32) @ space[own]
        spaces.append(Space(at, space, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)))
    return spaces


def contained_items(w: np.ndarray, first: np.ndarray, items: Items, anchors: dict[int, list[tuple[int, int]]], is_anchor: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item, first word of the item in the text) wherever all words of an item stand in a row."""
    at = np.flatnonzero((w >= 0) & is_anchor[w])
    at = at[np.argsort(w[at], kind="stable")]
    out = []
    for group in np.split(at, np.flatnonzero(np.diff(w[at])) + 1) if len(at) else ():
        text = np.searchsorted(first, group, "right") - 1
        for k, place in anchors[int(w[group[0]])]:
            x = items.words[k]
            s = group - place
            ok = (s >= first[text]) & (s + len(x) <= first[text + 1])
            s, d = s[ok], text[ok]
            for j, v in enumerate(x.tolist()):
                if not len(s):
                    break
                same = w[s + j] == v
                s, d = s[same], d[same]
            out += [(t, k, p) for t, p in zip(d.tolist(), (s - first[d]).tolist())]
    return out


def lcs(a_masks: dict[int, int], m: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    full = (1 << m) - 1
    v = full
    for w in words:
        x = a_masks.get(w)
        if x:
            u = v & x
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, window: int = 64, max_df: float = 0.1, batch_items: int = 256, rank_share: float = 0.5, min_cosine: float = 0.5, floor: float = 0.3, threshold: float = 0.8, loose: float = 0.65, answer_words: int = 5, max_items: int = 20_000, max_bytes: int = 256_000_000) -> DataFrame:
    """One row for each document and item found in it: id, fp (hash of the text), item_id, cosine, coverage."""
    rows = row_keys(docs, id_col, text_col)
    kind = bench.schema[item_col].dataType
    items = read_items(bench, item_col, item_text_col, answer_col, answer_words, max_items)
    out = f"id long, fp long, item_id {kind.simpleString()}, cosine double, coverage double"
    if not items.ids:
        return docs.sparkSession.createDataFrame([], out)
    total, df = document_frequencies(rows, items)
    weight = word_weights(items, total, df, max_df)
    spaces = latent_spaces(rows, items, weight, window, batch_items, rank_share, max_bytes)
    anchors: dict[int, list[tuple[int, int]]] = {}
    for k, x in enumerate(items.words):
        place = int(np.argmin(df[x]))
        anchors.setdefault(int(x[place]), []).append((k, place))
    is_anchor = np.zeros(len(items.vocab), bool)
    is_anchor[list(anchors)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = []
        for w in items.words:
            one: dict[int, int] = {}
            for k, x in enumerate(w.tolist()):
                one[x] = one.get(x, 0) | 1 << k
            masks.append(one)
        answers = [a.tolist() for a in items.answers]
        for part, buf, off in slices(batches, limit=1_000_000):
            doc, w, first, number, word, value, text, start, begin = passages(buf, off, items, weight, window)
            best: dict[tuple[int, int], tuple[float, float]] = {}
            sure: list[tuple[int, int]] = []
            for d, k, p in contained_items(w, first, items, anchors, is_anchor):
                i = np.arange(*np.searchsorted(text, [d, d + 1]))
                sure += [(x, k) for x in i[(start[i] <= p) & (p < start[i] + window)].tolist()]
            sure_at = np.array(sorted(sure), np.int64).reshape(-1, 2)
            for a in range(0, len(begin), 4000):
                lo = begin[a]
                hi = begin[a + 4000] if a + 4000 < len(begin) else len(word)
                cos = np.empty((min(4000, len(begin) - a), len(items.ids)), np.float32)
                for space in spaces:
                    p = np.add.reduceat(space.words[word[lo:hi]] * value[lo:hi, None], begin[a : a + 4000] - lo, axis=0)
                    cos[:, space.items] = p @ space.units.T / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), floor)
                close = cos >= min_cosine
                x, y = np.searchsorted(sure_at[:, 0], [a, a + 4000])
                close[sure_at[x:y, 0] - a, sure_at[x:y, 1]] = True
                for i, k in zip(*(x.tolist() for x in np.nonzero(close))):
                    d, s = int(text[a + i]), int(start[a + i])
                    m = len(items.words[k])
                    if best.get((d, k), (0, 0.0))[1] == 1:
                        continue
                    region = w[max(first[d], first[d] + s - m) : min(first[d + 1], first[d] + s + window + m)].tolist()
                    cover = lcs(masks[k], m, region) / m
                    if cover < threshold and not (cover >= loose and _holds(region, answers[k])):
                        continue
                    if cover > best.get((d, k), (0, 0.0))[1]:
                        best[d, k] = (float(cos[i, k]), cover)
            keys = sorted(best)
            d = pa.array([x for x, _ in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(d), part.column(1).take(d), pa.array([items.ids[k] for _, k in keys], kind_arrow), pa.array([best[x][0] for x in keys], pa.float64()), pa.array([best[x][1] for x in keys], pa.float64())], names=["id", "fp", "item_id", "cosine", "coverage"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind_arrow = to_arrow_type(kind)
    return rows.mapInArrow(run, out)


def _holds(region: list[int], answer: list[int]) -> bool:
    n = len(answer)
    return any(region[k : k + n] == answer for k in range(len(region) - n + 1))


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item was found."""
    key, own, fp = (own_name(n) for n in ("id", "key", "fp"))
    found = contaminated(docs, bench, id_col, text_col, **options).select(F.col("id").alias(key), F.col("fp").alias(own)).distinct()
    keyed = docs.withColumn(fp, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return keyed.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(fp) == F.col(own)), "left_anti").select(*docs.columns)
