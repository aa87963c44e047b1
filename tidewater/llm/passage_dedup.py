"""Near-duplicate passages by compact windows.

Tokens are the five-word shingles of a text in order. Under each of ``n_hashes`` hash functions a token
is the smallest of all subsequences inside its compact window, the range up to the next smaller
token on either side; windows are the nodes of the Cartesian tree over the token hashes. Only those of at least ``min_words`` words are
made (about two for each ``min_words`` tokens), cut to what passages of ``min_words`` words around their token reach. Passages
that share a window's token under a hash function agree there, as min-hash signatures do.

Windows meet by (hash function, token):

1. Windows of equal content are repeats at once: each links to the first document that has it, so an equal passage in n
   documents makes n - 1 links. A task links its own windows first and sends one of each content on; a token with many contents in
   one task is dealt over many cells.
2. Where a token has at most ``all_pairs`` different contents all of them meet. The shingles of their overlap are fetched and
   compared, and a passage counts if the Jaccard similarity of the matching stretches reaches ``threshold``, or that of two windows of
   ``min_words`` words, whose first and last words may differ (``near_windows``).
3. In larger groups windows meet by rare shingles (``rare_groups``): a similar passage of ``min_words`` words has at least
   ``2 threshold / (1 + threshold)`` of its shingles in common, so a window with fewer shingles that occur twice in its group has no partner
   (a repeated line in unlike surroundings makes no pairs), and the others share one of the rarest ones beyond that number. All windows under a rare
   shingle meet, whatever their number: comparisons grow with the square of a family of edited copies;
   ``passage_classes`` gives the classes of passages without that.

Equal passages are always found.
A passage of similarity s shares a token's window with its partner with probability 1 - (1-s)^n_hashes (0.998 at 0.8) for each
stretch of ``min_words`` words; edits next to the token can still hide it. The tests hold links against brute force. With ``need`` over 1 only overlaps
in windows of so many hash functions are compared, which costs less and loses some pairs near the threshold.

Edge cases: null and empty texts, and texts under ``min_words``, have no passages; repeats inside one
document are not reported; rows equal in id and text are one document; null ids are kept; ids that are no integers raise; an empty
table gives no rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import U64, free, gram_hashes, mix, powers, row_keys, slices, stash, word_bounds, word_hashes

WINDOW = [("key", "<u8"), ("dk", "<u8"), ("ch", "<u4"), ("l", "<i4"), ("c", "<i4"), ("r", "<i4"), ("m", "u1")]
LINK = [("dx", "<u8"), ("dy", "<u8"), ("h", "<i4"), ("need", "<i4"), ("lx", "<i4"), ("rx", "<i4"), ("ly", "<i4"), ("ry", "<i4")]
GRAM = [("gram", "<u8"), ("w", "<u8"), ("side", "u1")]
COUNTED = [("gram", "<u8"), ("w", "<u8"), ("side", "u1"), ("n", "<u4")]
GAP = 12  # shingles that one or two changed words take out
SPREAD = 64  # contents of a token in one task beyond which they are dealt over all cells
ASKS = 512  # overlaps that one row asks of a document
AT_ONCE = 400_000  # shingles of asked overlaps that a task compares at once
SLICE = 1_000_000  # bytes of text that a task works on at once
GRAMS_AT_ONCE = 500_000  # shingles of windows that a task deals out at once
LINKS_AT_ONCE = 50_000  # links of windows that a task merges at once


def give_back() -> None:
    """Return freed memory to the system: Python workers stay between tasks, next to an executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def stream(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def task(batches):
        yield from run(batches)
        give_back()

    return rows.mapInArrow(task, schema)


def by_cells(rows: DataFrame, cells: int, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """As many partitions as cells, whose number follows the bytes: a task's share stays the same at any size."""

    def group(table):
        out = run(table)
        give_back()
        return out

    return rows.repartition(cells, "cell").groupBy("cell").applyInArrow(group, schema)


def pack(columns: dict[str, np.ndarray], kinds: list) -> bytes:
    """Column after column, which compresses better than rows."""
    return b"".join([np.ascontiguousarray(columns[n].astype(t, copy=False)).tobytes() for n, t in kinds])


def unpack(blobs: list[bytes], kinds: list) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in kinds)
    out: dict[str, list] = {n: [np.zeros(0, t)] for n, t in kinds}
    for b in blobs:
        rows, at = len(b) // width, 0
        for n, t in kinds:
            out[n].append(np.frombuffer(b, t, rows, at))
            at += rows * np.dtype(t).itemsize
    return {n: np.concatenate(x) for n, x in out.items()}


def take(columns: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {n: x[at] for n, x in columns.items()}


def by_cell(columns: dict[str, np.ndarray], kinds: list, key: np.ndarray, cells: int) -> tuple[list[int], list[bytes]]:
    cell = (mix(key) % U64(cells)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    edges = np.searchsorted(cell[order], np.arange(cells + 1))
    some = [k for k in range(cells) if edges[k] < edges[k + 1]]
    return some, [pack(take(columns, order[edges[k] : edges[k + 1]]), kinds) for k in some]


def tokens(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in order, text number of each)."""
    s, e, doc = word_bounds(buf, off)
    g, at = gram_hashes(word_hashes(buf, s, e), doc, words)
    return g, doc[at]


def cartesian_extents(values: list[int], docs: list[int]) -> tuple[list[int], list[int]]:
    """Index of the next smaller value to the left and to the right inside the same text, -1 if none."""
    left, right, stack, now = [-1] * len(values), [-1] * len(values), [], -1
    for j, (v, d) in enumerate(zip(values, docs)):
        if d != now:
            stack, now = [], d
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = j
        if stack:
            left[j] = stack[-1]
        stack.append(j)
    return left, right


def compact_windows(g: np.ndarray, gd: np.ndarray, t: int, n_hashes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each hash function (number, l, c, r) of the windows of at least t tokens, as indices into g, at most t - 1 from c.

    A token whose window has t tokens is the smallest of some t tokens in a row, and so are the
    smaller tokens next to its window, so the tree is built over such tokens only."""
    n = len(g)
    if n < t:
        return
    p = np.flatnonzero(gd[: n - t + 1] == gd[t - 1 :])
    if not len(p):
        return
    begin = np.searchsorted(gd, gd, "left")
    end = np.searchsorted(gd, gd, "right") - 1
    bits = U64(max(24, n.bit_length()))
    index = np.arange(n, dtype=np.uint64)
    for i in range(n_hashes):
        v = ((mix(g + U64((i + 1) * 0xD6E8FEB86659FD93 % 2**64)) >> bits) << bits) | index
        m, k = v, 1
        while k * 2 <= t:
            m = np.minimum(m[:-k], m[k:])
            k *= 2
        if k < t:
            m = np.minimum(m[: len(m) - (t - k)], m[t - k :])
        a = (m[p] & ((U64(1) << bits) - U64(1))).astype(np.int64)
        c = a[np.append(True, a[1:] != a[:-1])]
        left, right = cartesian_extents(v[c].tolist(), gd[c].tolist())
        left, right = np.array(left), np.array(right)
        yield i, np.maximum(np.where(left >= 0, c[left] + 1, begin[c]), c - t + 1), c, np.minimum(np.where(right >= 0, c[right] - 1, end[c]), c + t - 1)


def _collapse(w: dict[str, np.ndarray], n_hashes: int, in_rows: bool) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(links of windows of equal content to the first document that has it, one window of each content of a key by key and document).

    With ``in_rows`` the first window of each document is linked to it, and further ones to the one before in the same document."""
    size, place = w["r"] - w["l"], w["c"] - w["l"]
    order = np.lexsort((w["l"], w["dk"], place, size, w["ch"], w["key"]))
    w, size, place = take(w, order), size[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (w["key"][1:] != w["key"][:-1]) | (w["ch"][1:] != w["ch"][:-1]) | (size[1:] != size[:-1]) | (place[1:] != place[:-1])
    at = np.flatnonzero(new)
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    x = np.flatnonzero(~new if in_rows else w["dk"] != w["dk"][head])
    link = _link(w, x, np.where(w["dk"][x] == w["dk"][x - 1], x - 1, head[x]) if in_rows else head[x], n_hashes)
    heads = take(w, at)
    if len(at):
        heads["m"] = np.bitwise_or.reduceat(w["m"], at) | (np.diff(np.append(at, len(order))) > 1).astype(np.uint8)
    return link, take(heads, np.lexsort((heads["l"], heads["dk"], heads["key"])))


def _link(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, n_hashes: int) -> dict[str, np.ndarray]:
    link = {"dx": w["dk"][x], "dy": w["dk"][y], "h": (w["key"][x] % U64(n_hashes)).astype(np.int32), "need": np.zeros(len(x), np.int32)}
    for n in "lr":
        link[n + "x"], link[n + "y"] = w[n][x], w[n][y]
    return link


def find_windows(rows: DataFrame, words: int, t: int, n_hashes: int, cells: int, in_rows: bool = False) -> DataFrame:
    """(dk, text) -> (cell, kind, blob): kind 0 windows by key, kind 1 links found inside a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def flush():
            w = {n: np.concatenate([x[n] for x in held]) for n, _ in WINDOW}
            link, w = _collapse(w, n_hashes, in_rows)
            new = np.append(True, w["key"][1:] != w["key"][:-1])[: len(w["key"])]
            size = np.diff(np.append(np.flatnonzero(new), len(new)))
            many = np.repeat(size > SPREAD, size)
            w["m"] = w["m"] | np.where(many, 2, 0).astype(np.uint8)
            # the first of many contents goes where other tasks send this token, so that theirs are not taken for the only ones
            k, b = by_cell(w, WINDOW, np.where(many & ~new, w["key"] + mix(w["ch"].astype(np.uint64)), w["key"]), cells)
            k2, b2 = by_cell(link, LINK, link["dx"], cells)
            return pa.RecordBatch.from_arrays([pa.array(k + k2, pa.int32()), pa.array([0] * len(k) + [1] * len(k2), pa.int32()), pa.array(b + b2, pa.binary())], names=["cell", "kind", "blob"])

        for part, buf, off in slices(batches, limit=SLICE):
            g, gd = tokens(buf, off, words)
            dk = np.asarray(part.column(0)).astype(np.int64).view(np.uint64)
            if len(g) < t:
                continue
            pw, inv = powers(len(g))
            sums = np.zeros(len(g) + 1, np.uint64)
            np.cumsum(g * pw[: len(g)], out=sums[1:])
            base = np.searchsorted(gd, gd, "left")
            for i, l, c, r in compact_windows(g, gd, t, n_hashes):
                # the number of the hash function is the key's remainder
                key = mix(g[c] + U64((i + 1) * 0xA0761D6478BD642F % 2**64))
                key = key - key % U64(n_hashes) + U64(i)
                ch = mix((sums[r + 1] - sums[l]) * inv[l]) >> U64(32)
                held.append({"key": key, "dk": dk[gd[c]], "ch": ch.astype(np.uint32), "l": (l - base[c]).astype(np.int32), "c": (c - base[c]).astype(np.int32), "r": (r - base[c]).astype(np.int32), "m": np.zeros(len(c), np.uint8)})
                size += len(c)
            if size > 400_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return stream(rows.select("dk", "text"), run, "cell int, kind int, blob binary")


def join_windows(found: DataFrame, n_hashes: int, cells: int, in_rows: bool = False) -> DataFrame:
    """Windows of one key -> (cell, kind, blob): kind 0 one window of each content where a token has several, kind 1 links."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        equal, w = _collapse(unpack([b for k, b in zip(kinds, blobs) if k == 0], WINDOW), n_hashes, in_rows)
        known = unpack([b for k, b in zip(kinds, blobs) if k == 1], LINK)
        b = [pack(take(part, slice(j, j + LINKS_AT_ONCE)), LINK) for part in (equal, known) for j in range(0, len(part["dx"]), LINKS_AT_ONCE)]
        begin = np.flatnonzero(np.append(True, w["key"][1:] != w["key"][:-1])[: len(w["key"])])
        size = np.diff(np.append(begin, len(w["key"])))
        w = take(w, np.flatnonzero((np.repeat(size, size) > 1) | (w["m"] & 2 > 0)))
        k0, b0 = by_cell(w, WINDOW, w["dk"], cells)
        return pa.table({"cell": pa.array(k0 + [0] * len(b), pa.int32()), "kind": pa.array([0] * len(k0) + [1] * len(b), pa.int32()), "blob": pa.array(b0 + b, pa.binary())})

    return by_cells(found, cells, run, "cell int, kind int, blob binary")


def window_rows(blobs: DataFrame, n_hashes: int) -> DataFrame:
    """Blobs of windows -> (key, h, dk, l, c, r, m), h the number of the hash function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            w = unpack(part.column(0).to_pylist(), WINDOW)
            i8, i4 = (lambda n: pa.array(w[n].view(np.int64))), (lambda v: pa.array(v.astype(np.int32)))
            h = w["key"] % U64(n_hashes)
            yield pa.RecordBatch.from_arrays([i8("key"), i4(h), i8("dk"), i4(w["l"]), i4(w["c"]), i4(w["r"]), i4(w["m"] & 1)], names=["key", "h", "dk", "l", "c", "r", "m"])

    return stream(blobs.select("blob"), run, "key long, h int, dk long, l int, c int, r int, m int")


LINKS = "dx long, dy long, h int, need int, lx int, rx int, ly int, ry int"


def link_rows(blobs: DataFrame) -> DataFrame:
    """Blobs of links -> rows of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for blob in part.column(0):
                k = unpack([blob.as_py()], LINK)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.itemsize == 8 else v) for v in k.values()], names=list(k))

    return stream(blobs.select("blob"), run, LINKS)


def links(pairs: DataFrame, need: int) -> DataFrame:
    """Pairs of windows -> links, each once, with the number of hash functions wanted.

    One is enough where a window stands for others of equal content: under another hash function another document may stand for them."""
    few = F.lit(1) if need == 1 else F.when(F.col("mx") + F.col("my") > 0, 1).otherwise(need)
    h = F.lit(0) if need == 1 else F.col("h")
    return pairs.select("dx", "dy", h.cast("int").alias("h"), few.cast("int").alias("need"), "lx", "rx", "ly", "ry").distinct()


SPANS = "dx long, dy long, sx int, ex int, sy int, ey int, sure boolean"


def _spans(dx, dy, sx, ex, sy, ey, sure) -> pa.Table:
    i4 = lambda a: pa.array(np.asarray(a).astype(np.int32))
    return pa.table({"dx": pa.array(dx.view(np.int64)), "dy": pa.array(dy.view(np.int64)), "sx": i4(sx), "ex": i4(ex), "sy": i4(sy), "ey": i4(ey), "sure": pa.array(np.full(len(dx), sure))})


def join_intervals(links: DataFrame, cells: int) -> DataFrame:
    """By pair: equal stretches (sure, from links that want no hash function), and overlaps of windows of enough hash functions (to be verified).

    Spans are in tokens, ends exclusive. Links come sorted by their pair, so a task holds about ``LINKS_AT_ONCE`` of them, however many there are."""

    def some(k: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = []
        # equal windows: unions along one diagonal
        e = take(k, np.flatnonzero(k["need"] == 0))
        diag = e["ly"] - e["lx"]
        order = np.lexsort((e["lx"], diag, e["dy"], e["dx"]))
        e, diag = take(e, order), diag[order]
        m = len(order)
        sure: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if m:
            group = np.zeros(m, bool)
            group[0] = True
            group[1:] = (e["dx"][1:] != e["dx"][:-1]) | (e["dy"][1:] != e["dy"][:-1]) | (diag[1:] != diag[:-1])
            number = np.cumsum(group) - 1
            reach = e["rx"].astype(np.int64) + number * (1 << 32)
            before = np.maximum.accumulate(reach)
            new = group.copy()
            new[1:] |= e["lx"][1:] + number[1:] * (1 << 32) > before[:-1] + 1
            at = np.flatnonzero(new)
            sx, ex = e["lx"][at], np.maximum.reduceat(e["rx"], at) + 1
            out.append(_spans(e["dx"][at], e["dy"][at], sx, ex, sx + diag[at], ex + diag[at], True))
        # the rest: windows of a pair that overlap in both documents are one overlap
        u = take(k, np.flatnonzero(k["need"] > 0))
        u = take(u, np.lexsort([u[n] for n in ("ry", "rx", "ly", "lx", "dy", "dx")]))
        if m:
            both = np.isin(e["dx"][at] ^ mix(e["dy"][at]), u["dx"] ^ mix(u["dy"]))
            for a, b, s, f in zip(*(v[both].tolist() for v in (e["dx"][at], e["dy"][at], sx, ex))):
                sure.setdefault((a, b), []).append((s, f))
        asks: dict[tuple[int, int], list[list]] = {}
        for dx, dy, h, want, lx, rx, ly, ry in zip(*(u[n].tolist() for n in ("dx", "dy", "h", "need", "lx", "rx", "ly", "ry"))):
            if any(s <= lx and rx < f for s, f in sure.get((dx, dy), ())):
                continue
            mine = asks.setdefault((dx, dy), [])
            for old in mine[-4:]:
                if lx <= old[1] and old[0] <= rx + 1 and ly <= old[3] and old[2] <= ry + 1:
                    old[:] = [min(old[0], lx), max(old[1], rx + 1), min(old[2], ly), max(old[3], ry + 1), old[4] | {h}, min(old[5], want)]
                    break
            else:
                mine.append([lx, rx + 1, ly, ry + 1, {h}, want])
        flat = [(*p, *b[:4]) for p, boxes in asks.items() for b in boxes if len(b[4]) >= b[5]]
        if flat:
            dx, dy = (np.array([f[j] for f in flat], np.uint64) for j in (0, 1))
            out.append(_spans(dx, dy, *(np.array([f[j] for f in flat]) for j in (2, 3, 4, 5)), False))
        for table in out:
            yield from table.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def columns() -> dict[str, np.ndarray]:
            table = pa.Table.from_batches(held)
            return {n: np.asarray(table.column(n)).astype(kind) for n, kind in LINK}

        for part in batches:
            held.append(part)
            if sum(b.num_rows for b in held) > LINKS_AT_ONCE:
                k = columns()
                # more of the last pair may come next
                last = int(np.flatnonzero((k["dx"] == k["dx"][-1]) & (k["dy"] == k["dy"][-1]))[0])
                if last:
                    yield from some(take(k, slice(0, last)))
                    held = pa.Table.from_batches(held).slice(last).to_batches()
        if held:
            yield from some(columns())

    rows = links.select(*[n for n, _ in LINK]).repartition(cells, "dx", "dy").sortWithinPartitions("dx", "dy")
    return stream(rows, run, SPANS)


def _by_document(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Asks (dk, r with its number, start and end first) as lists by document, with its text: (dk, text, runs).

    A hot document is asked for by many: its asks are dealt into lists of about ``ASKS``."""
    parts = asked.groupBy("dk").agg(F.ceil(F.count("*") / F.lit(ASKS)).alias("parts")).where("parts > 1")
    asked = asked.join(parts, "dk", "left").withColumn("_part", F.pmod(F.xxhash64("r"), F.coalesce("parts", F.lit(1))))
    lists = asked.groupBy("dk", "_part").agg(F.collect_list("r").alias("runs"))
    return rows.join(lists, "dk").select("dk", "text", "runs")


def _cut(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (dk, text, runs) -> (batch, asks, document of each, shingle hashes, start and end of each ask in them)."""
    for part, buf, off in slices(batches, limit=SLICE):
        g, gd = tokens(buf, off, words)
        begin = np.searchsorted(gd, np.arange(part.num_rows), "left")
        lists = part.column(2)
        flat, doc = lists.flatten(), np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
        s, e = (begin[doc] + np.asarray(flat.field(k)).astype(np.int64) for k in (1, 2))
        yield part, flat, doc, g, s, e


def fetch_tokens(rows: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """Shingles of both sides of each asked overlap, by 32 bits of their hashes, which are compared within a pair only: (ask, side, dk, s, grams)."""
    side = lambda d, n, k: asked.select(F.col(d).alias("dk"), F.struct("ask", F.col("s" + n).alias("s"), F.col("e" + n).alias("e"), F.lit(k).alias("side")).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat, doc, g, s, e in _cut(batches, words):
            raw = (g >> U64(32)).astype(np.uint32).tobytes()
            grams = pa.array([raw[4 * x : 4 * y] for x, y in zip(s.tolist(), e.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([flat.field(0), flat.field(3), part.column(0).take(pa.array(doc)), flat.field(1), grams], names=["ask", "side", "dk", "s", "grams"])

    return stream(_by_document(side("dx", "x", 0).unionByName(side("dy", "y", 1)), rows), run, "ask long, side int, dk long, s int, grams binary")


def sides(g: np.ndarray, n: np.ndarray, c: np.ndarray, key: np.ndarray, w: np.ndarray, half: int) -> dict[str, np.ndarray]:
    """Distinct shingles of windows, given end to end, as hashes together with the window's key, and on which sides of its token within ``half`` they are.

    Bit 1 stands for the left, bit 2 for the right; a side that the window does not fill has none."""
    away = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n + c, n)
    side = ((away <= 0) & (away >= -half) & np.repeat(c >= half - 1, n)) * 1 + ((away >= 0) & (away <= half) & np.repeat(n - 1 - c >= half - 1, n)) * 2
    own, which = mix(g ^ np.repeat(mix(key), n)), np.repeat(np.arange(len(n)), n)
    order = np.lexsort((own, which))
    own, which, side = own[order], which[order], side[order]
    new = np.append(True, (own[1:] != own[:-1]) | (which[1:] != which[:-1]))[: len(own)]
    side = np.bitwise_or.reduceat(side, np.flatnonzero(new)) if len(own) else side
    return {"gram": own[new], "w": w[which[new]], "side": side.astype(np.uint8)}


def window_tokens(rows: DataFrame, windows: DataFrame, words: int, half: int, cells: int) -> DataFrame:
    """(cell, blob): ``sides`` of the shingles of each window, by cell."""
    asked = windows.select("dk", F.struct(F.col("w").alias("ask"), F.col("l").alias("s"), (F.col("r") + 1).alias("e"), "key", "c").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            k, b = by_cell({n: np.concatenate([x[n] for x in held]) for n, _ in GRAM}, GRAM, np.concatenate([x["gram"] for x in held]), cells)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.binary())], names=["cell", "blob"])

        for _, flat, doc, g, s, e in _cut(batches, words):
            n = e - s
            c = np.asarray(flat.field(4)).astype(np.int64) - np.asarray(flat.field(1)).astype(np.int64)  # from the window's start
            key, w = (np.asarray(flat.field(k)).astype(np.int64).view(np.uint64) for k in (3, 0))
            held.append(sides(g[_spread(s, n)], n, c, key, w, half))
            if sum(len(x["w"]) for x in held) > GRAMS_AT_ONCE:
                yield flush()
        if held:
            yield flush()

    return stream(_by_document(asked, rows), run, "cell int, blob binary")


def shared_grams(grams: DataFrame, cells: int) -> DataFrame:
    """Shingles that stand in several windows of a key, with their number, by cell of their windows."""

    def run(table: pa.Table) -> pa.Table:
        k = unpack(table.column("blob").to_pylist(), GRAM)
        k = take(k, np.argsort(k["gram"]))
        begin = np.flatnonzero(np.append(True, k["gram"][1:] != k["gram"][:-1])[: len(k["gram"])])
        n = np.diff(np.append(begin, len(k["gram"])))
        k["n"] = np.repeat(n, n)
        k = take(k, np.flatnonzero(k["n"] > 1))
        c, b = by_cell(k, COUNTED, k["w"], cells)
        return pa.table({"cell": pa.array(c, pa.int32()), "blob": pa.array(b, pa.binary())})

    return by_cells(grams, cells, run, "cell int, blob binary")


def rare_keys(shared: DataFrame, same: int, least: int, cells: int) -> DataFrame:
    """(w, _key): the rarest shared shingles on each side of a window, all but the last ``same`` less one, of windows that share ``least``."""

    def run(table: pa.Table) -> pa.Table:
        k = unpack(table.column("blob").to_pylist(), COUNTED)
        k = take(k, np.lexsort((k["gram"], k["n"], k["w"])))
        ws, keys = [], []
        _, which, n = np.unique(k["w"], return_inverse=True, return_counts=True)
        for bit in (1, 2):
            on = np.flatnonzero((k["side"] & bit > 0) & (n[which] >= least))
            w = which[on]
            total = np.bincount(w, minlength=len(n))
            on = on[np.arange(len(on)) - (np.cumsum(total) - total)[w] < total[w] - (same - 1)]
            ws.append(k["w"][on].view(np.int64))
            keys.append(mix(k["gram"][on] + U64(bit)).view(np.int64))
        return pa.table({"w": pa.array(np.concatenate(ws)), "_key": pa.array(np.concatenate(keys))})

    return by_cells(shared, cells, run, "w long, _key long")


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... n[k] times, for each k in turn."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)


class Meeting(NamedTuple):
    """Shingles that pairs have in common, one row for each shingle of a pair, its places in ``at`` from ``begin`` on, those of x first, in order."""

    m: int
    g: np.ndarray  # shingles of all pairs end to end, those of x first
    base: np.ndarray  # begin of each list in them
    at: np.ndarray
    pair: np.ndarray
    begin: np.ndarray
    of_x: np.ndarray
    of_y: np.ndarray
    twice: np.ndarray  # whether any shingle stands twice on a side, by pair


def meeting(x: list[np.ndarray], y: list[np.ndarray]) -> Meeting:
    """Sorted once for all that is asked of the pairs."""
    n = np.array([len(v) for v in [*x, *y]], np.int64)
    g = np.concatenate([*x, *y, np.zeros(0, np.uint32)]).astype(np.uint64)
    m = len(x)
    base = np.cumsum(n) - n
    z = np.zeros(0, np.int64)
    if not len(g):
        return Meeting(m, g, base, z, z, z, z, z, np.zeros(m, bool))
    at = np.arange(len(g)) - np.repeat(base, n)
    code = (np.repeat(np.tile(np.arange(m, dtype=np.uint64), 2), n) << U64(33)) | (g << U64(1)) | np.repeat(np.array([0, 1], np.uint64), [n[:m].sum(), n[m:].sum()])
    bits = int(n.max()).bit_length()
    # with its place in the number that is sorted, if there is room, nothing has to be looked up
    if m.bit_length() + 33 + bits <= 64:
        code = (code << U64(bits)) | at.astype(np.uint64)
        code.sort()
        at = (code & U64((1 << bits) - 1)).astype(np.int64)
        code >>= U64(bits)
    else:
        order = np.argsort(code, kind="stable")
        code, at = code[order], at[order]
    one = code >> U64(1)
    begin = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
    of_y = np.add.reduceat((code & U64(1)).astype(np.int64), begin)
    of_x = np.diff(np.append(begin, len(code))) - of_y
    pair = (one[begin] >> U64(32)).astype(np.int64)
    twice = np.zeros(m, bool)
    twice[pair[(of_x > 1) | (of_y > 1)]] = True
    both = (of_x > 0) & (of_y > 0)
    return Meeting(m, g, base, at, pair[both], begin[both], of_x[both], of_y[both], twice)


def _hits(met: Meeting, some: np.ndarray, last: bool = False) -> tuple[np.ndarray, ...]:
    """(pair, place in x, first or last place in y) of each shingle of x that also stands in its y, in order, for ``some`` of the pairs."""
    k = np.flatnonzero(some[met.pair])
    of_x, begin = met.of_x[k], met.begin[k]
    pair, at = np.repeat(met.pair[k], of_x), met.at[_spread(begin, of_x)]
    place = np.repeat(met.at[begin + of_x + (met.of_y[k] - 1 if last else 0)], of_x)
    order = np.argsort((pair << 32) | at)  # each is there once
    return pair[order], at[order], place[order]


def _similar(g: np.ndarray, base: np.ndarray, m: int, k: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Jaccard similarity of x[k][a:b] and y[k][c:d]."""
    part = np.arange(len(k))
    own = [(np.repeat(part, hi - lo), _spread(base[k + s * m] + lo, hi - lo)) for s, lo, hi in ((0, a, b), (1, c, d))]
    code = np.concatenate([(p.astype(np.uint64) << U64(33)) | (g[w] << U64(1)) | U64(s) for s, (p, w) in enumerate(own)])
    code.sort()
    code = code[np.append(True, code[1:] != code[:-1])]
    shared = (code[1:] ^ code[:-1]) == U64(1)
    shared &= (code[1:] & U64(1)) == U64(1)
    each = np.bincount((code >> U64(33)).astype(np.int64), minlength=len(k))
    twice = np.bincount((code[1:][shared] >> U64(33)).astype(np.int64), minlength=len(k))
    return twice / (each - twice)


def near_windows(x: list[np.ndarray], y: list[np.ndarray], t: int, threshold: float, found: tuple[np.ndarray, ...], met: Meeting | None = None) -> tuple[np.ndarray, ...]:
    """(k, a, b, c, d, sim): windows of exactly ``t`` tokens whose similarity reaches ``threshold`` outside the stretches ``found`` in x.

    A stretch begins and ends with common tokens; a passage that is changed at its edge, or that lies in a run too loose as a whole, is a window.
    Windows begin with a common token (or end with the text), here and at its first and its last place in y. Of those that begin
    in the same ``t`` tokens, the one with most common tokens is compared."""
    m, close = len(x), int(np.ceil(2 * t * threshold / (1 + threshold) - 1e-9))
    met = met or meeting(x, y)
    g, base = met.g, met.base
    out: list[tuple[np.ndarray, ...]] = []
    # a window holds so many common tokens
    inside = np.bincount(met.pair, met.of_x, minlength=m)
    length = np.diff(np.append(base, len(g)))
    # those inside found stretches are done
    cover = np.zeros(len(g) + 1, np.int64)
    np.add.at(cover, base[found[0]] + found[1], 1)
    np.add.at(cover, base[found[0]] + found[2], -1)
    cover = np.cumsum(cover)
    again = np.zeros(m, bool)
    again[met.pair[met.of_y > 1]] = True
    for last in (False, True):
        k, p, place = _hits(met, (inside >= close) & again if last else inside >= close, last)
        if not len(k):
            break
        open_ = cover[base[k] + p] == 0
        k, p, place = k[open_], p[open_], place[open_]
        s, v = np.minimum(p, length[k] - t), np.minimum(place, length[k + m] - t)
        some = np.flatnonzero((s >= 0) & (v >= 0))
        if not len(some):
            continue
        # common tokens in a row of x whose place keeps to the window in y
        wide = np.int64(1) << 32
        flat, rise = k * wide + p, np.maximum.accumulate(k * wide + place)
        s, v, kk = s[some], v[some], k[some]
        lo = np.maximum(np.searchsorted(flat, kk * wide + s), np.searchsorted(rise, kk * wide + v))
        hi = np.minimum(np.searchsorted(flat, kk * wide + s + t), np.searchsorted(rise, kk * wide + v + t))
        # where places fall back, the row counts as far as the window in x reaches
        fall = np.append(0, np.cumsum(np.append(False, (k[1:] == k[:-1]) & (np.diff(place) < 0))))[: len(k) + 1]
        end = np.searchsorted(flat, kk * wide + s + t)
        begin = np.searchsorted(flat, kk * wide + s)
        n = np.where(fall[end] > fall[begin], end - begin, hi - lo)
        enough = np.flatnonzero(n >= close)
        if not len(enough):
            continue
        s, v, kk, n = s[enough], v[enough], kk[enough], n[enough]
        best = np.lexsort((s, -n, s // t, kk))
        one = np.append(True, (kk[best][1:] != kk[best][:-1]) | (np.diff(s[best] // t) != 0))
        s, v, kk = (w[best[one]] for w in (s, v, kk))
        sim = _similar(g, base, m, kk, s, s + t, v, v + t)
        good = sim >= threshold
        out.append(tuple(w[good] for w in (kk, s, s + t, v, v + t, sim)))
    # where shingles come up again, a place says little: pairs without a passage so far are compared in full
    done = ~met.twice | (inside < threshold * t) | (length[:m] < t) | (length[m:] < t)
    for o in [found, *out]:
        done[o[0]] = True
    for k in np.flatnonzero(~done).tolist():
        out += [tuple(np.array([v]) for v in (k, *row)) for row in repeated_windows(x[k], y[k], t, threshold)]
    z = np.zeros(0, np.int64)
    return tuple(np.concatenate([o[j] for o in out]) if out else z for j in range(6))


def repeated_windows(x: np.ndarray, y: np.ndarray, t: int, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """(a, b, c, d, sim): every window of ``t`` tokens of x against every one of y, some at a time, whatever comes up again in them; the best one of each."""

    def held(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether the window that begins at each place of v holds each of u."""
        k = np.searchsorted(u, v)
        k[k == len(u)] = 0
        p = np.flatnonzero(u[k] == v)
        edge = np.zeros((len(u), len(v) + 1), np.int32)
        np.add.at(edge, (k[p], np.maximum(p - t + 1, 0)), 1)
        np.add.at(edge, (k[p], p + 1), -1)
        return (np.cumsum(edge, axis=1)[:, : len(v) - t + 1] > 0).astype(np.float32)

    def different(v: np.ndarray) -> np.ndarray:
        order = np.argsort(v, kind="stable")
        before = np.full(len(v), -1)
        same = np.flatnonzero(v[order][1:] == v[order][:-1])
        before[order[same + 1]] = order[same]
        return (np.lib.stride_tricks.sliding_window_view(before, t) < np.arange(len(v) - t + 1)[:, None]).sum(axis=1)

    out = []
    for i in range(0, len(x) - t + 1, 512):
        some, best = x[i : i + 511 + t], (0.0, 0, 0)
        for j in range(0, len(y) - t + 1, 2048):
            other = y[j : j + 2047 + t]
            u = np.intersect1d(some, other)
            if not len(u):
                continue
            common = held(u, some).T @ held(u, other)
            sim = common / (different(some)[:, None] + different(other)[None, :] - common)
            a, b = np.unravel_index(int(sim.argmax()), sim.shape)
            # exact: what comes from single precision is not compared with the threshold
            sx, sy = set(some[a : a + t].tolist()), set(other[b : b + t].tolist())
            best = max(best, (len(sx & sy) / len(sx | sy), i + int(a), j + int(b)))
        if best[0] >= threshold:
            out.append((best[1], best[1] + t, best[2], best[2] + t, best[0]))
    return out


def all_stretches(x: list[np.ndarray], y: list[np.ndarray], t: int, threshold: float, met: Meeting | None = None) -> tuple[np.ndarray, ...]:
    """(k, a, b, c, d, sim): the stretches x[k][a:b] and y[k][c:d] of each pair of 32-bit hashes, found for all pairs at once.

    A stretch is a run of tokens of x that also stand in y, short gaps closed, of ``t`` tokens and a Jaccard similarity of ``threshold``; one that is
    too loose is split at smaller gaps. Pairs with fewer shingles in common than any stretch needs are left out before."""
    z = np.zeros(0, np.int64)
    met = met or meeting(x, y)
    g, base, m = met.g, met.base, met.m
    pair, at, place = _hits(met, np.bincount(met.pair, minlength=m) >= int(np.ceil(t * threshold / (1 + threshold))))
    group, found, gap = pair, [], GAP
    while len(pair):
        new = np.append(True, (group[1:] != group[:-1]) | (np.diff(at) > gap) | (np.abs(np.diff(place)) > 4 * gap))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(pair)))
        k, a, b = pair[first], at[first], at[first + n - 1] + 1
        c, d = np.minimum.reduceat(place, first), np.maximum.reduceat(place, first) + 1
        long = np.maximum(b - a, d - c) >= t
        first, n, k, a, b, c, d = (v[long] for v in (first, n, k, a, b, c, d))
        if not len(first):
            break
        sim = _similar(g, base, m, k, a, b, c, d)
        good = sim >= threshold
        found.append(tuple(v[good] for v in (k, a, b, c, d, sim)))
        if gap == 1:
            break
        # a stretch that is too loose as a whole may hold tighter ones
        loose = np.flatnonzero(~good)
        keep = _spread(first[loose], n[loose])
        pair, at, place, group, gap = pair[keep], at[keep], place[keep], np.repeat(loose, n[loose]), gap // 2
    return tuple(np.concatenate([f[j] for f in found]) if found else z for j in range(6))


def passages(x: list[np.ndarray], y: list[np.ndarray], t: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Stretches of each pair, and windows outside them: (k, a, b, c, d, sim)."""
    met = meeting(x, y)
    found = all_stretches(x, y, t, threshold, met)
    return tuple(np.concatenate(v) for v in zip(found, near_windows(x, y, t, threshold, found, met)))


def verify(fetched: DataFrame, t: int, threshold: float, cells: int) -> DataFrame:
    """Passages of the asked overlaps. Rows come sorted by their ask, so a task holds about ``AT_ONCE`` shingles, however many are asked."""

    def some(table: pa.Table) -> pa.RecordBatch:
        """Those with both sides, x before y."""
        ask, side = np.asarray(table.column("ask")), np.asarray(table.column("side"))
        x = np.flatnonzero((ask[1:] == ask[:-1]) & (side[1:] == 1) & (side[:-1] == 0))
        grams = [np.frombuffer(v, np.uint32) for v in table.column("grams").to_pylist()]
        xs, ys = [grams[j] for j in x], [grams[j + 1] for j in x]
        k, a, b, c, d, sim = passages(xs, ys, t, threshold)
        dk, s = np.asarray(table.column("dk")), np.asarray(table.column("s")).astype(np.int64)
        k = x[k]
        i4 = lambda v: pa.array(v.astype(np.int32))
        columns = [pa.array(dk[k]), pa.array(dk[k + 1]), i4(s[k] + a), i4(s[k] + b), i4(s[k + 1] + c), i4(s[k + 1] + d), pa.array(sim.astype(np.float64))]
        return pa.RecordBatch.from_arrays(columns, names=["dx", "dy", "sx", "ex", "sy", "ey", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in batches:
            held.append(part)
            size += pa.compute.sum(pa.compute.binary_length(part.column(4))).as_py() or 0
            if size > 4 * AT_ONCE:
                table = pa.Table.from_batches(held).combine_chunks()
                # the other side of the last ask may come next
                ask = np.asarray(table.column("ask"))
                last = int(np.flatnonzero(ask == ask[-1])[0])
                if last:
                    yield some(table.slice(0, last))
                held, size = table.slice(last).to_batches(), 0
        if held:
            yield some(pa.Table.from_batches(held).combine_chunks())

    rows = fetched.select("ask", "side", "dk", "s", "grams").repartition(cells, "ask").sortWithinPartitions("ask", "side")
    return stream(rows, run, "dx long, dy long, sx int, ex int, sy int, ey int, sim double")


def _pairs(a: DataFrame, b: DataFrame, where: str = "true") -> DataFrame:
    """Windows of different documents under one key: (key, h, dx, lx, cx, rx, mx, dy, ly, cy, ry, my)."""
    columns = ["key", F.col("a.h").alias("h"), *[F.col(f"{t}.{n}").alias(m + s) for t, s in (("a", "x"), ("b", "y")) for n, m in (("dk", "d"), ("l", "l"), ("c", "c"), ("r", "r"), ("m", "m"))]]
    return a.alias("a").join(b.alias("b"), "key").where(F.col("a.dk") != F.col("b.dk")).where(where).select(*columns)


def rare_groups(windows: DataFrame, tokens: Callable[[DataFrame], DataFrame], t: int, least: int, cells: int) -> DataFrame:
    """Windows under new keys, shingles (``tokens`` gives their ``sides`` by cell), so that any two of one key meet again if ``t`` shingles around their token have ``least`` in common.

    Shingles that occur once in a group drop out, and so do windows with fewer than ``least`` others. The stretch of ``t`` reaches half
    its length to the left or to the right of the token, so all but ``t - least`` of that half are common. Of the shingles on a side
    that a window shares with others, from rare to frequent, all but the last ones of that number less one are its prefix: two
    windows with so many in common have one in both prefixes."""
    half = t // 2 + 1
    same = half - (t - least)
    named = stash(windows.withColumn("w", F.xxhash64("key", "dk", "l")))
    free(windows)
    windows = named
    keys = rare_keys(shared_grams(tokens(windows), cells), same, least, cells)
    out = stash(keys.join(windows.drop("key"), "w").drop("w").withColumnRenamed("_key", "key"))
    free(windows)
    return out


def near_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, words: int = 5, n_hashes: int = 4, need: int = 1, threshold: float = 0.8, cell_bytes: int = 16_000_000, all_pairs: int = 24) -> DataFrame:
    """One row for each two near passages, of equal windows those of the first document: doc_id, first_word, last_word, other_id, other_first, other_last, sim.

    Words are numbered from 0; last words are included. Documents that share an equal passage are linked through the first
    of them, which is the other document of their rows."""
    t = min_words - words + 1
    rows = row_keys(docs, id_col, text_col).withColumn("dk", F.xxhash64("id", "fp")).select("dk", "id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(8, -(-total // cell_bytes))
    # windows take more room than the links and shingles of the others, and few cells fall unevenly on as many partitions
    joined = stash(join_windows(find_windows(rows, words, t, n_hashes, 4 * cells), n_hashes, 4 * cells))

    def judge(met: DataFrame) -> DataFrame:
        spans = stash(join_intervals(met, cells))
        asked = spans.where(~F.col("sure")).withColumn("ask", F.xxhash64("dx", "dy", "sx", "sy", "ex", "ey"))
        checked = verify(fetch_tokens(rows, asked, words), t, threshold, cells)
        got = stash(spans.where("sure").select("dx", "dy", "sx", "ex", "sy", "ey", F.lit(1.0).alias("sim")).unionByName(checked))
        free(spans)
        return got

    windows = stash(window_rows(joined.where("kind = 0"), n_hashes))
    equal = link_rows(joined.where("kind = 1"))
    sizes = windows.groupBy("key").agg(F.count("*").alias("_all"))
    every = lambda w: _pairs(w, w, "a.dk > b.dk")
    pairs, held = every(windows.join(sizes.where(F.col("_all") <= all_pairs), "key")), [joined, windows]
    large = stash(windows.join(sizes.where(F.col("_all") > all_pairs), "key").drop("_all"))
    if large.isEmpty():
        held.append(large)
    else:
        held.append(rare_groups(large, lambda w: window_tokens(rows, w, words, t // 2 + 1, cells), t, int(np.ceil(2 * t * threshold / (1 + threshold) - 1e-9)), cells))
        pairs = pairs.unionByName(every(held[-1]))
    found = judge(links(pairs, need).unionByName(equal))
    free(*held)
    # a passage inside another one of the same two documents says nothing new
    spans = found.groupBy("dx", "dy").agg(F.collect_set(F.struct("sx", "ex", "sy", "ey", "sim")).alias("spans"))
    inside = lambda s, o: (o.sx <= s.sx) & (o.ex >= s.ex) & (o.sy <= s.sy) & (o.ey >= s.ey) & (F.struct(o.sx, o.ex, o.sy, o.ey) != F.struct(s.sx, s.ex, s.sy, s.ey))
    kept = spans.select("dx", "dy", F.explode(F.filter("spans", lambda s: ~F.exists("spans", lambda o: inside(s, o)))).alias("s")).select("dx", "dy", "s.*")
    names = rows.select("dk", "id").distinct()
    x, y = names.select(F.col("dk").alias("dx"), F.col("id").alias("doc_id")), names.select(F.col("dk").alias("dy"), F.col("id").alias("other_id"))
    last = lambda c: (F.col(c) + F.lit(words - 2)).alias
    return kept.join(x, "dx").join(y, "dy").select(
        "doc_id", F.col("sx").alias("first_word"), last("ex")("last_word"), "other_id", F.col("sy").alias("other_first"), last("ey")("other_last"), "sim"
    )
