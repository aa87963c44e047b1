"""Exact substring dedup by classes of equal strings in suffix order, over the repeated parts of a corpus.

The classes stand in for longest-previous-factor arrays, of which removal only needs whether a factor reaches ``length``.

A byte is removed if a string of ``length`` bytes that covers it also starts elsewhere: anywhere else
(``keep="none"``), or anywhere earlier in order of (id, offset) (``keep="first"``). A suffix array of all
text would be sorted mostly to tell unrelated text apart, so suffixes are sorted only where a repeat is
possible, and nothing that could match is left out:

1. Every string of ``length`` bytes names as its anchor the ``gram``-byte string inside it with the
   smallest hash (the leftmost of equal ones). Equal strings have equal anchors at equal offsets. The
   strings of one anchor are consecutive: a run. Runs are keyed by the hash of the anchor.
2. Runs whose whole contexts (the bytes of all their strings) are equal are repeats of each other. They meet by the hash of anchor
   and context, so a hot anchor is dealt by its contexts, and a task collapses its own equal contexts before the shuffle. The
   contexts left are then counted by anchor, with partial counts before that shuffle.
3. Where one anchor has several different contexts, their bytes are fetched, and a suffix array over
   them, by prefix doubling to ``length`` bytes, puts equal strings next to each other with ascending
   positions: the previous and next smaller positions within such a class are the neighbours, so the longest previous factor
   reaches ``length`` exactly where a class has an earlier member. An anchor with many different contexts is
   split by longer shared blocks around it (each string then belongs to one block), so no task gets it whole; equal
   blocks of one task are sent once.

Equality of anchors and contexts is by 64-bit hashes; equality in step 3 is by bytes. Removed spans are unions over
the input as it is, not over what is left.

Edge cases: null and empty texts, and texts shorter than ``length``, lose nothing; matches never cross
texts; overlapping repeats inside one text count; repeated ids and equal rows are texts like any
other; with ``keep="first"`` equal rows of one id count as one text; ids that are no integers raise; an empty table gives no rows. A text and 60 times its bytes must fit
a task's memory; everything else is cut into slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import U64, mix, powers, prefix_hash, range_hash, row_keys, slices, stash

RUN = np.dtype([("ah", "<u8"), ("ch", "<u8"), ("id", "<i8"), ("fp", "<i8"), ("s", "<i4"), ("e", "<i4"), ("q", "<i4"), ("dup", "<i4")])
CONTEXT = np.dtype([("key", "<u8"), ("id", "<i8"), ("fp", "<i8"), ("s", "<i4"), ("n", "<i4"), ("dup", "<i4")])
MARKS = "id long, fp long, s int, e int, q int, level int"
NO_ID = np.iinfo(np.int64).max
#: Bytes of contexts that are suffix-sorted at once; a single anchor's contexts may be more.
SORT_BYTES = 1_000_000


def anchor_runs(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, hash of the anchor, hash of the context) of each run."""
    n, w = len(buf), length - gram + 1
    z = np.zeros(0, np.int64)
    if n < length or (np.diff(off) < length).all():
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64)
    c = prefix_hash(buf)
    grams = mix((c[gram:] - c[: n - gram + 1]) * powers(n)[1][: n - gram + 1])
    bits = U64(max(24, int(n).bit_length()))
    m = ((grams >> bits) << bits) | np.arange(n - gram + 1, dtype=np.uint64)
    k = 1
    while k * 2 <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    if k < w:
        m = np.minimum(m[: len(m) - (w - k)], m[w - k :])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    p = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
    a = (m[p] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    first = np.ones(len(p), bool)
    first[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1) | (doc[p[1:]] != doc[p[:-1]])
    b = np.flatnonzero(first)
    s, e, q = p[b], p[np.append(b[1:], len(p)) - 1], a[b]
    return doc[s], s, e, q, grams[q], range_hash(c, s, e + length) ^ mix((q - s).astype(np.uint64))


def _classes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each class in that order) for rows sorted by the keys, the first key leading."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


def _collapse(runs: np.ndarray, keep: str) -> tuple[np.ndarray, np.ndarray]:
    """(one run of each context, the runs that repeat a context)."""
    runs = runs[np.lexsort((runs["s"], runs["fp"], runs["id"], runs["ch"], runs["ah"]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs["ah"][1:] != runs["ah"][:-1]) | (runs["ch"][1:] != runs["ch"][:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(runs)))
    again = np.maximum.reduceat(runs["dup"], at) if len(at) else np.zeros(0, np.int32)
    hit = (np.repeat(size, size) > 1) & (~new if keep == "first" else runs["dup"] == 0)
    marks = runs[hit]
    one = runs[at].copy()
    one["dup"] = np.maximum(again, size > 1)
    return one, marks


def _table(r: np.ndarray, end: np.ndarray, q: np.ndarray | None = None, level: np.ndarray | None = None) -> pa.RecordBatch:
    ids = pa.array(r["id"], mask=r["id"] == NO_ID) if len(r) else pa.array(r["id"])
    none = np.full(len(r), -1, np.int32)
    return pa.RecordBatch.from_arrays([ids, pa.array(r["fp"]), pa.array(r["s"].astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(none if q is None else q.astype(np.int32)), pa.array(none if level is None else level.astype(np.int32))], names=["id", "fp", "s", "e", "q", "level"])


def _blobs(records: np.ndarray, key: np.ndarray, cells: int, extra: list | None = None) -> tuple[list[int], list[bytes]]:
    cell = (key % U64(cells)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    edges = np.searchsorted(cell[order], np.arange(cells + 1))
    out = [(k, records[order[a:b]].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
    return [k for k, _ in out], [b for _, b in out]


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NO_ID)).astype(np.int64)


def find_runs(rows: DataFrame, length: int, gram: int, cells: int, keep: str) -> DataFrame:
    """(id, fp, text) -> (cell, kind, blob): kind 0 runs, kind 1 spans known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            one, marks = _collapse(np.concatenate(held), keep)
            if keep == "none":  # the run that stays is a repeat too
                marks = np.concatenate([marks, one[(one["dup"] > 0)]])
                marks = marks[np.lexsort((marks["s"], marks["fp"], marks["id"]))]
            k, b = _blobs(one, mix(one["ah"] ^ one["ch"]), cells)
            k2, b2 = _blobs(marks, mix(marks["fp"].view(np.uint64) if len(marks) else one["ah"][:0]), cells)
            yield pa.RecordBatch.from_arrays([pa.array(k + k2, pa.int32()), pa.array([0] * len(k) + [1] * len(k2), pa.int32()), pa.array(b + b2, pa.binary())], names=["cell", "kind", "blob"])

        for part, buf, off in slices(batches):
            doc, s, e, q, ah, ch = anchor_runs(buf, off, length, gram)
            if not len(doc):
                continue
            r = np.zeros(len(doc), RUN)
            r["ah"], r["ch"], r["id"], r["fp"] = ah, ch, _ids(part.column(0))[doc], np.asarray(part.column(1))[doc]
            r["s"], r["e"], r["q"] = s - off[doc], e - off[doc], q - off[doc]
            held.append(r)
            size += len(r)
            if size > 250_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, "cell int, kind int, blob binary")


def match_runs(found: DataFrame, length: int, keep: str, cells: int) -> DataFrame:
    """Spans that repeat (level -1), and one run of each context of each anchor (level 1 if it is met again, else 0)."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        known = np.frombuffer(b"".join(b for k, b in zip(kinds, blobs) if k == 1), RUN)
        runs = np.frombuffer(b"".join(b for k, b in zip(kinds, blobs) if k == 0), RUN)
        one, marks = _collapse(runs, keep) if len(runs) else (runs, runs)
        if keep == "none":
            marks = np.concatenate([marks, one[one["dup"] > 0]])
        out = [_table(known, known["e"] + length), _table(marks, marks["e"] + length), _table(one, one["e"], one["q"], one["dup"])]
        anchors = [pa.array(np.zeros(len(known) + len(marks), np.int64)), pa.array(one["ah"].view(np.int64) if len(one) else np.zeros(0, np.int64))]
        return pa.Table.from_batches(out).append_column("anchor", pa.chunked_array(anchors))

    # as many partitions as cells, whose number follows the bytes: a task's share stays the same at any size
    return found.repartition(cells, "cell").groupBy("cell").applyInArrow(run, MARKS + ", anchor long")


def ask_contexts(contexts: DataFrame, split: int) -> DataFrame:
    """(id, fp, s, e, q, level) of the runs whose anchor has other contexts; the level grows with their number, and is odd for runs met again."""
    sizes = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / split))).cast("int") * 2 + F.col("level")
    return contexts.join(sizes, "anchor").select("id", "fp", "s", "e", "q", level.cast("int").alias("level"))


def fetch_contexts(rows: DataFrame, asked: DataFrame, length: int, gram: int, cells: int, keep: str) -> DataFrame:
    """(id, fp, text) with the asked runs of each -> (cell, kind, blob of contexts, blob of their bytes): kind 0 to compare,
    kind 1 repeats of another that the task sent, without bytes."""
    asked = asked.groupBy("id", "fp").agg(F.sort_array(F.collect_list(F.struct("s", "e", "q", "level"))).alias("runs"))
    asked = asked.select(F.col("id").alias("_id"), F.col("fp").alias("_fp"), "runs")
    rows = rows.join(asked, rows["id"].eqNullSafe(asked["_id"]) & (rows["fp"] == asked["_fp"])).select("id", "fp", "text", "runs")
    w = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in slices(batches):
            lists = part.column(3)
            n = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            s, e, q, level = (np.asarray(flat.field(k)).astype(np.int64) for k in range(4))
            doc = np.repeat(np.arange(part.num_rows), n)
            dup, level = level & 1, np.minimum(level >> 1, int(w).bit_length())
            c = prefix_hash(buf)
            base, ids, fps = off[doc], _ids(part.column(0))[doc], np.asarray(part.column(1))[doc]
            recs, starts = [], []
            for lv in np.unique(level):
                of = level == lv
                step = -(-w // (1 << int(lv)))
                for lo in range(0, w, step):
                    hi = min(w - 1, lo + step - 1)  # strings that start lo..hi bytes before the anchor
                    a = np.maximum(s[of], q[of] - hi)
                    b = np.minimum(e[of], q[of] - lo)
                    ok = a <= b
                    at = base[of][ok]
                    r = np.zeros(int(ok.sum()), CONTEXT)
                    r["key"] = range_hash(c, at + q[of][ok] - lo, at + q[of][ok] - hi + length) + U64(lo * 1000 + hi)
                    r["id"], r["fp"], r["s"], r["n"], r["dup"] = ids[of][ok], fps[of][ok], a[ok], (b - a)[ok] + length, dup[of][ok]
                    recs.append(r)
                    starts.append(at + a[ok])
            recs, starts = np.concatenate(recs), np.concatenate(starts)
            whole = range_hash(c, starts, starts + recs["n"])
            order = np.lexsort((recs["s"], recs["fp"], recs["id"], whole, recs["key"]))
            recs, starts, whole = recs[order], starts[order], whole[order]
            new = np.ones(len(recs), bool)
            new[1:] = (recs["key"][1:] != recs["key"][:-1]) | (whole[1:] != whole[:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(recs)))
            known = recs[(np.repeat(size, size) > 1) if keep == "none" else ~new]
            recs, starts = recs[new], starts[new]
            k2, b2 = _blobs(known, mix(known["fp"].astype(np.uint64)), cells)
            cell = (mix(recs["key"]) % U64(cells)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            edges = np.searchsorted(cell[order], np.arange(cells + 1))
            raw = buf.tobytes()
            names, a, b = [], [], []
            for k in range(cells):
                if edges[k] < edges[k + 1]:
                    o = order[edges[k] : edges[k + 1]]
                    names.append(k)
                    a.append(recs[o].tobytes())
                    b.append(b"".join([raw[x : x + m] for x, m in zip(starts[o].tolist(), recs["n"][o].tolist())]))
            kinds = [0] * len(names) + [1] * len(k2)
            yield pa.RecordBatch.from_arrays([pa.array(names + k2, pa.int32()), pa.array(kinds, pa.int32()), pa.array(a + b2, pa.binary()), pa.array(b + [b""] * len(k2), pa.binary())], names=["cell", "kind", "heads", "bytes"])

    return rows.mapInArrow(run, "cell int, kind int, heads binary, bytes binary")


def factor_classes(buf: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, first of each class) of the strings of ``length`` bytes at ``at`` (ascending).

    Prefix doubling over all positions: the rank of a block is the rank of its two halves; blocks of
    ``length`` are two overlapping blocks of the largest power of two. Equal strings form a class in
    which positions ascend, so neighbours are the previous and next smaller positions."""
    n = len(buf)
    pad = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank |= pad[k : k + n] << U64(56 - 8 * k)
    size = 8
    if length < 8:
        rank >>= U64(64 - 8 * length)
        order = np.argsort(rank[at], kind="stable")
        r = rank[at][order]
        return order, np.append(True, r[1:] != r[:-1])[: len(r)]

    def dense(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x)
        y = x[order]
        out = np.empty(n, np.uint64)
        out[order] = np.concatenate([[0], np.cumsum(y[1:] != y[:-1])]).astype(np.uint64)
        return out

    rank = dense(rank)
    while size * 2 <= length:
        rank = dense((rank << U64(32)) | np.append(rank[size:], np.zeros(min(size, n), np.uint64))[:n])
        size *= 2
    key = (rank[at] << U64(32)) | rank[at + length - size]
    order = np.argsort(key, kind="stable")
    r = key[order]
    new = np.ones(len(r), bool)
    new[1:] = r[1:] != r[:-1]
    return order, new


def match_contexts(contexts: DataFrame, length: int, keep: str, cells: int) -> DataFrame:
    """By block: spans whose strings also start in another context or elsewhere in the same."""

    def group(heads: np.ndarray, raw: bytes, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        # parts of different runs may be equal: they repeat each other whole, and the first stands for them below
        seen: dict[tuple[int, bytes], int] = {}
        use, again = [], []
        for k, (key, b, n) in enumerate(zip(heads["key"].tolist(), begins.tolist(), heads["n"].tolist())):
            first = seen.setdefault((key, raw[b : b + n]), k)
            if first == k:
                use.append(k)
            else:
                again.append(k)
                if keep == "none":
                    again.append(first)
        if again:
            r = heads[np.unique(again)]
            yield _table(r, r["s"] + r["n"])
        use = np.array(use)
        h, b = heads[use], begins[use]
        buf = np.frombuffer(b"".join([raw[x : x + m] for x, m in zip(b.tolist(), h["n"].tolist())]), np.uint8)
        edge = np.concatenate([[0], np.cumsum(h["n"].astype(np.int64))])
        room = h["n"].astype(np.int64) - length + 1
        which = np.repeat(np.arange(len(h)), room)
        at = np.repeat(edge[:-1], room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        order, new = factor_classes(buf, at, length)
        # a class holds strings of one block only: equal strings have equal blocks
        last = np.append(new[1:], True)
        hit = ~new if keep == "first" else ~(new & last)
        take = np.zeros(len(at), bool)
        take[order] = hit
        cut = np.ones(len(at), bool)
        cut[1:] = (which[1:] != which[:-1]) | (take[1:] != take[:-1])
        i = np.flatnonzero(cut)
        j = np.append(i[1:], len(at)) - 1
        i, j = i[take[i]], j[take[i]]
        r = h[which[i]].copy()
        r["s"] += (at[i] - edge[which[i]]).astype(np.int32)
        yield _table(r, r["s"] + (at[j] - at[i]) + length)

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("heads").to_pylist()
        known = np.frombuffer(b"".join(b for k, b in zip(kinds, blobs) if k == 1), CONTEXT)
        heads = np.frombuffer(b"".join(b for k, b in zip(kinds, blobs) if k == 0), CONTEXT)
        raw = b"".join(table.column("bytes").to_pylist())
        begins = np.cumsum(heads["n"].astype(np.int64)) - heads["n"]
        order = np.lexsort((heads["s"], heads["fp"], heads["id"], heads["key"]))
        heads, begins = heads[order], begins[order]
        at = np.flatnonzero(np.append(True, heads["key"][1:] != heads["key"][:-1])) if len(heads) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(heads))
        total = np.cumsum(heads["n"].astype(np.int64))
        out = [_table(known, known["s"] + known["n"])]
        k = 0
        while k < len(at):
            most = total[at[k]] - heads["n"][at[k]] + SORT_BYTES
            m = max(k + 1, int(np.searchsorted(total[ends - 1], most, "right")))
            out += group(heads[at[k] : ends[m - 1]], raw, begins[at[k] : ends[m - 1]])
            k = m
        return pa.Table.from_batches(out)

    return contexts.repartition(cells, "cell").groupBy("cell").applyInArrow(run, MARKS)


def repeated_spans(rows: DataFrame, length: int = 400, gram: int = 128, keep: str = "none", split: int = 4000, cell_bytes: int = 24_000_000) -> DataFrame:
    """(id, fp, text) -> (id, fp, spans): byte ranges to remove from each text that has any, maybe overlapping."""
    if keep not in ("none", "first") or not 8 <= gram <= length:
        raise ValueError("keep is none or first, and 8 <= gram <= length")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(8, -(-total // cell_bytes))
    found = find_runs(rows, length, gram, cells, keep)
    first = stash(match_runs(found, length, keep, cells))
    asked = ask_contexts(first.where("level >= 0"), split)
    second = match_contexts(fetch_contexts(rows, asked, length, gram, cells, keep), length, keep, cells)
    marks = first.where("level < 0").select("id", "fp", "s", "e").unionByName(second.select("id", "fp", "s", "e"))
    return marks.groupBy("id", "fp").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep: str = "none", **options) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte ranges), kept (the remaining bytes)."""
    rows = row_keys(docs, id_col, text_col)
    spans = repeated_spans(rows, length, keep=keep, **options).withColumnsRenamed({"id": "_id", "fp": "_fp"})
    rows = rows.join(spans, rows["id"].eqNullSafe(spans["_id"]) & (rows["fp"] == spans["_fp"]), "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in slices(batches):
            raw, texts, edges = buf.tobytes(), [], off.tolist()
            unions = []
            for k, spans in enumerate(part.column(2).to_pylist()):
                union: list[list[int]] = []
                for a, b in sorted((x["s"], x["e"]) for x in spans or ()):
                    if union and a <= union[-1][1]:
                        union[-1][1] = max(union[-1][1], b)
                    else:
                        union.append([a, b])
                text, at, left = raw[edges[k] : edges[k + 1]], 0, []
                for a, b in union:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                texts.append(b"".join(left))
                unions.append([{"s": a, "e": b} for a, b in union])
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(unions, kind), pa.array(texts, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<s:int,e:int>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    gone = F.aggregate("spans", F.lit(0), lambda a, x: a + x["e"] - x["s"]).cast("long")
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


