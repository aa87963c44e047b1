"""Classes of near-duplicate passages: one row for each passage that comes up again in another document.

Windows are those of ``passage_dedup``; those of equal content are linked to the first document that has it, and in a row where
one document has several. The different contents of a
token stand with their shingles in one task, which links as many of them as their classes need (``near_links``): round after round some
windows of each token, of the smallest classes there, meet all windows outside their class, so every two windows of a token meet
unless links connect them already. The links of a token are fewer than its windows, and families of edited copies are connected after a
few rounds. Before that, windows drop out that share too few shingles with the others of their token (a repeated line in unlike
surroundings), and those that have no rare shingle in common, over others too, need not meet.

Tokens with more than ``most`` contents meet again by rare shingles (``passage_dedup.rare_groups``), and a rare shingle with more of them is dealt into
blocks of which every two meet in one task. A task holds ``most`` windows at any size; the number of blocks that meet grows with the square of a
family of over ``most`` edited copies under one shingle.

Spans of a document that overlap are one passage, which may hold some different words at its edges where the threshold allows it; passages that links connect, over others too, are one class. No two documents that
``passage_dedup.near_passages`` would pair at a passage of one window are in different classes there.

Edge cases: as in ``passage_dedup``; where a document repeats a passage that is in another one, each place is a passage of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._shared import U64, free, row_keys, stash
from .passage_dedup import AT_ONCE, GRAM, _by_document, _cut, _spread, by_cell, find_windows, join_intervals, join_windows, link_rows, passages, rare_groups, sides, stream, window_rows

PAIRS_AT_ONCE = 50_000  # windows that a task compares in a round beyond one of each token
SPANS = "dx long, dy long, sx int, ex int, sy int, ey int"
WINDOWS = "key long, large boolean, dk long, l int, c int, grams binary"


def _begins(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])[: len(sorted_values)])


class Shared:
    """Shingles of windows that other windows of their group may have too."""

    def __init__(self, group: np.ndarray, c: np.ndarray, g: np.ndarray, n: np.ndarray, t: int, threshold: float):
        m = len(n)
        w = np.repeat(np.arange(m), n)
        code = (group[w].astype(np.uint64) << U64(32)) | g
        order = np.argsort(code, kind="stable")
        code, one = code[order], w[order]
        new = np.append(True, code[1:] != code[:-1])
        self.size = int(new.sum())
        gram = np.cumsum(new) - 1
        #: by distance from the token the number of each shingle, which is one in a group; what is no shingle has the last one
        self.rows = np.full((m, 2 * t - 1), self.size, np.int32)
        self.rows[one, (t - 1 - c)[one] + (order - (np.cumsum(n) - n)[one])] = gram
        again = np.append(False, ~new[1:] & (one[1:] == one[:-1]))
        self.again = np.bincount(one[again], minlength=m)  # shingles of a window that came up before in it
        #: places of the shingle before that is the same, by distance from the token
        self.before = np.full(self.rows.shape, -1, np.int8)
        at = (t - 1 - c)[one] + (order - (np.cumsum(n) - n)[one])
        self.before[one[again], at[again]] = at[np.flatnonzero(again) - 1]
        self.first = self.before < 0
        gram, one = gram[~again], one[~again]
        # any that is near to t shingles in a row has so many different ones of them
        self.need = np.full(m, threshold * t - 1e-9)
        for k in np.array_split(np.flatnonzero((self.again > 0) & (n >= t)), m // 2048 + 1):
            self.need[k] = threshold * self.different(k, t).min(axis=1, initial=t) - 1e-9
        self.alive = n >= t
        while True:
            number = np.bincount(gram[self.alive[one]], minlength=self.size)
            now = self.alive & (np.bincount(one[number[gram] > 1], minlength=m) >= self.need)
            if (now == self.alive).all():
                break
            self.alive = now
        # two that have so many in common share one of the rarest of each beyond that number
        some = self.alive[one] & (number[gram] > 1)
        gram, one = gram[some], one[some]
        order = np.lexsort((gram, number[gram], one))
        gram, one = gram[order], one[order]
        many = np.bincount(one, minlength=m)
        some = np.arange(len(one)) - (np.cumsum(many) - many)[one] <= many[one] - np.ceil(self.need)[one]
        gram, one = gram[some], one[some]
        #: windows that such shingles connect, others need not meet
        self.part = np.arange(m)
        while True:
            low = np.full(self.size, m)
            np.minimum.at(low, gram, self.part[one])
            now = self.part.copy()
            np.minimum.at(now, one, low[gram])
            now = now[now]
            if (now == self.part).all():
                break
            self.part = now
        self.alive &= np.bincount(self.part, minlength=m)[self.part] > 1

    def different(self, x: np.ndarray, t: int, hit: np.ndarray | None = None) -> np.ndarray:
        """By window and begin the number of different ones of t shingles in a row, or of those in ``hit``; t where there are not so many shingles."""
        new = np.lib.stride_tricks.sliding_window_view(self.before[x], t, axis=1) < np.arange(t, dtype=np.int8)[None, :, None]
        if hit is not None:
            new &= np.lib.stride_tricks.sliding_window_view(hit, t, axis=1)
        return np.where(_held(self.rows[x] < self.size, t)[1] == t, new.sum(axis=2, dtype=np.uint8), t)

    def near(self, hit: np.ndarray, x: np.ndarray, y: np.ndarray, t: int, threshold: float) -> np.ndarray:
        """Whether x has t shingles in a row of which enough different ones are in y; ``hit`` says which are."""
        some = np.count_nonzero(hit & self.first[x], axis=1) >= np.maximum(self.need[x], self.need[y])
        k = np.flatnonzero(some)
        some[k] = _held(hit[k], t)[1].max(axis=1, initial=0) + self.again[x[k]] >= threshold * t - 1e-9
        k = k[some[k] & (self.again[x[k]] > 0)]
        for k in np.array_split(k, -(-len(k) // 2048)) if len(k) else ():
            both, all_ = self.different(x[k], t, hit[k]), self.different(x[k], t)
            some[k] = ((both >= threshold * all_ - 1e-9) & (_held(self.rows[x[k]] < self.size, t)[1] == t)).any(axis=1)
        return some


def _held(hit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(running sums, sums of t in a row) of rows of 2t - 1."""
    total = np.zeros((len(hit), 2 * t), np.int16)
    np.cumsum(hit, axis=1, out=total[:, 1:])
    return total, total[:, t:] - total[:, :t]


def _aligned(shared: Shared, c: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, t: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which pairs, begin, end from the token) where windows laid on each other at their token are near around it.

    Of shingles that are equal there, all but those that came up before are different ones, which gives a least similarity."""
    same = shared.rows[x]
    same = (same == shared.rows[y]) & (same < shared.size)
    total, held = _held(same, t)  # by begin of t tokens that hold the token
    lo, hi = np.maximum(t - 1 - c[x], t - 1 - c[y]), np.minimum(t - 1 - c[x] + n[x], t - 1 - c[y] + n[y])
    begins = np.arange(t)[None, :]
    held[(begins < lo[:, None]) | (begins + t > hi[:, None])] = 0
    less = np.minimum(shared.again[x], shared.again[y])
    near = (held - less[:, None]) * (1 - threshold) >= 2 * threshold * (t - held) - 1e-9
    good = np.flatnonzero(near.any(axis=1))
    # from the first of those to the last, and all that is common, if that is near as a whole
    s, e = near[good].argmax(axis=1), 2 * t - 1 - near[good][:, ::-1].argmax(axis=1)
    # without what is not common at its edges, unless it is too short then
    places = np.arange(2 * t - 1)[None, :]
    inside = same[good] & (places >= s[:, None]) & (places < e[:, None])
    a, b = inside.argmax(axis=1), 2 * t - 1 - inside[:, ::-1].argmax(axis=1)
    s, e = np.where(b - a >= t, a, s), np.where(b - a >= t, b, e)
    a, b = same[good].argmax(axis=1), 2 * t - 1 - same[good][:, ::-1].argmax(axis=1)
    whole = (total[good, -1] - less[good]) * (1 - threshold) >= 2 * threshold * (b - a - total[good, -1]) - 1e-9
    return good, np.where(whole, np.minimum(a, s), s) - (t - 1), np.where(whole, np.maximum(b, e), e) - (t - 1)


def _forest(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels after the classes of x and y became one, pair by pair, pairs that are enough for it)."""
    kept = []
    while True:
        at = np.flatnonzero(label[x] != label[y])
        if not len(at):
            return label, np.concatenate([*kept, at])
        at = at[np.unique(label[x[at]], return_index=True)[1]]
        kept.append(at)
        x1, y1 = x[at], y[at]
        while (label[x1] != label[y1]).any():
            to = np.arange(len(label))
            np.minimum.at(to, np.maximum(label[x1], label[y1]), np.minimum(label[x1], label[y1]))
            while (to[to] != to).any():
                to = to[to]
            label = to[label]


def near_links(group: np.ndarray, dk: np.ndarray, c: np.ndarray, g: np.ndarray, n: np.ndarray, t: int, threshold: float) -> tuple[np.ndarray, ...]:
    """(x, y, a, b, c, d): windows of a group whose passages x[a:b] and y[c:d] are one class, enough to connect all that are near around their token.

    Windows come sorted by group: their document, the place of the token in them, their shingles end to end and the number of these.
    A window has one passage around its token, all in it that is near to any other that it met."""
    z = np.zeros(0, np.int64)
    m = len(n)
    if not m:
        return (z,) * 6
    shared = Shared(np.cumsum(np.append(False, group[1:] != group[:-1])), c, g, n, t, threshold)
    # only those that can be near, by the parts of their groups
    all_ = np.flatnonzero(shared.alive)
    all_ = all_[np.argsort(shared.part[all_], kind="stable")]
    number = np.unique(shared.part[all_], return_inverse=True)[1]
    g, dk, c, n, m = g[_spread((np.cumsum(n) - n)[all_], n[all_])], dk[all_], c[all_], n[all_], len(all_)
    if not m:
        return (z,) * 6
    shared = Shared(number, c, g, n, t, threshold)
    base = np.cumsum(n) - n
    own = lambda v: [g[base[k] : base[k] + n[k]] for k in v.tolist()]
    label, short = np.arange(m), n < t + t // 2
    in_hub = np.zeros(shared.size + 1, bool)
    left = np.flatnonzero(shared.alive)  # those that have not met all others yet
    begin_at, end_at = c.copy(), c.copy()
    trees, out, turn = [], [], 0
    while len(left):
        # first the smallest classes; more and more at once, so that large groups take few rounds
        order = left[np.lexsort((left, short[left], np.bincount(label, minlength=m)[label[left]], number[left]))]
        begin = _begins(number[order])
        size = np.diff(np.append(begin, len(order)))
        place = np.arange(len(order)) - np.repeat(begin, size)
        met, going = [], np.zeros(number[-1] + 1, bool)
        once = max(1, min(2 ** max(0, turn - 2), PAIRS_AT_ONCE // len(order)))
        for rank in range(min(once, int(size.max()))):
            begin, size = begin[size > rank], size[size > rank]
            hubs = order[begin + rank]
            y, x = np.repeat(hubs, size - rank - 1), order[_spread(begin + rank + 1, size - rank - 1)]
            some = label[x] != label[y]
            x, y = x[some], y[some]
            # a group is done when all that is left in it is one class, which its first hub tells
            if not rank:
                going[number[x]] = True
            some = dk[x] != dk[y]
            x, y = x[some], y[some]
            # a stretch of t that is near to any in the hub has all but so few shingles in common with it
            in_hub[shared.rows[hubs]] = True
            in_hub[-1] = False
            for at in np.array_split(np.arange(len(x)), len(x) // 8192 + 1):
                at = at[shared.near(in_hub[shared.rows[x[at]]], x[at], y[at], t, threshold)]
                met.append((x[at], y[at]))
            in_hub[shared.rows[hubs]] = False
        left = order[(place >= once) & going[number[order]]]
        turn += 1
        x, y = (np.concatenate(v) for v in zip(*met))
        found, rest = [], []
        for at in np.array_split(np.arange(len(x)), len(x) // 8192 + 1):
            good, a, b = _aligned(shared, c, n, x[at], y[at], t, threshold)
            fx, fy = x[at][good], y[at][good]
            found.append((fx, fy, a + c[fx], b + c[fx], a + c[fy], b + c[fy]))
            rest.append(np.delete(at, good))
        rest = np.concatenate(rest)
        # those with repeats take long: the hub's shingles have to be in the window too
        odd = np.flatnonzero(shared.again[x[rest]] + shared.again[y[rest]] > 0)
        less = []
        for k in np.array_split(odd, len(odd) // 512 + 1):
            hit = ((shared.rows[y[rest[k]]][:, :, None] == shared.rows[x[rest[k]]][:, None, :]).any(axis=2)) & (shared.rows[y[rest[k]]] < shared.size)
            less.append(k[~shared.near(hit, y[rest[k]], x[rest[k]], t, threshold)])
        rest = np.delete(rest, np.concatenate(less))
        for at in np.split(rest, np.flatnonzero(np.diff(np.cumsum(n[x[rest]] + n[y[rest]]) // AT_ONCE)) + 1):
            if len(at):
                k, a, b, e, f, _ = passages(own(x[at]), own(y[at]), t, threshold)
                found.append((x[at][k], y[at][k], a, b, e, f))
        fx, fy, a, b, e, f = (np.concatenate(v) for v in zip(*found))
        # they are one class if their passages meet those of others of it
        around = (a <= c[fx]) & (c[fx] < b) & (e <= c[fy]) & (c[fy] < f)
        out.append(tuple(v[~around] for v in (fx, fy, a, b, e, f)))
        fx, fy, a, b, e, f = (v[around] for v in (fx, fy, a, b, e, f))
        for w, lo, hi in ((fx, a, b), (fy, e, f)):
            np.minimum.at(begin_at, w, lo)
            np.maximum.at(end_at, w, hi)
        label, tree = _forest(label, fx, fy)
        trees.append((fx[tree], fy[tree]))
    x, y = (np.concatenate(v) for v in zip((z, z), *trees))
    out.append((x, y, begin_at[x], end_at[x], begin_at[y], end_at[y]))
    x, y, *spans = (np.concatenate([o[j] for o in out]) for j in range(6))
    return all_[x], all_[y], *spans


def window_shingles(rows: DataFrame, windows: DataFrame, words: int) -> DataFrame:
    """(key, large, dk, l, c, grams): windows with their shingles, by 32 bits of their hashes, which are compared within a key only; c is counted from l."""
    asked = windows.select("dk", F.struct("key", F.col("l").alias("s"), (F.col("r") + 1).alias("e"), (F.col("c") - F.col("l")).alias("c"), "large").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat, doc, g, s, e in _cut(batches, words):
            raw = (g >> U64(32)).astype(np.uint32).tobytes()
            grams = pa.array([raw[4 * x : 4 * y] for x, y in zip(s.tolist(), e.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([flat.field(0), flat.field(4), part.column(0).take(pa.array(doc)), flat.field(1), flat.field(3), grams], names=["key", "large", "dk", "l", "c", "grams"])

    return stream(_by_document(asked, rows), run, WINDOWS)


def _arrays(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """key, dk, l, c, shingles end to end and their number."""
    grams = table.column("grams")
    n = np.asarray(pa.compute.binary_length(grams)).astype(np.int64) // 4
    g = np.frombuffer(b"".join(grams.to_pylist()), np.uint32)
    return *(np.asarray(table.column(k)) for k in ("key", "dk", "l")), np.asarray(table.column("c")).astype(np.int64), g, n


def link_windows(windows: DataFrame, t: int, threshold: float, cells: int) -> DataFrame:
    """Windows with their shingles -> near passages, and those of large keys as they are.

    They come sorted by key, so a task holds about ``AT_ONCE`` shingles or those of one key; those of large keys are dealt by their own place."""
    empty = pa.Table.from_batches([], pa.schema([("key", pa.int64()), ("large", pa.bool_()), ("dk", pa.int64()), ("l", pa.int32()), ("c", pa.int32()), ("grams", pa.binary())]))

    def both(links: list[pa.Array], some: pa.Table) -> pa.RecordBatch:
        m, k = len(links[0]), len(some)
        names = ["dx", "dy", "sx", "ex", "sy", "ey", *some.schema.names]
        columns = [pa.concat_arrays([a, pa.nulls(k, a.type)]) for a in links]
        columns += [pa.concat_arrays([pa.nulls(m, f.type), *(c.cast(f.type) for c in some.column(f.name).chunks)]) for f in empty.schema]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def some(table: pa.Table) -> pa.RecordBatch:
        large = table.select(empty.schema.names).filter(table.column("large"))
        key, dk, l, c, g, n = _arrays(table.filter(pa.compute.invert(table.column("large"))))
        x, y, a, b, e, f = near_links(key, dk, c, g, n, t, threshold)
        i4 = lambda v: pa.array(v.astype(np.int32))
        return both([pa.array(dk[x]), pa.array(dk[y]), i4(l[x] + a), i4(l[x] + b), i4(l[y] + e), i4(l[y] + f)], large)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in batches:
            held.append(part)
            size += pa.compute.sum(pa.compute.binary_length(part.column("grams"))).as_py() or 0
            if size > 4 * AT_ONCE:
                table = pa.Table.from_batches(held).combine_chunks()
                # more of the last key may come next
                deal = np.asarray(table.column("deal"))
                last = int(np.flatnonzero(deal == deal[-1])[0])
                if last:
                    yield some(table.slice(0, last))
                held = table.slice(last).to_batches()
                size = 2 * AT_ONCE if not last else 0
        if held:
            yield some(pa.Table.from_batches(held).combine_chunks())

    dealt = windows.withColumn("deal", F.when(F.col("large"), F.xxhash64("dk", "l", "key")).otherwise(F.col("key")))
    return stream(dealt.repartition(cells, "deal").sortWithinPartitions("deal", "key", "dk", "l"), run, f"{SPANS}, {WINDOWS}")


def window_sides(windows: DataFrame, half: int, cells: int) -> DataFrame:
    """``passage_dedup.window_tokens`` of windows that have their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, 4096):
                some = part.slice(at, 4096)
                key, _, _, c, g, n = _arrays(some)
                own = sides(g.astype(np.uint64), n, c, key.view(np.uint64), np.asarray(some.column("w")).view(np.uint64), half)
                k, b = by_cell(own, GRAM, own["gram"], cells)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.binary())], names=["cell", "blob"])

    return stream(windows, run, "cell int, blob binary")


def in_blocks(windows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Windows of keys with more than ``most`` of them (``sizes``: key, _n) under new keys, one for every two blocks."""
    some = windows.join(sizes, "key").withColumn("_blocks", F.ceil(F.col("_n") * 2 / F.lit(most)).cast("int"))
    some = some.withColumn("_own", F.pmod(F.xxhash64("dk", "l"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return some.where("_own <> _other").select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "dk", "l", "c", "grams")


def classes(links: DataFrame) -> DataFrame:
    """Links of spans -> (dk, s, e, node, comp): passages, which are spans that overlap, and the smallest passage that links connect with each."""
    ends = links.select(F.col("dx").alias("dk"), F.col("sx").alias("s"), F.col("ex").alias("e")).union(links.select("dy", "sy", "ey")).distinct()
    by = Window.partitionBy("dk").orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("_new", F.when(before.isNull() | (F.col("s") >= before), F.col("s")))
    ends = ends.withColumn("_new", F.max("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = stash(ends.withColumn("node", F.xxhash64("dk", "_new")))
    edges = links
    for v in "xy":
        edges = edges.join(ends.select(F.col("dk").alias("d" + v), F.col("s").alias("s" + v), F.col("e").alias("e" + v), F.col("node").alias("n" + v)), ["d" + v, "s" + v, "e" + v])
    labels = components(edges.select(F.col("nx").alias("a"), F.col("ny").alias("b")))
    found = stash(ends.groupBy("node", "dk").agg(F.min("s").alias("s"), F.max("e").alias("e")).join(labels, "node"))
    # windows of one document may have met each other only
    return found.join(found.groupBy("comp").agg(F.min("dk").alias("_a"), F.max("dk").alias("_b")).where("_a <> _b").select("comp"), "comp")


def passage_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, words: int = 5, n_hashes: int = 4, threshold: float = 0.8, cell_bytes: int = 16_000_000, most: int = 20_000) -> DataFrame:
    """One row for each passage of a document that is in another one too: doc_id, first_word, last_word, class_id, other_id, other_first, other_last.

    Words are numbered from 0; last words are included. The class is named by a number and by one of its passages, the other one of each row."""
    t = min_words - words + 1
    rows = row_keys(docs, id_col, text_col).withColumn("dk", F.xxhash64("id", "fp")).select("dk", "id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(8, -(-total // cell_bytes))
    joined = stash(join_windows(find_windows(rows, words, t, n_hashes, 4 * cells, True), n_hashes, 4 * cells, True))
    windows = stash(window_rows(joined.where("kind = 0"), n_hashes).select("key", "dk", "l", "c", "r"))
    links = stash(join_intervals(link_rows(joined.where("kind = 1")), cells).select("dx", "dy", "sx", "ex", "sy", "ey"))
    free(joined)
    held = [links]

    def sizes(w: DataFrame) -> DataFrame:
        return stash(w.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > most))

    def meet(w: DataFrame) -> DataFrame:
        held.append(stash(link_windows(w, t, threshold, 2 * cells)))
        return held[-1].where("grams is not null").drop("dx", "dy", "sx", "ex", "sy", "ey")

    many = sizes(windows)
    marked = windows.join(many, "key", "left").withColumn("large", F.col("_n").isNotNull())
    large = meet(window_shingles(rows, marked, words))
    if not many.isEmpty():
        least = int(np.ceil(2 * t * threshold / (1 + threshold) - 1e-9))
        rare = rare_groups(stash(large.drop("large")), lambda w: window_sides(w, t // 2 + 1, cells), t, least, cells)
        more = sizes(rare)
        meet(rare.join(more, "key", "left_anti").select("key", "dk", "l", "c", "grams").unionByName(in_blocks(rare, more, most)).withColumn("large", F.lit(False)))
        free(rare, more)
    free(windows, many)
    for more in held[1:]:
        links = links.unionByName(more.where("dx is not null").select(*links.columns))
    found = classes(links)
    free(*held)
    names = rows.select("dk", "id").distinct()
    last = F.col("e") + F.lit(words - 2)
    named = found.join(names, "dk").select("node", "comp", F.col("id").alias("doc_id"), F.col("s").alias("first_word"), last.alias("last_word"))
    first = named.where("node = comp").select("comp", F.col("doc_id").alias("other_id"), F.col("first_word").alias("other_first"), F.col("last_word").alias("other_last"))
    return named.join(first, "comp").select("doc_id", "first_word", "last_word", F.col("comp").alias("class_id"), "other_id", "other_first", "other_last")
