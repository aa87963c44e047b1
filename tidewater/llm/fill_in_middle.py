"""Fill-in-the-middle transformation by a parallel automaton scan.

One automaton over bytes tells where units (characters, words or lines) begin and where a sentinel ends. A chunk of bytes does
not know the state in which the text before leaves the automaton, so it emits a function, the exit state of every
entry state, and for every entry state how many units begin and sentinels end in it. Functions compose associatively:
within a chunk groups of bytes are looked up in a table and halved in number level by level; the chunks of a
text are composed in order, which gives every chunk its entry state and the units before it. The n-th unit is then
selected by the chunk that holds it, going down its levels of counts, and only byte offsets of the two cuts travel.

A text of n units is cut at two hashed places into prefix, middle and suffix. ``psm`` is prefix, suffix, middle, each
after its sentinel; ``spm`` is suffix, prefix, middle. Empty texts, texts that hold a sentinel and a hashed share stay ``plain``.
``restore`` reads an output back by the same scan, which finds the sentinels.

Scale: texts up to ``chunk_bytes`` are one chunk and are done where they are read, some MB at a time. A longer text is split into rows of
that size (chunks may begin inside a character); its chunks' functions meet in one group, at most 2 GB (Spark's
limit of a value) over ``chunk_bytes`` small rows; its bytes never do. Only SHA-256 digests need a text's pieces in
order in one task, streamed.

Edge cases: a null text is empty; a null id hashes as the seed alone; repeated ids get the same cuts as far as their lengths
agree and stay rows of their own; an empty table gives an empty table; other columns are left out, so their names can't clash. Sentinels that can run into
each other are refused. Ids that are no integers raise under ANSI rules.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import column, numbered, streamed_sha256, text_or_empty
from ._shared import slices, stash

MARKERS = ("<P>", "<S>", "<M>")
#: The parts in the order of each form's output.
ORDER = {"psm": (0, 2, 1), "spm": (2, 0, 1), "plain": (0, 1, 2)}
UNITS = ("chars", "words", "lines")
_SPACES = (9, 10, 11, 12, 13, 32)


class Automaton:
    """Byte automaton of unit starts and marker ends; ``width`` bytes at a time are looked up.

    ``next[g, s]`` is the state after group g from state s, ``starts[g, s]`` and ``ends[g, s]`` what it counts; state 0 is
    the start. The last group is empty: it changes nothing and counts nothing."""

    def __init__(self, unit: str, markers: tuple[bytes, ...]):
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}")
        for a in markers:
            for b in markers:
                if any(a[k:] == b[: len(a) - k] for k in range(1, len(a))) or (a != b and a in b):
                    raise ValueError("sentinels must not overlap")
        prefixes = sorted({m[:k] for m in markers for k in range(len(m))} | {b""})
        kinds = {"chars": 1, "words": 3, "lines": 2}[unit]
        nxt = np.zeros((kinds * len(prefixes), 256), np.int64)
        starts, ends = np.zeros_like(nxt), np.zeros_like(nxt)
        for u in range(kinds):
            for p, prefix in enumerate(prefixes):
                for b in range(256):
                    seen = prefix + bytes([b])
                    to = next(prefixes.index(seen[k:]) for k in range(len(seen) + 1) if seen[k:] in prefixes)
                    if unit == "chars":
                        v, start = 0, not 0x80 <= b < 0xC0
                    elif unit == "words":  # 0 before all, 1 in a word, 2 in white space after one
                        v, start = (2 if b in _SPACES else 1), u == 0 or (u == 2 and b not in _SPACES)
                    else:  # 0 before a line, 1 in it
                        v, start = int(b != 10), u == 0
                    s = u * len(prefixes) + p
                    nxt[s, b], starts[s, b], ends[s, b] = v * len(prefixes) + to, start, any(seen.endswith(m) for m in markers)
        begin = prefixes.index(b"")
        nxt, starts, ends = self._least(nxt, starts, ends, begin)
        columns = np.concatenate([nxt, starts, ends]).T
        kinds_of, self.classes = np.unique(columns, axis=0, return_inverse=True)
        self.classes = self.classes.reshape(-1).astype(np.uint8)
        n = len(nxt)
        self.none = len(kinds_of)  # the class of no byte
        one = [np.vstack([kinds_of[:, k * n : (k + 1) * n], rest]) for k, rest in enumerate((np.arange(n), np.zeros(n, int), np.zeros(n, int)))]
        self.base = self.none + 1
        self.step = one
        self.width = max(1, int(np.log(65536) / np.log(self.base)))
        table = [x[None, :] for x in (np.arange(n), np.zeros(n, int), np.zeros(n, int))]
        for _ in range(self.width):
            table = [x.reshape(-1, n) for x in self._compose([x[:, None, :] for x in table], [x[None, :, :] for x in one])]
        self.next, self.starts, self.ends = table[0].astype(np.uint8), table[1].astype(np.int32), table[2].astype(np.int32)
        self.states = n
        self.weights = self.base ** np.arange(self.width - 1, -1, -1)

    @staticmethod
    def _least(nxt, starts, ends, begin):
        """Merge states that no text tells apart; the start becomes state 0."""
        label = np.zeros(len(nxt), int)
        while True:
            rows = np.concatenate([label[:, None], label[nxt], starts, ends], axis=1)
            new = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
            if new.max() == label.max():
                break
            label = new
        first = [int(np.flatnonzero(label == k)[0]) for k in range(label.max() + 1)]
        order = sorted(range(len(first)), key=lambda k: (k != label[begin], k))
        rank = np.argsort(order)
        pick = [first[k] for k in order]
        return rank[label[nxt[pick]]], starts[pick], ends[pick]

    @staticmethod
    def _compose(left, right):
        f, *counts = left
        g, *more = right
        shape = np.broadcast_shapes(f.shape, g.shape)
        f = np.broadcast_to(f, shape).astype(np.int64)
        at = lambda x: np.take_along_axis(np.broadcast_to(x, shape), f, -1)
        return [at(g), *(c + at(m) for c, m in zip(counts, more))]


@lru_cache
def automaton(unit: str, markers: tuple[str, ...]) -> Automaton:
    return Automaton(unit, tuple(m.encode() for m in markers))


class Scan:
    """The composed functions of many chunks, with the levels that selection goes down."""

    def __init__(self, auto: Automaton, buf: np.ndarray, off: np.ndarray):
        self.auto, self.size = auto, np.diff(off)
        n = -(-self.size // auto.width)
        begin = np.concatenate([[0], np.cumsum(n)])
        padded = np.full(begin[-1] * auto.width, auto.none, np.uint8)
        padded[np.arange(len(buf)) + np.repeat(begin[:-1] * auto.width - off[:-1], self.size)] = auto.classes[buf]
        self.classes = padded.reshape(-1, auto.width)
        group = np.zeros(len(self.classes), np.int64)
        for k in range(auto.width):
            group = group * auto.base + self.classes[:, k]
        self.levels = [(begin, n, auto.next[group], auto.starts[group], auto.ends[group])]
        idle = np.arange(auto.states, dtype=np.uint8)[None], np.zeros((1, auto.states), np.int32)
        while n.max(initial=0) > 1:
            begin, n, f, starts, ends = self.levels[-1]
            half = (n + 1) // 2
            to = np.concatenate([[0], np.cumsum(half)])
            left = np.arange(to[-1]) * 2 + np.repeat(begin[:-1] - 2 * to[:-1], half)
            right = left + 1
            right[to[1:][half > 0] - 1] = np.where((n % 2 == 1)[half > 0], len(f), right[to[1:][half > 0] - 1])
            f, starts, ends = np.vstack([f, idle[0]]), np.vstack([starts, idle[1]]), np.vstack([ends, idle[1]])
            g, starts, ends = Automaton._compose((f[left], starts[left], ends[left]), (f[right], starts[right], ends[right]))
            self.levels.append((to, half, g.astype(np.uint8), starts, ends))
            n = half

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(next, starts, ends) of each chunk, one column for each entry state; an empty chunk changes nothing."""
        begin, n, *tables = self.levels[-1]
        k = self.auto.states
        out = [np.tile(np.arange(k, dtype=np.uint8), (len(n), 1)), np.zeros((len(n), k), np.int32), np.zeros((len(n), k), np.int32)]
        for o, t in zip(out, tables):
            o[n > 0] = t[begin[:-1][n > 0]]
        return tuple(out)

    def select(self, chunk: np.ndarray, entry: np.ndarray, index: np.ndarray, what: str) -> np.ndarray:
        """The byte in its chunk at which unit ``index`` starts ('starts'), or marker ``index`` ends ('ends'); the chunk's size where there are fewer."""
        field = {"starts": 3, "ends": 4}[what]
        state, left, node = entry.astype(np.int64), index.astype(np.int64), np.zeros(len(chunk), np.int64)
        for level in reversed(self.levels[:-1] if len(self.classes) else []):
            begin, n, f = level[:3]
            node = node * 2
            at = np.minimum(begin[chunk] + node, len(f) - 1)
            here = level[field][at, state]
            go = (left >= here) & (node + 1 < n[chunk])
            state, left, node = np.where(go, f[at, state], state).astype(np.int64), np.where(go, left - here, left), node + go
        out = self.size[chunk].copy()
        if not len(self.classes):
            return out
        nxt, *counts = self.auto.step
        table = counts[field - 3]
        row = np.minimum(self.levels[0][0][chunk] + node, len(self.classes) - 1)
        open_ = self.size[chunk] > 0
        for k in range(self.auto.width):
            c = self.classes[row, k]
            hit = open_ & (table[c, state] > 0)
            found = hit & (left == 0)
            out[found] = (node * self.auto.width + k)[found]
            open_ &= ~found
            left = left - hit
            state = nxt[c, state]
        return out


def cuts(doc_id: int | None, n: int, ends: int, seed: str, plain_percent: int, spm_percent: int) -> tuple[str, int, int]:
    """(form, first cut, second cut) by the first four groups of eight digits of a row's SHA-256."""
    digits = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or ends or h[2] % 100 >= 100 - plain_percent:
        return "plain", a, b
    return ("spm" if h[3] % 100 < spm_percent else "psm"), a, b


def _write(parts: list[bytes], form: str, markers: tuple[bytes, ...]) -> bytes:
    if form == "plain":
        return b"".join(parts)
    names = (markers[0], markers[2], markers[1])  # of prefix, middle, suffix
    return b"".join(names[p] + parts[p] for p in ORDER[form])


_META = "row long, doc_id long, n long, form string, prefix_units long, middle_units long"


def _short(docs: DataFrame, unit: str, markers: tuple[str, ...], options: tuple) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, raw = automaton(unit, markers), tuple(m.encode() for m in markers)
        for rows, buf, off in slices(batches):
            scan = Scan(auto, buf, off)
            _, starts, ends = scan.totals()
            ids = column(rows, "doc_id").to_pylist()
            made = [cuts(i, int(n), int(e), *options) for i, n, e in zip(ids, starts[:, 0], ends[:, 0])]
            every, zero = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            at = [scan.select(every, zero, np.array([m[j] for m in made]), "starts") for j in (1, 2)]
            data, out = buf.tobytes(), []
            for (form, *_), o, size, a, b in zip(made, off, scan.size, *at):
                out.append(_write([data[o : o + a], data[o + a : o + b], data[o + b : o + size]], form, raw))
            units = [pa.array([None if m[0] == "plain" else v(m) for m in made], pa.int64()) for v in (lambda m: m[1], lambda m: m[2] - m[1])]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), column(rows, "doc_id"), pa.array(starts[:, 0].astype(np.int64)), pa.array([m[0] for m in made]), *units, pa.array(out, pa.binary())], names=["row", "doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    got = docs.mapInArrow(run, f"{_META}, output binary")
    return got.withColumn("seq", F.lit(0).cast("long")).withColumn("parts", F.lit(1).cast("long"))


def _chunked(long: DataFrame, chunk_bytes: int) -> DataFrame:
    """(row, doc_id, k, data): chunk k of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(column(batch, c).to_pylist() for c in ("row", "doc_id", "text"))):
                data = text.encode()
                n = -(-len(data) // chunk_bytes)
                for k in range(n):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc, "k": k, "data": data[k * chunk_bytes : (k + 1) * chunk_bytes]}], pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("data", pa.binary())]))

    return long.mapInArrow(run, "row long, doc_id long, k long, data binary").repartition("row", "k")


def resolve(chunks: DataFrame, unit: str, markers: tuple[str, ...]) -> DataFrame:
    """(row, k, at, entry, units, ends, n_bytes, n_units, n_ends): what comes before each chunk of (row, k, data), and the totals of its row."""

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(unit, markers)
        for rows, buf, off in slices(batches, "data"):
            f, starts, ends = Scan(auto, buf, off).totals()
            lists = [pa.array(list(x.astype(np.int64)), pa.list_(pa.int64())) for x in (f, starts, ends)]
            yield pa.RecordBatch.from_arrays([column(rows, "row"), column(rows, "k"), pa.array(np.diff(off)), *lists], names=["row", "k", "size", "f", "s", "e"])

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k", ignore_index=True)
        state, at, units, ends, out = 0, 0, 0, 0, []
        for k, size, f, s, e in zip(group["k"], group["size"], group["f"], group["s"], group["e"]):
            out.append((k, at, state, units, ends))
            at, units, ends, state = at + size, units + s[state], ends + e[state], f[state]
        got = pd.DataFrame(out, columns=["k", "at", "entry", "units", "ends"]).astype("int64")
        return got.assign(row=group["row"].iloc[0], n_bytes=at, n_units=units, n_ends=ends)[["row", "k", "at", "entry", "units", "ends", "n_bytes", "n_units", "n_ends"]]

    found = chunks.select("row", "k", "data").mapInArrow(functions, "row long, k long, size long, f array<long>, s array<long>, e array<long>")
    return found.groupBy("row").applyInPandas(compose, "row long, k long, at long, entry long, units long, ends long, n_bytes long, n_units long, n_ends long")


def locate(chunks: DataFrame, wanted: DataFrame, unit: str, markers: tuple[str, ...], what: str) -> DataFrame:
    """(row, j, byte): where in its row the wanted unit starts or marker ends.

    ``wanted`` has (row, k, j, index, entry, before, at): the chunk that holds it, its number in the row and what comes before the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(unit, markers)
        for rows, buf, off in slices(batches, "data"):
            num = lambda c: np.asarray(column(rows, c), np.int64)
            byte = Scan(auto, buf, off).select(np.arange(len(rows)), num("entry"), num("index") - num("before"), what) + num("at")
            yield pa.RecordBatch.from_arrays([column(rows, "row"), column(rows, "j"), pa.array(byte)], names=["row", "j", "byte"])

    return wanted.join(chunks.select("row", "k", "data"), ["row", "k"]).mapInArrow(run, "row long, j long, byte long")


def _wanted(state: DataFrame, index, before: str) -> DataFrame:
    """The chunk of each wanted number: the last one with at most so many before it, and the row's last for a number past the end."""
    w = state.select("*", F.posexplode(index).alias("j", "index"))
    w = w.groupBy("row", "j").agg(F.max(F.when(F.col(before) <= F.col("index"), F.struct("k", "entry", F.col(before).alias("before"), "at"))).alias("c"), F.first("index").alias("index"))
    return w.select("row", F.col("j").cast("long").alias("j"), "index", "c.*")


def _cut(chunks: DataFrame, state: DataFrame, bounds: DataFrame) -> DataFrame:
    """(row, part, k, data): part p of a row is bytes bounds[2p] to bounds[2p + 1], from every chunk that has some."""
    lo, hi = F.col("b")[F.col("part") * 2], F.col("b")[F.col("part") * 2 + 1]
    got = chunks.select("row", "k", "data").join(state.select("row", "k", "at"), ["row", "k"]).join(bounds, "row")
    got = got.select("*", F.explode(F.sequence(F.lit(0), (F.size("b") / 2).cast("int") - 1)).alias("part"))
    begin = F.greatest(lo, F.col("at")) - F.col("at")
    size = F.least(hi, F.col("at") + F.length("data")) - F.greatest(lo, F.col("at"))
    return got.where(size > 0).select("row", "part", "k", F.substring("data", (begin + 1).cast("int"), size.cast("int")).alias("data"))


def _long(docs: DataFrame, unit: str, markers: tuple[str, ...], options: tuple, chunk_bytes: int) -> DataFrame:
    chunks = stash(_chunked(docs, chunk_bytes))
    state = stash(resolve(chunks, unit, markers))
    ids = chunks.where("k = 0").select("row", "doc_id")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            made = [cuts(*at, *options) for at in zip(*(column(x, c).to_pylist() for c in ("doc_id", "n_units", "n_ends")))]
            forms, first, second = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(column(x, c) for c in ("row", "doc_id", "n_units", "n_bytes")), pa.array(forms, pa.string()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["row", "doc_id", "n", "n_bytes", "form", "a", "b"])

    docs = ids.join(state.where("k = 0").drop("k"), "row").mapInArrow(decide, "row long, doc_id long, n long, n_bytes long, form string, a long, b long")
    docs = stash(docs)
    wanted = _wanted(state.join(docs.where("form <> 'plain'").select("row", F.array("a", "b").alias("w")), "row"), F.col("w"), "units")
    found = locate(chunks, wanted, unit, markers, "starts").groupBy("row").pivot("j", [0, 1]).agg(F.first("byte"))
    ends = docs.join(found, "row", "left").withColumns({"c0": F.coalesce(F.col("0"), F.lit(0).cast("long")), "c1": F.coalesce(F.col("1"), F.col("n_bytes"))})
    bounds = ends.select("row", F.array(F.lit(0).cast("long"), "c0", "c0", "c1", "c1", "n_bytes").alias("b"))
    place = F.when(F.col("form") == "plain", F.col("part"))
    for form in ("psm", "spm"):
        for p in range(3):
            place = place.when((F.col("form") == form) & (F.col("part") == p), ORDER[form].index(p))
    body = _cut(chunks, state, bounds).join(docs.select("row", "form"), "row").select("row", place.cast("long").alias("place"), "k", "data")
    names = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(m.encode()).alias("data")) for p, m in zip((0, 2, 1), markers)))
    heads = docs.where("form <> 'plain'").select("row", "form", F.explode(names).alias("m")).select("row", "form", "m.*").select("row", place.cast("long").alias("place"), F.lit(-1).cast("long").alias("k"), "data")
    pieces = body.unionByName(heads).withColumn("seq", F.col("place") * F.lit(1 << 40) + F.col("k") + 1).select("row", "seq", F.col("data").alias("output"))
    plain = F.col("form") == "plain"
    meta = docs.select("row", "doc_id", "n", "form", F.when(~plain, F.col("a")).alias("prefix_units"), F.when(~plain, F.col("b") - F.col("a")).alias("middle_units"))
    return stash(pieces.join(meta, "row").withColumn("parts", F.lit(2).cast("long")).repartition("row", "seq"))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "chars", markers: tuple[str, ...] = MARKERS, seed: str = "1:", plain_percent: int = 10, spm_percent: int = 20, chunk_bytes: int = 1 << 16) -> DataFrame:
    """(row, doc_id, n, form, prefix_units, middle_units, seq, parts, output): the output of each text as UTF-8 bytes.

    ``markers`` are those of prefix, suffix and middle. A text of over ``chunk_bytes`` has ``parts`` over 1 and comes in pieces, in the order of
    ``seq``; ``row`` tells such texts apart and is null in the others."""
    size, options = F.octet_length(text_or_empty(text_col)), (seed, plain_percent, spm_percent)
    automaton(unit, markers)
    short = docs.where(size <= chunk_bytes).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    names = ["row", "doc_id", "n", "form", "prefix_units", "middle_units", "seq", "parts", "output"]
    return _short(short, unit, markers, options).select(names).unionByName(_long(numbered(docs.where(size > chunk_bytes), id_col, text_col), unit, markers, options, chunk_bytes).select(names))


def _restored(batches: Iterator[pa.RecordBatch], markers: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches of whole outputs with ``text`` beside them."""
    auto, raw = automaton("chars", markers), tuple(m.encode() for m in markers)
    for rows, buf, off in slices(batches, "output"):
        scan, data = Scan(auto, buf, off), buf.tobytes()
        every, zero = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        ends = [scan.select(every, zero, zero + j, "ends") + 1 for j in range(3)]
        found = []
        for form, o, size, *e in zip(column(rows, "form").to_pylist(), off.tolist(), scan.size.tolist(), *(x.tolist() for x in ends)):
            b = _bounds(form, e, size, raw)
            found.append(b"".join(data[o + x : o + y] for x, y in zip(b[::2], b[1::2])))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.binary())], names=[*rows.schema.names, "text"])


def _restored_long(outputs: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """(row, seq, text) of outputs of several pieces."""
    long = outputs.where("parts > 1").select("row", "form", F.col("seq").alias("k"), F.col("output").alias("data"))
    state = stash(resolve(long, "chars", markers))
    wanted = _wanted(state.where("n_ends = 3"), F.array(*(F.lit(j).cast("long") for j in range(3))), "ends")
    found = locate(long, wanted, "chars", markers, "ends").groupBy("row").pivot("j", [0, 1, 2]).agg(F.first("byte"))
    rows = long.groupBy("row").agg(F.first("form").alias("form")).join(state.groupBy("row").agg(F.first("n_bytes").alias("n_bytes")), "row").join(found, "row", "left")
    ends = [F.col(str(j)) + 1 for j in range(3)]
    bounds = F.array(F.lit(0).cast("long"), "n_bytes")
    for form in ("psm", "spm"):
        bounds = F.when(F.col("form") == form, F.array(*_bounds(form, ends, F.col("n_bytes"), markers))).otherwise(bounds)
    pieces = _cut(long, state, rows.select("row", bounds.alias("b"))).join(state.select("row", "k", "at"), ["row", "k"])
    return pieces.select("row", (F.col("part") * F.lit(1 << 40) + F.col("at")).alias("seq"), F.col("data").alias("text"))


def restore(outputs: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """(row, doc_id, seq, parts, text): the texts from the outputs of ``transform`` and their forms alone, as UTF-8 bytes."""
    ids = outputs.where("parts > 1").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("parts").alias("parts"))
    names = ["row", "doc_id", "seq", "parts", "text"]
    short = outputs.where("parts = 1").select("row", "doc_id", "seq", "parts", "form", "output")
    short = short.mapInArrow(lambda batches: _restored(batches, markers), "row long, doc_id long, seq long, parts long, form string, output binary, text binary")
    return short.select(names).unionByName(_restored_long(outputs, markers).join(ids, "row").select(names))


def _bounds(form: str, ends: list, size, markers: tuple) -> list:
    """Begin and end of prefix, middle and suffix in an output whose sentinels end at ``ends``, numbers or columns."""
    p, s, m = (len(x) for x in markers)
    if form == "psm":
        return [ends[0], ends[1] - s, ends[2], size, ends[1], ends[2] - m]
    if form == "spm":
        return [ends[1], ends[2] - m, ends[2], size, ends[0], ends[1] - p]
    return [0, size]


def texts(pieces: DataFrame, name: str) -> DataFrame:
    """One row for each text with its pieces of column ``name`` joined to a string; each text must fit one value."""
    short = pieces.where("parts = 1").withColumn(name, F.decode(name, "UTF-8")).drop("row", "seq", "parts")
    others = [c for c in short.columns if c != name]
    long = pieces.where("parts > 1").groupBy("row").agg(*(F.first(c).alias(c) for c in others), F.sort_array(F.collect_list(F.struct("seq", name))).alias(name))
    joined = F.array_join(F.transform(name, lambda x: F.hex(x[name])), "")  # a piece may begin inside a character
    return short.unionByName(long.withColumn(name, F.decode(F.unhex(joined), "UTF-8")).select(short.columns))


def digest(outputs: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output_sha256, restored_sha256), one row for each text."""
    meta = ["doc_id", "n", "form", "prefix_units", "middle_units"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _restored(batches, markers):
            sums = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column(batch, c)], pa.string()) for c in ("output", "text")]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in meta), *sums], names=[*meta, "output_sha256", "restored_sha256"])

    kinds = "doc_id long, n long, form string, prefix_units long, middle_units long, output_sha256 string, restored_sha256 string"
    short = outputs.where("parts = 1").select(*meta, "output").mapInArrow(run, kinds)
    long = outputs.where("parts > 1")
    rows = long.groupBy("row").agg(*(F.first(c).alias(c) for c in meta))
    back = streamed_sha256(_restored_long(outputs, markers), "text").withColumnRenamed("text_sha256", "restored_sha256")
    # a text without bytes is never in pieces, so every row is on both sides
    return short.unionByName(rows.join(streamed_sha256(long, "output"), "row").join(back, "row").drop("row"))
