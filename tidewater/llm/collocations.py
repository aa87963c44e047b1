"""Phrase collocations: sketch upper bounds choose candidates, automata count them exactly.

First every task adds the hashes of all phrases of up to ``max_words`` words to a count sketch of one row of cells; summed over
tasks, a cell is an upper bound of the count of each phrase in it. Cells under ``min_count`` rule out their phrases. Then
each shard (some MB of text) compiles the phrases of its own that the sketch leaves over into an
Aho-Corasick automaton and scans itself, counting overlapping matches. The automaton reads words as numbers: each
(language, word) that may matter has one, of a fixed few letters, and every other word and every end of a piece is the delimiter, which no
phrase holds. Counts of shards are summed and only then are thresholds and scores applied, so the sketch costs time where
it is loose but never changes a count.

Scale: both passes read the texts once. A cell counts up to ``min_count`` (255 at most), which is enough to decide; sketches travel as
compressed gaps between the cells in use, by blocks of 262,144, and add up as they arrive. The cells are as many as a sixteenth of the bytes of text, 2**28 at most, and what
is sent to tasks is one bit a cell: 32 MB at most. Beyond that size more phrases pass and the second shuffle, of summed
counts by phrase, grows up to that of plain counting. An automaton holds phrases of one shard only. Ranks are taken in 64 shares of a language before they meet.

Edge cases: a null text is empty; a null language is ``und``, together with rows that say ``und``; equal rows count each; a language
without candidates has no rows; an empty table gives an empty table; ties in score and count are ranked by phrase. Words and phrases are told
apart by 64-bit hashes within a shard and by their strings between shards. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._pieces import column
from ._shared import U64, gram_hashes, mix, prefix_hash, range_hash, slices, stash

#: Bytes of text in a shard, and the words of one automaton.
SHARD_BYTES, SHARD_WORDS = 2_000_000, 1_000_000
#: Hashes that a task gathers before it hands its sketch on.
GATHER = 12_000_000
BLOCK = 1 << 18
MOST_CELLS = 1 << 28
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 1 white space between words, 2 end of a piece
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2


def _words(rows: pa.RecordBatch, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lower-cased bytes, start, end, piece, text, hash) of each word; hashes differ by language."""
    low = _LOWER[buf]
    kind = _KIND[buf]
    ink = kind == 0
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:-1]
    last[:-1] &= ~ink[1:] | cut[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(off, s, "right") - 1
    piece = np.cumsum(kind == 2)[s] + text if len(s) else s
    langs, code = np.unique(np.array(column(rows, "lang").to_pylist(), object).astype(str), return_inverse=True)
    salt = np.array([range_hash(prefix_hash(np.frombuffer(x.encode(), np.uint8)), np.zeros(1, np.int64), np.array([len(x.encode())]))[0] for x in langs], np.uint64)
    h = range_hash(prefix_hash(low), s, e)
    return low, s, e, piece, text, mix(h + mix(salt[code.reshape(-1)[text]] + U64(0x632BE59BD9B4E019)))


def _sketch(texts: DataFrame, cells: int, max_words: int, min_count: int) -> np.ndarray:
    """One bit for each cell: whether phrases of it may occur ``min_count`` times."""
    least = min(min_count, 255)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, held, size = zstandard.ZstdCompressor(level=1), [], 0

        def blocks() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            edges = np.searchsorted(every, np.arange(cells // BLOCK + 1, dtype=np.uint64) * U64(BLOCK))
            for block in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                inside, n = np.unique(every[edges[block] : edges[block + 1]] % BLOCK, return_counts=True)
                gaps = np.diff(inside.astype(np.int64), prepend=0)
                parts = [press.compress(x.astype(np.uint8).tobytes()) for x in (gaps & 255, gaps >> 8 & 255, gaps >> 16, np.minimum(n, least))]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([parts], pa.list_(pa.binary()))], names=["block", "counts"])

        for rows, buf, off in slices(batches, "text", SHARD_BYTES):
            _, _, _, piece, _, h = _words(rows, buf, off)
            for k in range(1, max_words + 1):
                held.append((gram_hashes(h, piece, k)[0] & U64(cells - 1)).astype(np.uint32))
                size += len(held[-1])
            if size >= GATHER:
                yield from blocks()
                size = 0
        if size:
            yield from blocks()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for block, parts in zip(column(batch, "block").to_pylist(), column(batch, "counts").to_pylist()):
                low, middle, high, n = (np.frombuffer(press.decompress(x), np.uint8) for x in parts)
                at = np.cumsum(low.astype(np.int64) + (middle.astype(np.int64) << 8) + (high.astype(np.int64) << 16))
                had = sums.setdefault(block, np.zeros(BLOCK, np.uint8))
                had[at] += np.minimum(n, 255 - had[at])
        for block, counts in sums.items():
            if (counts >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(counts >= least).tobytes()], pa.binary())], names=["block", "bits"])

    parts = texts.mapInArrow(add, "block long, counts array<binary>").repartition("block")
    bits = np.zeros(cells // 8, np.uint8)
    for r in parts.mapInArrow(total, "block long, bits binary").toLocalIterator(prefetchPartitions=True):
        bits[r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _symbols(ids: np.ndarray, digits: int) -> str:
    """A string of ``digits`` letters for each id, 0 being the delimiter. Each place has 16 letters of its own.

    So no match begins inside a word, and no node of an automaton has many branches, which the library searches one by one."""
    places = np.arange(digits - 1, -1, -1)
    return (((ids[:, None] >> (4 * places)) & 15) + 16 * places + 1).astype(np.uint8).tobytes().decode("latin-1")


def _shard(low, s, e, piece, h, passes, a: int, b: int, max_words: int) -> tuple[list[str], list[int], list[int], np.ndarray]:
    """(phrase, its number of words, its count, the place of one occurrence) of what begins in words a to b; words count as phrases of one."""
    import ahocorasick

    to = min(len(h), b + max_words - 1)
    h, piece = h[a:to], piece[a:to]
    stay, width = b - a, len(h)
    ok = {k: passes[k][a:to][: width - k + 1] if width >= k else np.zeros(0, bool) for k in range(1, max_words + 1)}
    used = ok[1].copy()
    for k in range(2, max_words + 1):
        at = np.flatnonzero(ok[k])
        for j in range(k):
            used[at + j] = True
    if not used.any():
        return [], [], [], np.zeros(0, np.int64)
    _, one, which = np.unique(h[used], return_index=True, return_inverse=True)
    ids = np.zeros(width, np.int64)
    ids[used] = which.reshape(-1) + 1
    place = np.flatnonzero(used)[one]
    raw = low.tobytes()
    spelled = [""] + [raw[x:y].decode("utf-8", "replace") for x, y in zip(s[a + place].tolist(), e[a + place].tolist())]
    # words: counted as they are
    head = ids[:stay][ok[1][:stay]]
    n = np.bincount(head, minlength=len(spelled))
    found = np.flatnonzero(n)
    phrases, lengths, counts, places = [spelled[k] for k in found], [1] * len(found), n[found].tolist(), [place[found - 1]]
    # phrases: one automaton over the symbols
    auto, texts, wide, begin = ahocorasick.Automaton(ahocorasick.STORE_INTS), [], [], []
    digits = max(1, -(-int(ids.max()).bit_length() // 4))
    for k in range(2, max_words + 1):
        at = np.flatnonzero(ok[k][:stay])
        if not len(at):
            continue
        rows = ids[at[:, None] + np.arange(k)]
        keys = gram_hashes(h, piece, k)
        hash_at = np.zeros(width, np.uint64)
        hash_at[keys[1]] = keys[0]
        _, pick = np.unique(hash_at[at], return_index=True)
        rows, at = rows[pick], at[pick]
        coded, size = _symbols(rows.reshape(-1), digits), k * digits
        for j in range(len(at)):
            auto.add_word(coded[j * size : (j + 1) * size], len(texts) + j)
        texts += [" ".join([spelled[x] for x in r]) for r in rows.tolist()]
        wide += [k] * len(at)
        begin.append(at)
    if texts:
        auto.make_automaton()
        new = np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])  # a delimiter at each change of piece
        text = np.zeros(width + int(new[-1]), np.int64)
        text[np.arange(width) + new] = ids
        found = auto.iter(_symbols(text, digits))
        if stay == width:
            hits = np.fromiter(map(itemgetter(1), found), np.int32)
        else:  # what begins after the shard's own words is the next one's
            end, hits = np.fromiter(chain.from_iterable(found), np.int32).reshape(-1, 2).T
            word_of = np.zeros(len(text), np.int64)
            word_of[np.arange(width) + new] = np.arange(width)
            hits = hits[word_of[end // digits] - np.array(wide)[hits] + 1 < stay]
        n = np.bincount(hits, minlength=len(texts))
        phrases, lengths, counts = phrases + texts, lengths + wide, counts + n.tolist()
        places += begin
    return phrases, lengths, counts, a + np.concatenate(places)


def phrase_counts(docs: DataFrame, min_count: int = 30, max_words: int = 4, text_col: str = "text", lang_col: str = "lang", cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, sizes): (lang, phrase, words, a) of all phrases and words found ``min_count`` times, and (lang, n) words of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if cells is None:
        size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        cells = 1 << max(0, (size // 16 - 1)).bit_length()
    cells = min(MOST_CELLS, max(BLOCK, 1 << (cells - 1).bit_length()))
    bits = _sketch(texts, cells, max_words, min_count)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed(g: np.ndarray) -> np.ndarray:
            cell = g & U64(cells - 1)
            return (bits[cell >> U64(3)] >> (7 - (cell & U64(7))).astype(np.uint8)) & 1 == 1

        for rows, buf, off in slices(batches, "text", SHARD_BYTES):
            low, s, e, piece, text, h = _words(rows, buf, off)
            passes = {}
            for k in range(1, max_words + 1):
                g, at = gram_hashes(h, piece, k)
                passes[k] = np.zeros(len(h), bool)
                passes[k][at] = passed(g)
                if k > 1:  # a frequent phrase has frequent parts
                    passes[k][:-1] &= passes[k - 1][:-1] & passes[k - 1][1:]
            langs = column(rows, "lang").to_pylist()
            kinds = sorted(set(langs))
            number = np.array([kinds.index(x) for x in langs])
            sizes = np.bincount(number[text], minlength=len(kinds)).tolist()
            out = [(kinds, [None] * len(kinds), [0] * len(kinds), sizes)]
            for a in range(0, len(h), SHARD_WORDS):
                phrases, lengths, counts, places = _shard(low, s, e, piece, h, passes, a, min(len(h), a + SHARD_WORDS), max_words)
                out.append(([kinds[x] for x in number[text[places]]] if len(places) else [], phrases, lengths, counts))
            for lang, phrases, lengths, counts in out:
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrases, pa.string()), pa.array(lengths, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "words", "a"])

    found = texts.mapInArrow(scan, "lang string, phrase string, words int, a long").groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))
    found = stash(found.where((F.col("words") == 0) | (F.col("a") >= min_count)))
    return found.where("words > 0"), found.where("words = 0").select("lang", F.col("a").alias("n"))


def _exact(column: str):
    return F.col(column).cast("decimal(19,0)")


def collocations(docs: DataFrame, min_count: int = 30, max_words: int = 4, top: int = 2000, inside_percent: int = 80, scale: int = 2_000_000, text_col: str = "text", lang_col: str = "lang", cells: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``max_words`` words.

    A phrase is scored floor(scale * a / (l + r)) at its weakest cut. One that a longer candidate holds with
    ``inside_percent`` of its count or more is left out."""
    counts, sizes = phrase_counts(docs, min_count, max_words, text_col, lang_col, cells)
    cand = counts.where("words > 1")
    words = F.split("phrase", " ", -1)
    part = lambda frame, name, value: frame.select("lang", F.col("phrase").alias(name), F.col("a").alias(value))
    cuts = cand.select("lang", "phrase", "words", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(part(counts, "first", "l"), ["lang", "first"]).join(part(counts, "rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr(f"(cast({scale} as decimal(18,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    inside = cand.where("words > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    best = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(18,0)") * _exact("longer") < F.lit(inside_percent).cast("decimal(18,0)") * _exact("a")))
    best = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
