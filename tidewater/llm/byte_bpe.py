"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks of ``chunk_chars`` code points that also hold the next ``overlap`` ones. Each chunk is
pre-tokenised from its own start, in parallel, and keeps the pre-token starts in its first ``overlap`` code points and in
its tail (the part that it shares with the next chunk). A pattern may look at most ``overlap`` code points past the end of a match (the usual ones
look at one), so what it matches from a position on depends on the text from there on, and where the tail of one chunk and the head of the next have a start in common both agree ever after: the
first such start is where the text is cut. Pieces between cuts are encoded apart and their ids follow each other.
A cut is only made after a code point that isn't white space, as white space matches by what follows it. Chunks
without a common start (one pre-token, or white space, longer than the overlap) are joined and encoded together, since BPE
merges within a whole pre-token; where such a joined piece is then not found to end between two pre-tokens, its text is encoded whole. Texts of one chunk skip the cutting. Decoding looks up each id's bytes and joins them.

Scale: a task holds about ``SLICE`` code points of text and their ids, or a run of joined chunks; only numbers of the long
texts' chunks are windowed by text. Chunks are dealt by (row, chunk) before they are encoded.

Edge cases: a null text is empty and has no ids, and decodes to no bytes; null and repeated ids and equal rows stay rows of their own; an
empty table gives an empty table; other columns of the input are left out, so their names can't clash.
Ids that are no integers raise under ANSI rules.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._pieces import column, numbered, streamed_sha256, text_or_empty
from ._shared import slices, stash

#: Bytes of text whose ids a task holds at once.
SLICE = 2_000_000
_coders: dict = {}


class Coder:
    """A rank file and a pattern as encoder and decoder."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        spelled = [b""] * size
        for token, rank in ranks.items():
            spelled[rank] = token
        self.length = np.array([len(t) for t in spelled], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.bpe.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        except ValueError:  # the library's pattern engine gives up on runs of over a million white-space characters
            return np.array([i for m in self.pattern.finditer(text) for i in self.bpe._encode_single_piece(m.group().encode())], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        end = np.cumsum(n)
        return self.bytes[np.arange(n.sum()) + np.repeat(self.begin[ids] - (end - n), n)].tobytes()

    def starts(self, text: str, lo: int, hi: int) -> tuple[list[int], list[int]]:
        """Starts of pre-tokens where a cut is safe: those up to ``lo``, and those from ``hi`` on."""
        head, tail = [], []
        for m in self.pattern.finditer(text):
            s = m.start()
            if s and (s <= lo or s >= hi) and not text[s - 1].isspace():
                if s <= lo:
                    head.append(s)
                if s >= hi:
                    tail.append(s)
        return head, tail


def _coder(ranks_path: str, pattern: str) -> Coder:
    if (ranks_path, pattern) not in _coders:
        _coders[ranks_path, pattern] = Coder(ranks_path, pattern)
    return _coders[ranks_path, pattern]


def _encoded(texts: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Replace the text column by ``token_ids``."""
    names = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for rows, _, _ in slices(batches, "text", SLICE):
            ids = [coder.encode(t) for t in column(rows, "text").to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*(column(rows, c) for c in names), lists], names=[*names, "token_ids"])

    return texts.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text") + ", token_ids array<int>")


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, doc_id, k, base, text): chunk k begins at code point ``base`` and also holds ``overlap`` of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(column(batch, c).to_pylist() for c in ("row", "doc_id", "text"))):
                for base in range(0, len(text), chunk):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc, "k": base // chunk, "base": base, "text": text[base : base + chunk + overlap]}], pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("base", pa.int64()), ("text", pa.string())]))

    return long.mapInArrow(run, "row long, doc_id long, k long, base long, text string")


def _cuts(chunks: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, k, piece, sync, next_sync): each chunk's piece, where it begins, and where the next chunk takes over (null: nowhere)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            base = column(batch, "base").to_pylist()
            found = [coder.starts(t, overlap, chunk) for t in column(batch, "text").to_pylist()]
            lists = [pa.array([[b + s for s in f[i]] for b, f in zip(base, found)], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "k"), *lists], names=["row", "k", "head", "tail"])

    order = Window.partitionBy("row").orderBy("k")
    got = chunks.select("row", "k", "base", "text").mapInArrow(run, "row long, k long, head array<long>, tail array<long>")
    got = got.withColumn("sync", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))))
    return got.select("row", "k", "sync", F.sum(F.col("sync").isNotNull().cast("long")).over(order).alias("piece"), F.lead("sync").over(order).alias("next_sync"))


def _unsound(joined: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(row) of the texts among (row, text, after) in which no pre-token begins at the end of ``text``.

    A chunk that never met the one before may have been read out of step, and then so may its agreement with the next one be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            texts = zip(column(batch, "row").to_pylist(), column(batch, "text").to_pylist(), column(batch, "after").to_pylist())
            bad = [row for row, t, more in texts if not any(m.start() == len(t) for m in coder.pattern.finditer(t + more))]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], names=["row"])

    return joined.select("row", "text", "after").mapInArrow(run, "row long")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """(row, doc_id, seq, parts, token_ids): ids of each text in pieces, in the order of ``seq``; ``parts`` is how many it has.

    Only texts of over ``chunk_chars`` code points have several; ``row`` tells them apart and is null in the others."""
    if not 0 < overlap < chunk_chars:
        raise ValueError("overlap must be positive and less than chunk_chars")
    size = F.length(text_or_empty(text_col))
    short = docs.where(size <= chunk_chars).select(F.lit(None).cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    short = _encoded(short, ranks_path, pattern).withColumn("seq", F.lit(0).cast("long")).withColumn("parts", F.lit(1).cast("long"))
    chunks = stash(_chunks(numbered(docs.where(size > chunk_chars), id_col, text_col), chunk_chars, overlap).repartition("row", "k"))
    cuts = stash(_cuts(chunks, ranks_path, pattern, chunk_chars, overlap))
    text = chunks.join(cuts, ["row", "k"])
    # A chunk's share runs from its cut, or its start, to the next chunk's cut, or that chunk's start.
    begin = F.coalesce(F.col("sync"), F.col("base")) - F.col("base")
    end = F.coalesce(F.col("next_sync"), F.col("base") + chunk_chars) - F.col("base")
    own, after = F.substring("text", (begin + 1).cast("int"), (end - begin).cast("int")), F.substring("text", (end + 1).cast("int"), F.lit(overlap))
    text = text.select("row", "doc_id", "piece", "k", own.alias("text"), F.when(F.col("next_sync").isNotNull(), after).alias("after"))
    joined = lambda place: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "text"))), lambda x: x["text"]), "")
    pieces = stash(text.groupBy("row", "piece").agg(F.first("doc_id").alias("doc_id"), joined("k").alias("text"), F.max_by("after", "k").alias("after"), F.count(F.lit(1)).alias("n")))
    # texts whose joined chunks end where no pre-token does are one piece
    whole = _unsound(pieces.where("n > 1 AND after IS NOT NULL"), ranks_path, pattern).distinct().withColumn("_whole", F.lit(True))
    pieces = pieces.join(whole, "row", "left")
    kept = pieces.where("_whole IS NULL").select("row", "doc_id", F.col("piece").alias("seq"), "text")
    long = kept.unionByName(pieces.where("_whole").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.lit(1).cast("long").alias("seq"), joined("piece").alias("text")))
    long = stash(_encoded(long, ranks_path, pattern))
    long = long.join(long.groupBy("row").agg(F.max("seq").alias("parts")), "row")
    names = ["row", "doc_id", "seq", "parts", "token_ids"]
    return short.select(names).unionByName(long.select(names))


def decode(pieces: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """Add ``decoded``: the bytes of each row's ids."""
    names = pieces.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            found = [coder.decode(ids) for ids in _ids(column(batch, ids_col))]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(found, pa.binary())], names=[*names, "decoded"])

    return pieces.mapInArrow(run, f"{kinds}, decoded binary")


def digest(pieces: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encode`` gives, one row for each text; the ids are decoded on the way.

    Ids are hashed as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            ids = _ids(column(batch, "token_ids"))
            sums = [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(x) for x in ids], pa.int64()), *(pa.array(s, pa.string()) for s in sums)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "seq"), pa.array([x.tobytes() for x in _ids(column(batch, "token_ids"))], pa.binary()), column(batch, "decoded")], names=["row", "seq", "ids", "decoded"])

    whole = pieces.where("parts = 1").select("doc_id", "token_ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    many = pieces.where("parts > 1")
    counts = many.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.size("token_ids").cast("long")).alias("n_tokens"))
    spelled = decode(many.select("row", "seq", "token_ids"), ranks_path, pattern)
    sums = streamed_sha256(spelled.mapInArrow(raw, "row long, seq long, ids binary, decoded binary"), "ids", "decoded")
    return whole.unionByName(counts.join(sums, "row").drop("row"))


def _ids(lists: pa.Array) -> list[np.ndarray]:
    values = np.asarray(lists.values).astype("<u4", copy=False)
    at = np.asarray(lists.offsets)
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def token_digest(docs: DataFrame, ranks_path: str, pattern: str, **options) -> DataFrame:
    """Encode, decode and digest every text."""
    return digest(encode(docs, ranks_path, pattern, **options), ranks_path, pattern)
