"""Token-ID output: Parquet list columns in ascending id order, and selective reads of them.

Layout: one file per range partition; rows sorted by id; columns ``doc_id``, ``part``,
``local_start`` (ids before the row in its file), ``n_tokens``, the chosen metadata columns and
``token_ids`` as ``array<int>``. Token ids are dictionary-encoded by default or delta-encoded
(format version 2). Row-group and page sizes are parameters and the writer adds page indexes, so a
reader of metadata or of a few ids touches neither other columns nor other pages.

Edge cases: a null text is empty and yields the end id alone; null ids sort first; repeated ids
and equal rows are kept and ordered by (id, hash of the text), so equal rows are interchangeable;
an empty table writes files without rows; metadata columns that would clash with the columns
above are refused; ids that are no integers raise.
"""

from __future__ import annotations

import json
import re
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import U64, prefix_hash, range_hash, shared_dir, slices, small_batches

OWN = ("doc_id", "part", "local_start", "n_tokens", "token_ids")
#: Words, and ids of words, that a worker keeps; when there are more, only those of the last texts stay.
MEMO_WORDS, MEMO_IDS = 1_000_000, 8_000_000
_encoders: dict = {}


class Encoder:
    """Ids of whole texts by the tokenizers library.

    For byte-level BPE without normaliser a piece never runs from a non-space into a space or across a
    single newline, nor from letters into ASCII punctuation. So a text is cut at spaces and newlines,
    each distinct word (less its punctuation) goes through the library once, and its ids are reused. Runs of
    white space are cut only before their last space; any other tokenizer, or a text holding an
    added token, is encoded whole.

    Words are told apart by 64-bit hashes. The memory is arrays: sorted hashes, and the begin and number of each word's ids in one long list.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        model = spec.get("model") or {}
        self.tok = Tokenizer.from_file(path)
        self.cut = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        self._forget()
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.cut = self.cut and len(line) == 1
        self.line, self.line_id = line[0], np.array(line[:1], self.dtype).tobytes()
        self.gap = re.compile(r" (?=\S)")

    def _raw(self, text: str) -> bytes:
        # one text at a time: a batch call would start a thread pool in every worker
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _bulk(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces free of newlines, by one call over their lines."""
        out: list[bytes] = []
        size = self.dtype.itemsize
        for at in range(0, len(pieces), 10_000):
            got = self.tok.encode_batch_fast(["\n".join(pieces[at : at + 10_000])], add_special_tokens=False)
            ids = np.array(got[0].ids, self.dtype)
            ends = np.flatnonzero(ids == self.line)
            begins = np.concatenate([[0], ends + 1]) * size
            ends = np.concatenate([ends, [len(ids)]]) * size
            raw = ids.tobytes()
            out += [raw[b:e] for b, e in zip(begins.tolist(), ends.tolist())]
        return out

    def _forget(self) -> None:
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0

    def _store(self, ids: np.ndarray) -> int:
        """Append to the long list; where they begin."""
        at = self.used
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(max(len(ids), at // 2), self.dtype)])
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of each word: one after a newline begins with it, any other follows a space."""
        heads: dict[str, bytes] = {}
        joined, tails = [], {}
        for k, w in enumerate(words):
            head = w.rstrip(string.punctuation)
            if len(head) != len(w) and head and (head[1:] if head[0] == "\n" else head).isalpha():
                tail = w[len(head) :]
                joined.append((k, head, tail))
                heads[head] = tails[tail] = b""
            else:
                heads[w] = b""
        after, others = [w for w in heads if w[0] == "\n"], [w for w in heads if w[0] != "\n"]
        heads.update(zip(after, [self.line_id + x for x in self._bulk([w[1:] for w in after])]))
        heads.update(zip(others, self._bulk([" " + w for w in others])))
        for t in tails:
            tails[t] = self._raw(t)
        out = [heads.get(w, b"") for w in words]
        for k, head, tail in joined:
            out[k] = heads[head] + tails[tail]
        return out

    def _remember(self, keys: np.ndarray, words: list[str]) -> None:
        """Take up new words, their hashes ascending. Those that white space begins or ends, empty ones and added tokens count -1."""
        odd = np.array([not self.cut or w in ("", "\n") or (w[1] if w[0] == "\n" else w[0]).isspace() or w[-1].isspace() or any(a in w for a in self.added) for w in words])
        raw = self._learn([w for w, o in zip(words, odd.tolist()) if not o])
        size, count = self.dtype.itemsize, np.full(len(keys), -1, np.int64)
        count[~odd] = np.array([len(x) // size for x in raw], np.int64)
        n = np.maximum(count, 0)
        begin = self._store(np.frombuffer(b"".join(raw), self.dtype)) + np.cumsum(n) - n
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.count = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.count, at, count)

    def _pieces(self, text: str) -> bytes:
        """A text with runs of white space: cut only at a space before a non-space."""
        return b"".join([self._raw(x if k == 0 else " " + x) for k, x in enumerate(self.gap.split(text))])

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """The ids of each text as bytes, with ``end``, the bytes of one id or none."""
        raw = [t.encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])
        ids, n = self.encode_all(np.frombuffer(b"".join(raw), np.uint8), off, *np.frombuffer(end, self.dtype).tolist())
        cut = np.cumsum(n)
        return [ids[b - k : b].tobytes() for b, k in zip(cut.tolist(), n.tolist())]

    def encode_all(self, buf: np.ndarray, off: np.ndarray, *end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's), each with the end id if there is one."""
        raw, n = buf.tobytes(), len(off) - 1
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        text = lambda k: raw[off[k] : off[k + 1]].decode()
        marks = [a.encode() for a in self.added if a.encode() in raw]
        whole = np.array([not self.cut or off[k] == off[k + 1] or any(a in raw[off[k] : off[k + 1]] for a in marks) for k in range(n)], bool) if marks or not self.cut else np.diff(off) == 0
        # a word begins after a space, after a newline, which it keeps, and with the text, as if after a newline
        mark = np.flatnonzero((buf == 32) | (buf == 10))
        begin = np.concatenate([off[:-1], mark + 1])
        line = np.concatenate([np.ones(n, bool), buf[mark] == 10])
        doc = np.concatenate([np.arange(n), np.searchsorted(off, mark, "right") - 1])
        order = np.lexsort((begin, doc))
        begin, line, doc = begin[order], line[order], doc[order]
        first = np.searchsorted(doc, np.arange(n))
        stop = np.append(begin[1:] - 1, len(buf))
        stop[np.append(first[1:], len(doc)) - 1] = off[1:]
        key = range_hash(prefix_hash(buf), begin, stop) ^ (line.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        own, at, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) > MEMO_WORDS or self.used > MEMO_IDS:
            self._forget()
        place = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[place] != own) if len(self.keys) else np.arange(len(own))
        if len(new):
            some = at[new]
            words = [("\n" if x else "") + raw[s:e].decode() for s, e, x in zip(begin[some].tolist(), stop[some].tolist(), line[some].tolist())]
            self._remember(own[new], words)
        place = np.searchsorted(self.keys, own)[which]
        start, count = self.begin[place], self.count[place]
        apart = whole.copy()
        apart[doc[count < 0]] = True
        # the line before each text goes
        start[first] += 1
        count[first] -= 1
        held = self.used
        count[apart[doc]] = 0
        for k in np.flatnonzero(apart & (np.diff(off) > 0)).tolist():
            ids = np.frombuffer(self._raw(text(k)) if whole[k] else self._pieces(text(k)), self.dtype)
            start[first[k]], count[first[k]] = self._store(ids), len(ids)
        tail = self._store(np.array(end_id, self.dtype))
        after = np.append(first[1:], len(doc))
        start, count = np.insert(start, after, tail), np.insert(count, after, len(end_id))
        upto = np.cumsum(count)
        ids = self.ids[np.repeat(start - (upto - count), count) + np.arange(upto[-1])]
        self.used = held  # what was put in for this call only
        ends = upto[after + np.arange(n)]
        return ids, np.diff(np.append(0, ends))


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = 0, text_col: str = "text") -> DataFrame:
    """Replace the text column by ``local_start, n_tokens, token_ids``, in the order of each partition's rows."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    out = T.StructType([*kept, T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start = _encoder(tokenizer_path), 0
        for rows, buf, text_off in slices(batches, text_col, 1_500_000):
            ids, n = enc.encode_all(buf, text_off, end_id)
            off = np.concatenate([[0], np.cumsum(n)])
            ids = ids.astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), pa.array(off[:-1] + start), pa.array(n), lists], names=[f.name for f in out.fields])
            start += int(off[-1])

    return docs.mapInArrow(run, out)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = (), partitions: int | None = None, encoding: str = "dictionary", row_group_bytes: int = 64 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode every text and write the files, rows ascending by id over all files."""
    if clash := set(meta_cols) & {*OWN, "_fp", "_text"}:
        raise ValueError(f"metadata columns clash with the file format: {sorted(clash)}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *meta_cols, text.alias("_text"), F.xxhash64(text).alias("_fp"))
    rows = rows.repartitionByRange(n, "doc_id", "_fp").sortWithinPartitions("doc_id", "_fp").drop("_fp").withColumn("part", F.spark_partition_id())
    out = encode(rows, tokenizer_path, end_id, "_text").select("doc_id", "part", "local_start", "n_tokens", *meta_cols, "token_ids")
    write = out.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", 2000)
    write = write.option("parquet.enable.dictionary", str(encoding == "dictionary").lower()).option("parquet.writer.version", "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0")
    with small_batches(docs.sparkSession):
        write.parquet(path)


def read_token_files(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``start``, the ids of all rows before; only the named columns are read besides."""
    df = spark.read.parquet(path)
    heads = df.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # one row for each file: the only global window, and small enough to broadcast
    from pyspark.sql import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    want = [c for c in (columns or df.columns) if c != "start"]
    return df.join(F.broadcast(heads), "part").withColumn("start", F.col("_before") + F.col("local_start")).select(*dict.fromkeys([*want, "start"]))


def ids_crc32(df: DataFrame, ids_col: str = "token_ids") -> DataFrame:
    """Replace the list column by ``ids_crc32`` of the ids as little-endian unsigned 32-bit integers."""
    kept = [f for f in df.schema.fields if f.name != ids_col]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column(rows.schema.get_field_index(ids_col))
            values = np.asarray(lists.values).astype("<u4", copy=False)
            raw, off = memoryview(np.ascontiguousarray(values)).cast("B"), (np.asarray(lists.offsets).astype(np.int64) * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("ids_crc32", T.LongType())]))


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the files of all documents to the shared folder, read them back, one row each."""
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path, end_id)
    return ids_crc32(read_token_files(spark, path, ("doc_id", "start", "n_tokens", "token_ids"))).select("doc_id", "start", "n_tokens", "ids_crc32")
