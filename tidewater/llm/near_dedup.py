"""Near-duplicate documents by DartMinHash signatures, banded joins and exact verification.

A text is the weighted set of its five-word shingles. Each element throws darts: a Poisson process of
unit intensity over its region [0, weight) x rank, drawn from the element's hash alone, so equal
elements throw equal darts in every text. A dart falls on one of ``n_coordinates`` coordinates and the
earliest dart of each is the signature; two texts agree on a coordinate with the probability of
their weighted Jaccard similarity. Only ranks up to about (ln k + 2) k / weight are drawn, so long texts draw few
darts for each element; a text with an empty coordinate draws up to twice the rank again.

Equal texts are collapsed first. Texts that share a band of coordinates are candidates: all pairs
of groups up to ``all_pairs`` texts, else each text with the group's smallest member, and, round after
round, each text outside the component of the group's best linked member (its hub) with that hub,
until nothing new links; the texts then left outside are queries against all members of their groups, block by
block, so no text is dropped and no pairs are emitted but links. Every candidate pair is verified by the exact Jaccard similarity of the
shingle sets.

Edge cases: null texts are empty; equal texts are always one class, so all empty texts are one; a text with fewer
than five words has one shingle; null and repeated ids are kept, and each row gets its class; a
class is named by its smallest id that is not null; ids that are no integers raise; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import U64, mix, own_name, row_keys, shingles, slices, stash


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) identities of the earliest dart of each coordinate; texts without elements stay 0."""
    sums = np.bincount(doc, weight, minlength=n_docs)
    out = np.full(n_docs * k, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(divide="ignore"):
        reach = np.where(sums > 0, (np.log(k) + 2) * k / sums, 0.0)
    todo = np.flatnonzero(sums > 0)
    while len(todo):
        pick = np.isin(doc, todo) if len(todo) < np.count_nonzero(sums) else np.ones(len(doc), bool)
        low, width, layer = 0.0, 1.0, 0
        while True:
            at = np.flatnonzero(pick & (weight > low))
            if not len(at):
                break
            d, e, w, far = doc[at], h[at], weight[at], reach[doc[at]]
            rank, n = np.zeros(len(at)), 0
            while len(d):
                n += 1
                u = mix(e + U64((layer * 0x10001 + n) * 0x9E3779B97F4A7C15 % 2**64))
                rank = rank - np.log(_unit(u)) / width
                inside = rank <= far
                d, e, w, far, rank, u = d[inside], e[inside], w[inside], far[inside], rank[inside], u[inside]
                v = mix(u + U64(0x632BE59BD9B4E019))
                hit = low + width * _unit(mix(v)) < w
                slot = d[hit] * k + (v[hit] >> U64(40)).astype(np.int64) % k
                # a positive float32 orders like its bits: rank above, identity below
                packed = (rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << U64(32)) | (v[hit] & U64(0xFFFFFFFF))
                np.minimum.at(out, slot, packed)
            low, width, layer = low + width, max(low, 1.0) if layer else 1.0, layer + 1
        grid = out.reshape(n_docs, k)
        todo = todo[(grid[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        grid[todo] = np.iinfo(np.uint64).max
        reach[todo] *= 2
    grid = out.reshape(n_docs, k) & U64(0xFFFFFFFF)
    grid[sums == 0] = 0
    return grid


def signatures(rows: DataFrame, words: int, bands: int, band_rows: int) -> DataFrame:
    """(id, fp, text) -> (id, fp, n, bands): number of shingles and a hash of each band."""
    k = bands * band_rows
    salt = np.array([pow(0xA24BAED4963EE407, i + 1, 2**64) for i in range(k)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in slices(batches):
            doc, h = shingles(buf, off, words)
            sig = dart_signatures(doc, h, np.ones(len(doc)), part.num_rows, k)
            keys = mix(((mix(sig + salt[None, :])).reshape(-1, bands, band_rows)).sum(axis=2, dtype=np.uint64)).view(np.int64)
            n = np.bincount(doc, minlength=part.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), lists], names=["id", "fp", "n", "bands"])

    return rows.mapInArrow(run, "id long, fp long, n long, bands array<long>")


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """(fp, text) -> (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in slices(batches):
            doc, h = shingles(buf, off, words)
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("fp")), lists], names=["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles array<long>")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, sim). ``b`` may be a hub of many pairs: it is joined first, while rows are two numbers wide."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", (both / (F.size("_sa") + F.size("_sb") - both)).alias("sim"))


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, bands: int = 20, band_rows: int = 4, all_pairs: int = 24) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): (id, fp) of every row, and (node, comp) of each text that has a link."""
    rows = row_keys(docs, id_col, text_col)
    sig = stash(signatures(rows, words, bands, band_rows))
    texts = stash(sig.groupBy("fp").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")).where("n > 0"))
    seats = texts.select(F.col("fp").alias("node"), "n", F.posexplode("bands").alias("band", "key")).select("node", "n", F.xxhash64("band", "key").alias("key"))
    groups = seats.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("center")).where("c > 1")
    seats = stash(seats.join(groups, "key"))
    few = seats.where(F.col("c") <= all_pairs).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("g")).select("g").distinct()
    few = few.select("g", F.explode("g").alias("x")).select("x", F.explode(F.filter("g", lambda y: y["node"] > F.col("x")["node"])).alias("y"))
    close = lambda n, m: F.least(n, m) >= F.lit(threshold) * F.greatest(n, m)
    few = few.where(close(F.col("x.n"), F.col("y.n"))).select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))
    many = stash(seats.where(F.col("c") > all_pairs).select("key", "node", "n", "center"))
    pairs = few.union(many.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b"))).distinct()
    need = seats.select(F.col("node").alias("fp")).distinct().join(texts.select("fp", "id"), "fp")
    text = rows.join(need.select(F.col("id").alias("_id"), F.col("fp").alias("_fp")), F.col("id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left_semi")
    sets = stash(shingle_sets(text.select("fp", "text"), words).dropDuplicates(["node"]))
    tested = stash(verify(pairs, sets))
    if many.isEmpty():
        links = tested.where(F.col("sim") >= threshold).select("a", "b")
        return sig.select("id", "fp"), components(links)
    while True:
        links = tested.where(F.col("sim") >= threshold).select("a", "b")
        labels = components(links)
        degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
        seated = many.join(degree, "node", "left").join(labels, "node", "left")
        seated = stash(seated.select("key", "node", "n", F.coalesce("comp", "node").alias("comp"), F.coalesce("deg", F.lit(0)).alias("deg")))
        hubs = seated.groupBy("key").agg(F.max_by(F.struct("node", "n", "comp"), F.struct("deg", "node")).alias("hub"))
        new = seated.join(hubs, "key").where((F.col("comp") != F.col("hub.comp")) & close(F.col("n"), F.col("hub.n"))).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
        done = tested.select("a", "b").union(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        got = stash(verify(new.join(done, ["a", "b"], "left_anti"), sets))
        if got.where(F.col("sim") >= threshold).isEmpty():
            break
        tested = stash(tested.unionByName(got))
    last = stash(_outside_links(seated, many, sets, threshold))
    if not last.isEmpty():
        labels = components(links.union(last))
    return sig.select("id", "fp"), labels


def _outside_links(seated: DataFrame, many: DataFrame, sets: DataFrame, threshold: float, block: int = 500_000) -> DataFrame:
    """Links of the texts outside the main component of their large groups with all other members.

    Groups that share members form a family. Its members, and the texts outside its main component as queries, are
    dealt into blocks of about ``block`` shingles; each pair of blocks is compared through an inverted
    index, and only one link for each query and component is emitted."""
    family = components(many.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b"))).withColumnRenamed("comp", "family")
    nodes = seated.select("node", "n", "comp").distinct().join(family, "node")
    main = nodes.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("family").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"))
    nodes = stash(nodes.join(main, "family").withColumn("query", F.col("comp") != F.col("main")))
    load = F.ceil(F.sum("n") / F.lit(block)).cast("int")
    deal = nodes.groupBy("family").agg(load.alias("bm"), F.coalesce(F.ceil(F.sum(F.when(F.col("query"), F.col("n"))) / F.lit(block)).cast("int"), F.lit(0)).alias("bq")).where("bq > 0")
    rows = nodes.join(deal, "family")
    some = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    members = rows.select("family", "node", "comp", mine("bm").alias("i"), some("bq").alias("j"), F.lit(False).alias("query"))
    queries = rows.where("query").select("family", "node", "comp", some("bm").alias("i"), mine("bq").alias("j"), F.lit(True).alias("query"))
    both = members.unionByName(queries).join(sets, "node").select("family", "i", "j", "node", "comp", "query", "shingles")

    def run(table: pa.Table) -> pa.Table:
        node, comp = (np.asarray(table.column(c)).astype(np.int64) for c in ("node", "comp"))
        query = np.asarray(table.column("query").combine_chunks().cast(pa.int8())).astype(bool)
        lists = table.column("shingles").combine_chunks()
        off = np.asarray(lists.offsets).astype(np.int64)
        h = np.asarray(lists.values)
        size = np.diff(off)
        owner = np.repeat(np.arange(len(node)), size)
        flat = h[off[0] : off[-1]]
        of = ~query[owner]
        order = np.argsort(flat[of], kind="stable")
        keys, docs = flat[of][order], owner[of][order]
        a, b = [], []
        for q in np.flatnonzero(query):
            x = h[off[q] : off[q + 1]]
            lo, hi = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
            n = hi - lo
            if not n.sum():
                continue
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            both_ = np.bincount(docs[at], minlength=len(node))
            hit = np.flatnonzero((both_ >= threshold * (size + size[q] - both_)) & (comp != comp[q]) & (both_ > 0))
            _, first = np.unique(comp[hit], return_index=True)
            a += [int(node[q])] * len(first)
            b += node[hit[first]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return both.groupBy("family", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document: doc_id, fp, class_id (smallest id of the class) and keep (true for one row's key of the class)."""
    rows, labels = near_links(docs, id_col, text_col, **options)
    named = rows.join(labels, rows["fp"] == labels["node"], "left").select("id", "fp", F.coalesce("comp", "fp").alias("class"))
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "fp"))
    best = named.groupBy("class").agg(first.alias("best"))
    out = named.join(best, "class")
    keep = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("fp") == F.col("best.fp"))
    return out.select(F.col("id").alias("doc_id"), "fp", F.col("best.id").alias("class_id"), keep.alias("keep"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns of ``docs`` for one document of each class."""
    own_id, own_fp, fp = (own_name(n) for n in ("id", "key", "fp"))
    keep = near_duplicates(docs, id_col, text_col, **options).where("keep").select(F.col("doc_id").alias(own_id), F.col("fp").alias(own_fp)).distinct()
    got = docs.withColumn(fp, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    got = got.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.col(fp) == F.col(own_fp)), "left_semi")
    return got.dropDuplicates([id_col, fp]).select(*docs.columns)
