"""Mixing sources to target weights by a time-varying curriculum, with DataFrame operations only.

Each source has a weight schedule over training progress 0..1, piecewise linear between knots. Its
integral is the source's share of the mix; a source's demand stops at ``max_epochs`` times its
size and the excess goes to the others by weight. Documents of a source stand in hash order;
a document's tokens (here: words) cover a range of the source's cumulative size, once for each
pass, and its training position is where the source's cumulative demand reaches that range: the
inverse of the integrated schedule. Sorting all documents by position yields the curriculum.

Prefix sums are taken in two levels, over (source, hash bucket) and within buckets, with as many
buckets as the square root of the row count, so a source that holds most rows is spread evenly.

Edge cases: null texts and texts without words have size 0, take nothing and get no position; the
null source is a source of its own, last in order; sources whose size is 0 have target 0; null or
repeated ids are kept, and equal rows share their hash place and are interchangeable; an empty table
gives no rows. The boundary document of a source is taken in part, so that the words taken equal
the rounded target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import own_name, stash

WORD = r"[^\x20\x09-\x0D]+"
Schedule = Sequence[tuple[float, float]]


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 09-0D and 20; null: 0."""
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.regexp_count(blank, F.lit("[^ ]+")), F.lit(0)).cast("long")


def integral(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(start, weight at start, slope, integral before) of each piece."""
    out, total = [], 0.0
    for (a, wa), (b, wb) in zip(schedule, schedule[1:]):
        if not (b > a and wa >= 0 and wb >= 0):
            raise ValueError("knots must ascend and weights must not be negative")
        out.append((float(a), float(wa), (wb - wa) / (b - a), total))
        total += (wa + wb) / 2 * (b - a)
    if schedule[0][0] != 0 or schedule[-1][0] != 1 or total <= 0:
        raise ValueError("a schedule runs from 0 to 1 and has a positive integral")
    return out


def area(schedule: Schedule) -> float:
    return sum((wa + wb) / 2 * (b - a) for (a, wa), (b, wb) in zip(schedule, schedule[1:]))


def inverse(schedule: Schedule, share: Column) -> Column:
    """Progress at which the schedule's integral reaches ``share`` of its whole."""
    pieces, whole = integral(schedule), area(schedule)
    want = share * F.lit(whole)
    out = None
    for start, w, slope, before in reversed(pieces):
        rest = F.greatest(want - F.lit(before), F.lit(0.0))
        root = F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + F.lit(2.0 * slope) * rest, F.lit(0.0)))
        x = F.lit(start) + F.when(root > 0, F.lit(2.0) * rest / root).otherwise(F.lit(0.0))
        out = x if out is None else F.when(want < F.lit(nxt), x).otherwise(out)  # noqa: F821
        nxt = before  # noqa: F841
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def targets(sizes: DataFrame, schedules: Sequence[Schedule], max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> with weight, kind (number of its schedule) and target.

    One row for each source. Water filling: with sources ordered by size over weight, the first
    place where the remaining words over the remaining weight stay under the cap gives the level;
    sources before it take their cap and the others weight times level.
    """
    n = len(schedules)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(order) - 1) % n
    weights = F.array(*[F.lit(area(s)) for s in schedules])
    rows = sizes.select("source", "source_size", kind.alias("kind")).withColumn("weight", F.get(weights, F.col("kind")))
    cap = (F.lit(max_epochs) * F.col("source_size")).cast("double")
    by_ratio = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    rest = F.sum("source_size").over(all_rows).cast("double") - F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = rest / weight_left
    rows = rows.withColumn("_level", F.when(level <= cap / F.col("weight"), level))
    rows = rows.withColumn("_level", F.first("_level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(cap, F.col("weight") * F.coalesce(F.col("_level"), F.lit(float("inf"))))
    return rows.select("source", "source_size", "kind", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, schedules: Sequence[Schedule], max_epochs: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", by_text: bool = False) -> DataFrame:
    """One row for each document: source, size, source_size, target, taken, passes (taken words and
    position of each pass) and position (of the first pass), in the order of position; with ``by_text`` also fp, the text's hash."""
    size = word_count(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *([F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("fp")] if by_text else []))
    tie = ["fp"] if by_text else []
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = stash(rows)
    # a third of the rows may have one source: buckets by the square root of all rows
    buckets = max(1, round(rows.count() ** 0.5))
    bucket = F.shiftright(F.conv(F.substring(F.col("place"), 1, 8), 16, 10).cast("long") * F.lit(buckets), 32)
    rows = rows.withColumn("place", place).withColumn("bucket", bucket)
    small = rows.groupBy("source", "bucket").agg(F.sum("size").alias("_n"))
    by_source = Window.partitionBy("source").orderBy("bucket")
    small = small.withColumn("_before", F.coalesce(F.sum("_n").over(by_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    aims = targets(small.groupBy("source").agg(F.sum("_n").alias("source_size")), schedules, max_epochs)
    aims = aims.withColumnRenamed("source", "_source")
    heads = small.join(aims, small["source"].eqNullSafe(aims["_source"])).select("source", "bucket", "_before", "source_size", "kind", "target")
    heads = heads.withColumnsRenamed({"source": "_s", "bucket": "_b"})
    rows = rows.join(heads, rows["source"].eqNullSafe(heads["_s"]) & (rows["bucket"] == heads["_b"]))
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size", *tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    aim = F.round("target").cast("long")

    def one(epoch: int) -> Column:
        start = F.col("_at") + F.lit(epoch) * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), aim - start))
        share = F.when(F.col("target") > 0, start.cast("double") / F.col("target")).otherwise(F.lit(0.0))
        where = None
        for k, s in enumerate(schedules):
            where = F.when(F.col("kind") == k, inverse(s, share)) if where is None else where.when(F.col("kind") == k, inverse(s, share))
        return F.struct(words.alias("words"), where.alias("position"))

    rows = rows.withColumn("passes", F.filter(F.array(*[one(e) for e in range(max_epochs)]), lambda p: p["words"] > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    rows = rows.select("doc_id", "source", "size", *tie, "source_size", "target", taken.alias("taken"), "passes", F.get("passes", 0)["position"].alias("position"))
    return rows.repartitionByRange(F.col("position").asc_nulls_last(), F.md5(F.col("doc_id").cast("string").cast("binary"))).sortWithinPartitions(F.col("position").asc_nulls_last())


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each pass over a document, sorted by training position."""
    rows = mixed.select("doc_id", "source", F.posexplode("passes").alias("pass", "p")).select("doc_id", "source", "pass", "p.words", "p.position")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def _ranked(rows: DataFrame, key: str, rank: str, *by) -> DataFrame:
    """``rows`` with a number from 1 on among the rows of a key.

    A key is dealt over 64 shares by the hash of ``by``, and shares start where the ones before end. Nothing but content deals rows out, so
    that a repeated run gives the same numbers; rows equal in all of ``by`` are numbered in one share, streamed and not gathered."""
    share, n, before, other, twin = (own_name(x) for x in ("share", "n", "before", "other", "twin"))
    rows = rows.withColumn(share, F.pmod(F.xxhash64(*by), F.lit(64)))
    parts = rows.groupBy(F.col(key).alias(other), F.col(share).alias(twin)).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(other).orderBy(twin).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(other, twin, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before)).where(F.col(before) > 0)
    rows = rows.join(parts, (F.col(key) == F.col(other)) & (F.col(share) == F.col(twin)), "left")
    own = F.row_number().over(Window.partitionBy(key, share).orderBy(F.xxhash64(*by)))
    return rows.withColumn(rank, own + F.coalesce(F.col(before), F.lit(0))).drop(share, before, other, twin)


def take_mix(docs: DataFrame, schedules: Sequence[Schedule], max_epochs: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, one row for each pass of the mix over a document, in training order.

    A pass that takes fewer words than the text has keeps the text up to its last taken word. Rows equal in id, source and text have
    places of their own in the mix: each of them takes the passes of one place."""
    key = lambda i, s, n, fp: F.xxhash64(F.col(i).isNull(), i, F.col(s).isNull(), s, n, fp)
    i, src, size, fp, k, key_, rank, turn, passes, p, at = (own_name(n) for n in ("id", "source", "size", "fp", "k", "key", "rank", "turn", "passes", "pass", "at"))
    mixed = mix_sources(docs, schedules, max_epochs, id_col, source_col, text_col, by_text=True).where("taken > 0")
    some = _ranked(mixed.select(key("doc_id", "source", "size", "fp").alias(key_), "position", F.col("passes").alias(passes)), key_, rank, "position").select(key_, rank, passes)
    rows = docs.withColumns({i: F.col(id_col).cast("long"), src: F.col(source_col).cast("string"), size: word_count(F.col(text_col).cast("string")), fp: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    rows = rows.where(F.col(size) > 0).withColumn(k, key(i, src, size, fp))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    rows = _ranked(rows, k, turn, *plain)
    rows = rows.join(some, (F.col(k) == F.col(key_)) & (F.col(turn) == F.col(rank))).withColumn(p, F.explode(passes))
    # pieces of white space and the word after it; joined they are the text as it is
    pieces = F.split(F.col(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(F.col(f"{p}.words") < F.col(size), F.array_join(F.slice(pieces, F.lit(1), F.col(f"{p}.words").cast("int")), "")).otherwise(F.col(text_col))
    rows = rows.withColumn(text_col, cut).withColumn(at, F.col(f"{p}.position"))
    return rows.repartitionByRange(at, i).sortWithinPartitions(at, i).select(*docs.columns)
