"""Quality rules: text statistics and a decision list learned from labelled ones.

Sequential covering for the class "bad": a rule is grown condition by condition (statistic at or
over, or at or under, a threshold) by information gain on two thirds of the labelled rows, pruned
from its end on the last third, kept if it is mostly right there, and the rows it covers are
removed before the next rule. The list becomes one ordered Spark conditional expression.

The fit takes about ``max_rows`` labelled rows at most, chosen by the hash of their id, to the driver (20,000 rows of about
15 numbers); statistics and verdicts cover every row.

Edge cases: null and empty texts have all counts 0 (and so fail the base rule of 50 words); null or
repeated ids are kept; without labels, or with one class only, the list is empty and everything
is kept; an empty table gives no rows. Lines and word windows are compared by 64-bit hashes of
their bytes within one text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_sample, gram_hashes, mix, prefix_hash, range_hash, slices, stash, word_bounds

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_short_lines")
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"


def _lut(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


_SYMBOL, _MARK = _lut(SYMBOLS), _lut(MARKS)
_UPPER, _DIGIT = _lut(bytes(range(65, 91))), _lut(bytes(range(48, 58)))


def _per_text(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def _repeated(key: np.ndarray) -> np.ndarray:
    """True where the same key stands elsewhere too."""
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.empty(len(k), bool)
    out[order] = same[:-1] | same[1:]
    return out


def count_statistics(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    s, e, doc = word_bounds(buf, off)
    c = prefix_hash(buf)
    ink = np.zeros(len(buf) + 1, np.int8)
    np.add.at(ink, s, 1)
    np.subtract.at(ink, e, 1)
    inside = np.cumsum(ink[:-1]).astype(bool)
    h = range_hash(c, s, e)
    g, at = gram_hashes(h, doc, 3)
    dup = at[_repeated(mix(g + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))] if len(g) else at
    mark = np.zeros(len(s), bool)
    for k in range(3):
        mark[dup + k] = True
    # lines: a text starts one, and so does every newline
    newline = np.flatnonzero(buf == 10)
    begin = np.concatenate([off[:-1], newline + 1])
    line_doc = np.concatenate([np.arange(n), np.searchsorted(off, newline, "right") - 1])
    order = np.lexsort((begin, line_doc))
    begin, line_doc = begin[order], line_doc[order]
    last = np.ones(len(begin), bool)
    last[:-1] = line_doc[1:] != line_doc[:-1]
    end = np.where(last, off[line_doc + 1], np.append(begin[1:], 0) - 1)
    words = np.searchsorted(s, end) - np.searchsorted(s, begin)
    full = words > 0
    ld, lh = line_doc[full], mix(range_hash(c, begin[full], end[full]) + line_doc[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(lh, return_index=True)
    later = np.ones(len(lh), bool)
    later[first] = False
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": _per_text(inside & ((buf & 0xC0) != 0x80), off),
        "n_symbols": _per_text(_SYMBOL[buf], off),
        "n_dup_lines": np.bincount(ld[later], minlength=n),
        "n_repeat_words": np.bincount(doc[mark], minlength=n),
        "n_lines": np.bincount(ld, minlength=n),
        "n_upper": _per_text(_UPPER[buf], off),
        "n_digits": _per_text(_DIGIT[buf], off),
        "n_marks": _per_text(_MARK[buf], off),
        "n_short_lines": np.bincount(ld[words[full] < 5], minlength=n),
    }


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts, one row for each text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in slices(batches):
            got = count_statistics(buf, off)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    return rows.mapInArrow(run, out)


def shares() -> dict[str, Column]:
    """The statistics that conditions are about."""
    one = F.lit(1)
    words, chars, lines = F.greatest("n_words", one), F.greatest("word_chars", one), F.greatest("n_lines", one)
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / words,
        "upper": F.col("n_upper") / chars,
        "digits": F.col("n_digits") / chars,
        "marks": F.col("n_marks") / words,
        "line_words": F.col("n_words") / lines,
        "short_lines": F.col("n_short_lines") / lines,
    }


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    threshold: float

    def column(self, stats: dict[str, Column]) -> Column:
        return stats[self.name] >= F.lit(self.threshold) if self.at_least else stats[self.name] <= F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.threshold if self.at_least else x[self.name] <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Sequence[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, left: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[Condition]:
    rule: list[Condition] = []
    cover = left.copy()
    while len(rule) < most:
        p0, n0 = int((cover & y).sum()), int((cover & ~y).sum())
        if not p0 or not n0:
            break
        before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, values in cuts.items():
            v = x[name][cover]
            bad = y[cover]
            order = np.argsort(v, kind="stable")
            v, b = v[order], np.concatenate([[0], np.cumsum(bad[order])])
            below = np.searchsorted(v, values, "right")
            under = np.searchsorted(v, values, "left")
            for at_least, p, total in ((False, b[below], below), (True, p0 - b[under], len(v) - under)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(total, 1)) - before), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Condition(name, at_least, float(values[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        cover &= best[1].holds(x)
    return rule


def _prune(rule: list[Condition], x: dict[str, np.ndarray], y: np.ndarray, left: np.ndarray) -> tuple[list[Condition], float, int]:
    best = ([], 0.0, 0)
    for k in range(1, len(rule) + 1):
        cover = _covers(rule[:k], x, len(y)) & left
        p, n = int((cover & y).sum()), int((cover & ~y).sum())
        right = (p + 1) / (p + n + 2)
        if right > best[1]:
            best = (rule[:k], right, p)
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, min_right: float = 0.9, n_cuts: int = 64) -> list[Rule]:
    """Rules for ``bad``, in the order found; rows are taken in the order given, every third prunes."""
    n = len(bad)
    rules: list[Rule] = []
    if n < 30 or bad.all() or not bad.any():
        return rules
    prune = np.arange(n) % 3 == 2
    cuts = {k: np.unique(np.quantile(v, np.linspace(0.005, 0.995, n_cuts))) for k, v in x.items()}
    left = np.ones(n, bool)
    while len(rules) < max_rules:
        rule = _grow(x, bad, left & ~prune, cuts, max_conditions)
        if not rule:
            break
        rule, right, hits = _prune(rule, x, bad, left & prune)
        if not rule or right < min_right or hits < 2:
            break
        rules.append(tuple(rule))
        left &= ~_covers(rule, x, n)
    return rules


def verdict(rules: Sequence[Rule], stats: dict[str, Column]) -> Column:
    """The list as one conditional expression: true keeps, the first rule that holds rejects."""
    out = None
    for rule in rules:
        test = rule[0].column(stats)
        for c in rule[1:]:
            test = test & c.column(stats)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit_rules(stats: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000, **options) -> list[Rule]:
    """Learn from the labelled rows of ``stats``; a label of 0 is bad."""
    given = labels.where(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label_col).alias("_label"))
    names = shares()
    given = bounded_sample(given, "_id", max_rows)
    rows = stats.join(F.broadcast(given), F.col("doc_id") == F.col("_id")).select(F.xxhash64("doc_id").alias("_h"), "_label", *[c.alias(k) for k, c in names.items()])
    got = rows.toPandas().sort_values(["_h", *names])
    return learn_rules({k: got[k].to_numpy(float) for k in names}, (got["_label"] == 0).to_numpy(), **options)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, the counts, base_failed and kept."""
    stats = stash(text_statistics(docs, id_col, text_col))
    rules = fit_rules(stats, labels, **options)
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return stats.withColumn("base_failed", base).withColumn("kept", ~base & verdict(rules, shares()))
