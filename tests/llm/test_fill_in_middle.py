"""The parallel automaton scan and what is built on it, against plain Python over whole texts."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import fill_in_middle as fim

SCHEMA = "doc_id long, text string, n long, row long, form string, output string"


def units_of(text, unit):
    """Byte offsets at which units start."""
    if unit == "chars":
        at = range(len(text))
    elif unit == "words":
        at = sorted({0, *(m.start(1) for m in re.finditer(r"[\t-\r ]([^\t-\r ])", text))}) if text else []
    else:
        at = [m.start() for m in re.finditer(r"[^\n]*\n|[^\n]+\Z", text)]
    return [len(text[:k].encode()) for k in at]


def brute(doc_id, text, unit="chars"):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    raw, at = text.encode(), units_of(text, unit)
    n = len(at)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    place = [*at, len(raw)]
    p, m, s = raw[: place[a]], raw[place[a] : place[b]], raw[place[b] :]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, raw.decode())
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, (b"<S>" + s + b"<P>" + p + b"<M>" + m).decode())
    return (doc_id, n, "psm", a, b - a, (b"<P>" + p + b"<S>" + s + b"<M>" + m).decode())


def texts():
    r = np.random.default_rng(11)
    bits = ["a", "é", "日", "😀", "<", ">", "P", "S", "<<", " ", "\n", "\t\n", "word", "<P"]
    mixed = ["".join(r.choice(bits, int(n))) for n in r.integers(1, 120, 150)]
    return [None, "", "a", "😀", "<P>", "x<S>y", "<M", "<P<S<M", "é" * 100, "<" * 99, ">" * 50, "\n" * 31, *[m for m in mixed if not re.search("<[PSM]>", m)], "a<M>" * 40]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize(("unit", "chunk"), [("chars", 3), ("words", 32), ("lines", 5), ("chars", 1 << 16)])
def test_against_whole_texts(spark, unit, chunk):
    rows = [(k if k % 7 else None, t, 1, 2, "clash", "clash") for k, t in enumerate(texts())] + [(5, "the same é", 0, 0, "", "")] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = fim.transform(df, unit=unit, chunk_bytes=chunk)
    got = fim.texts(made, "output").select("doc_id", "n", "form", "prefix_units", "middle_units", "output").collect()
    want = [brute(d, t, unit) for d, t, *_ in rows]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    back = fim.texts(fim.restore(made), "text").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=key) == sorted(((d, t or "") for d, t, *_ in rows), key=key)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    sums = fim.digest(made).collect()
    assert sorted(map(tuple, sums), key=key) == sorted([(*w[:5], sha(w[5]), sha(t or "")) for w, (d, t, *_) in zip(want, rows)], key=key)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aé😀<>PSM \n", max_size=40), max_size=8), st.sampled_from(fim.UNITS), st.integers(1, 9))
def test_scan_from_any_state(pieces, unit, size):
    """Composed functions equal a byte-by-byte run, from every entry state, and selection finds every unit and marker."""
    auto = fim.automaton(unit, fim.MARKERS)
    chunks = [p.encode()[k : k + size] for p in pieces for k in range(0, max(1, len(p.encode())), size)]
    off = np.concatenate([[0], np.cumsum([len(c) for c in chunks])]).astype(np.int64)
    scan = fim.Scan(auto, np.frombuffer(b"".join(chunks), np.uint8), off)
    f, starts, ends = scan.totals()
    nxt, one, two = auto.step
    for k, c in enumerate(chunks):
        for entry in range(auto.states):
            state, found, marks = entry, [], []
            for at, b in enumerate(c):
                kind = auto.classes[b]
                if one[kind, state]:
                    found.append(at)
                if two[kind, state]:
                    marks.append(at)
                state = nxt[kind, state]
            assert (f[k, entry], starts[k, entry], ends[k, entry]) == (state, len(found), len(marks))
            for what, places in (("starts", found), ("ends", marks)):
                j = np.arange(len(places) + 1)
                at = scan.select(np.full(len(j), k), np.full(len(j), entry), j, what)
                assert list(at) == [*places, len(c)]


def test_states_are_merged_and_bad_options_refused(spark):
    assert fim.automaton("chars", fim.MARKERS).states == 3  # nothing, <, and < with a letter
    with pytest.raises(ValueError):
        fim.Automaton("pages", (b"<P>",))
    with pytest.raises(ValueError):
        fim.Automaton("chars", (b"<P<", b"<S>", b"<M>"))
    none = spark.createDataFrame([], SCHEMA)
    assert fim.digest(fim.transform(none)).count() == 0


def test_other_markers(spark):
    marks = ("[[pre]]", "[[suf]]", "[[mid]]")
    rows = [(k, "some text [[ " * (k + 1)) for k in range(20)]
    made = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), markers=marks, chunk_bytes=20)
    back = fim.texts(fim.restore(made, marks), "text").collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == rows
    assert any("[[suf]]" in r["output"] for r in fim.texts(made, "output").collect())
