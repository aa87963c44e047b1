"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between tags of block elements. Each block becomes a vector of
its hashed tag path (with class, id and role words), its hashed words and a few shape numbers; a
bidirectional LSTM in numpy reads the vectors of a page in order and labels every block as main text or not, with the
whole page as context. It is trained here, once for each process, on pages of a seeded generator that knows the
label of every block it writes; nothing is downloaded, and no table is read for it.

Text inside scripts, styles, comments and other elements that do not show is dropped while cutting. Character
references are decoded, white space inside a block becomes one space, ``<br>`` counts as white
space, and the blocks labelled main are joined by a newline in page order.

Edge cases: a null html is empty and gives an empty text; broken markup (unclosed tags, quotes or comments,
stray end tags) is cut as far as it goes; only comments, scripts, styles, titles, text areas and frames without an end hide
the rest of a page; nesting of any depth is cut in linear time; plain text without tags is one block; null or repeated
ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import U64
from .toxicity import term_hashes

PIECES = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
#: Elements whose content is text up to their own end tag, or else to the page's end.
RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for n in ("script", "style", "title", "textarea", "iframe")}
FOREIGN = frozenset(("svg", "math"))
#: Elements whose content is no text of the page; one without a matching end tag hides nothing.
UNSEEN = frozenset(("svg", "template", "object", "canvas", "select"))
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+", re.I)
#: Elements that start and end a block (the block-level elements of HTML, and those that act so).
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset(("hr", "br", "img", "input", "meta", "link", "source", "wbr", "col", "area", "base", "embed", "param", "track"))
#: The optional end tags of HTML: what a start tag closes, unless the second kind was opened since.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

#: Names that page authors give to containers (fixed values): those of the article, of what is around it, and of either.
MAIN_NAMES = "content article post entry story main body text single page-content post-content entry-content article-body story-body blog-post markdown prose".split()
LAYOUT_NAMES = "box wrap wrapper inner outer col column columns row block module container content-wrap grid cell center centre middle mid left right top-row area section panel pane span layout site page col-md-8 col-sm-4 col-lg-6 text-col container-fluid clearfix flex item card unit".split()
JUNK_NAMES = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topbar tabs pagination pager toc skip".split(),
    "header": "header masthead site-header logo branding top banner hero-title tagline".split(),
    "footer": "footer site-footer bottom colophon copyright legal links credits".split(),
    "aside": "sidebar side aside widget related recommended trending popular also-read more-stories tags".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsense outbrain taboola".split(),
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay paywall banner-notice subscribe newsletter signup".split(),
    "form": "form search login subscribe contact-form newsletter-form signup search-box".split(),
    "comments": "comments comment comment-list replies discussion disqus responses reader-comments comment-body".split(),
    "share": "share social sharing follow buttons author-bio byline meta post-meta".split(),
}
JUNK_TAGS = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "ad": ("div", "aside", "ins"), "notice": ("div", "section", "dialog"), "form": ("form",), "comments": ("section", "div", "ol"), "share": ("div", "ul")}

#: Words of paths with a slot of their own: block elements, the same as innermost one, and the words of the names above. All
#: other words share some slots by hash, so an unknown name is never taken for a known one.
KNOWN = {w: k for k, w in enumerate([*sorted(BLOCK), *(f"^{t}" for t in sorted(BLOCK)), *sorted({f".{w}" for names in (MAIN_NAMES, LAYOUT_NAMES, *JUNK_NAMES.values()) for n in names for w in WORDS.findall(n)})])}
OTHER_SLOTS = 8
PATH_DIMS, WORD_DIMS, SHAPE_DIMS = len(KNOWN) + OTHER_SLOTS, 64, 8
DIMS = PATH_DIMS + WORD_DIMS + SHAPE_DIMS
HIDDEN = 24


def _slot(word: str) -> int:
    k = KNOWN.get(word)
    return len(KNOWN) + zlib.crc32(word.encode()) % OTHER_SLOTS if k is None else k


def shown_pieces(page: str) -> list[tuple[int, int, re.Match | None]]:
    """(start, end, tag) of each piece of markup; what does not show is one piece without a tag."""
    found: list[tuple[int, int, re.Match | None]] = []
    open_: dict[str, list[int]] = {n: [] for n in UNSEEN}
    ends: dict[int, int] = {}
    at = 0
    while m := PIECES.search(page, at):
        at, tag = m.end(), m
        name = (m[2] or "").lower()
        empty = bool(m[3]) and m[3].endswith("/")
        if name in RAW and not m[1]:
            if not (empty and open_["svg"]):
                end = RAW[name].search(page, at)
                at, tag = end.end() if end else len(page), None
        elif name in UNSEEN:
            if m[1]:
                if open_[name]:
                    ends[open_[name].pop()] = len(found)
            elif not (empty and name in FOREIGN):
                open_[name].append(len(found))
        found.append((m.start(), at, tag))
    if not ends:
        return found
    out, k = [], 0
    while k < len(found):
        last = ends.get(k)
        out.append(found[k] if last is None else (found[k][0], found[last][1], None))
        k = k + 1 if last is None else last + 1
    return out


class Path:
    """The open elements, and the vector of their tags and names: a slot counts the different words of it that are open.

    A word changes the vector when its first element opens and its last one closes, so deep nesting costs no more than flat markup."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.open: dict[str, list[int]] = {}
        self.times: dict[int, int] = {}
        self.vector = np.zeros(PATH_DIMS, np.float32)
        self._kept: np.ndarray | None = None

    def push(self, name: str, words: tuple[str, ...]) -> None:
        slots = tuple(_slot(w) for w in {name, *words})
        for k in slots:
            self.times[k] = n = self.times.get(k, 0) + 1
            if n == 1:
                self.vector[k] = 1
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, slots))
        self._kept = None

    def cut(self, at: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.stack) > at:
            name, slots = self.stack.pop()
            self.open[name].pop()
            for k in slots:
                self.times[k] -= 1
                if not self.times[k]:
                    self.vector[k] = 0
        self._kept = None

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names, -1 if none is open."""
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=-1)

    def kept(self) -> np.ndarray:
        """The vector now, with the innermost element's tag once more."""
        if self._kept is None:
            self._kept = self.vector.copy()
            if self.stack:
                self._kept[_slot("^" + self.stack[-1][0])] += 1
        return self._kept


def cut_blocks(page: str) -> list[tuple[str, np.ndarray, float]]:
    """(text, path vector, share of the text inside links) of each leaf block that has text."""
    out: list[tuple[str, np.ndarray, float]] = []
    path = Path()
    parts: list[str] = []
    linked = link = 0

    def flush():
        nonlocal linked
        text = "".join(parts)
        parts.clear()
        if "&" in text:
            text = _html.unescape(text)
        text = " ".join(text.split())
        if text:
            out.append((text, path.kept(), min(1.0, linked / len(text))))
        linked = 0

    at = 0
    for start, end, m in shown_pieces(page):
        if start > at:
            parts.append(page[at:start])
            if link:
                linked += start - at
        at = end
        if m is None or m[2] is None:
            continue
        name = m[2].lower()
        if name == "a":
            link = 0 if m[1] else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            flush()
            link = 0
            if m[1]:
                if (k := path.last(name)) >= 0:
                    path.cut(k)
                continue
            if path.stack and path.stack[-1][0] == "p":
                path.cut(len(path.stack) - 1)
            if name in CLOSES:
                closes, inside = CLOSES[name]
                if (k := path.last(*closes)) > path.last(*inside):
                    if name == "tr" and (row := path.last("tr")) > path.last(*inside):
                        k = row
                    path.cut(k)
            if name not in VOID:
                words = tuple(f".{w.lower()}" for g in NAMES.findall(m[3]) for w in WORDS.findall("".join(g))) if m[3] and "=" in m[3] else ()
                path.push(name, words)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def block_vectors(blocks: list[tuple[str, np.ndarray, float]], place: np.ndarray) -> np.ndarray:
    """One row for each block; ``place`` is its relative position in its page."""
    n = len(blocks)
    x = np.zeros((n, DIMS), np.float32)
    for k, (_, path, _) in enumerate(blocks):
        x[k, :PATH_DIMS] = path
    raw = [t.encode() for t, _, _ in blocks]
    size = np.array([len(r) for r in raw], np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    off = np.concatenate([[0], np.cumsum(size)])
    doc, h = term_hashes(buf, off)
    words = np.bincount(doc, minlength=n)
    grid = np.bincount(doc * WORD_DIMS + (h % U64(WORD_DIMS)).astype(np.int64), minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    at = PATH_DIMS
    x[:, at : at + WORD_DIMS] = grid / np.sqrt(np.maximum(words, 1))[:, None] / 2
    at += WORD_DIMS
    mark = np.isin(buf, np.frombuffer(b".,;:!?", np.uint8))
    marks = np.add.reduceat(mark, off[:-1]) if n else np.zeros(0)
    x[:, at] = np.log1p(words) / 4
    x[:, at + 1] = [b[2] for b in blocks]
    x[:, at + 2] = marks / np.maximum(words, 1)
    x[:, at + 3] = [t[-1] in ".!?:;\"'" for t, _, _ in blocks]
    x[:, at + 4] = place
    x[:, at + 5] = words <= 3
    x[:, at + 6] = [t[0].isupper() for t, _, _ in blocks]
    x[:, at + 7] = ["©" in t for t, _, _ in blocks]
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one logistic output for each block."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"w{d}": init(DIMS, 4 * HIDDEN), f"u{d}": init(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"o": init(2 * HIDDEN, 1)[:, 0], "v": np.zeros(DIMS, np.float32), "b": np.zeros(1, np.float32)}

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, page, HIDDEN); padded places keep the state."""
        steps, n, _ = x.shape
        z = (x.reshape(-1, DIMS) @ self.p[f"w{d}"] + self.p[f"c{d}"]).reshape(steps, n, -1)
        u = self.p[f"u{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ u
            s = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            h2 = o * tc
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, h2, h), np.where(m, c2, c)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._direction(x, mask, "f"), self._direction(x, mask, "b")], axis=2)
        return h @ self.p["o"] + x @ self.p["v"] + self.p["b"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        saved: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._direction(x, mask, d, saved[d]) for d in "fb"], axis=2)
        q = _sigmoid(h @ self.p["o"] + x @ self.p["v"] + self.p["b"])
        total = mask.sum()
        loss = -np.log(np.where(y, q, 1 - q) + 1e-9)[mask].sum() / total
        e = ((q - y) * mask / total).astype(np.float32)
        grad = {"o": np.einsum("tn,tnh->h", e, h), "v": np.einsum("tn,tnd->d", e, x), "b": np.array([e.sum()])}
        for k, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            out = e[:, :, None] * self.p["o"][None, None, k * HIDDEN : (k + 1) * HIDDEN]
            gz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gu = np.zeros_like(u)
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h0, c0, i, f, o, g, tc, m in reversed(saved[d]):
                dh = dh + out[t]
                dh2, dc2 = np.where(m, dh, 0), np.where(m, dc, 0)
                dct = dc2 + dh2 * o * (1 - tc * tc)
                da = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), dh2 * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                gz[t] = da
                gu += h0.T @ da
                dh = np.where(m, da @ u.T, dh)
                dc = np.where(m, dct * f, dc)
            grad |= {f"u{d}": gu, f"w{d}": x.reshape(-1, DIMS).T @ gz.reshape(-1, 4 * HIDDEN), f"c{d}": gz.sum(axis=(0, 1))}
        return float(loss), grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


# -- training pages ---------------------------------------------------------------------------------------------

class PageWriter:
    """Writes pages whose blocks have known labels."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.vocabulary = [self._word() for _ in range(6000)]
        self.plain = False

    def _word(self) -> str:
        parts = ("an", "er", "th", "ti", "re", "ou", "en", "st", "ha", "é", "ll", "ch", "ber", "os", "ing", "ö", "ci", "que", "mo", "lu")
        word = "".join(self.pick(parts) for _ in range(self.r.randint(1, 4)))
        return word + (self.pick((",", ".", "!!", "***", "&amp;", "%", ",", ".")) if self.r.random() < 0.2 else "")

    def pick(self, some):
        return some[int(self.r.random() * len(some))]

    def words(self, low: int, high: int) -> str:
        out = self.r.choices(self.vocabulary, k=self.r.randint(low, high))
        out[0] = out[0].capitalize()
        return " ".join(out)

    def unknown(self) -> str:
        """A name that no author has told us about."""
        name = "".join(self.pick("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randint(1, 9)))
        return name + self.pick(("", "", "-", "__", "-")) + self.pick(("", "1", "x", "main"[: self.r.randint(0, 3)]))

    def loose(self) -> str:
        """A name that tells nothing: of the layout, or an unknown one."""
        return self.pick(LAYOUT_NAMES) if self.r.random() < 0.55 else self.unknown()

    def named(self, *names: str) -> str:
        some = [n for n in names if n]
        self.r.shuffle(some)
        return f' {self.pick(("class", "class", "class", "id"))}="{" ".join(some)}"' if some else ""

    def attrs(self, names) -> str:
        """A telling name, in a third of the cases with one that tells nothing beside it."""
        if self.r.random() < 0.12:
            return ""
        return self.named(self.pick(names), self.loose() if self.r.random() < 0.33 else "")

    def main_block(self) -> tuple[str, list[str]]:
        k, r = self.r.random(), self.r.random
        if self.plain and k < 0.72:
            t = self.words(5, 60) + self.pick((".", ".", "!", ""))
            return f"<div>{t}</div>", [t]
        if k < 0.72:
            t = self.words(1, 4) if r() < 0.2 else self.words(5, 60)
            t += self.pick((".", ".", ".", "!", "", ":"))
            if r() < 0.15:
                t = f'{t} <a href="/x">{self.words(1, 3)}</a> {self.words(1, 8)}.'
            if r() < 0.15:
                return f"<p><b>{t}<br>" + ("</p>" if r() < 0.3 else ""), [t]
            return f"<p>{t}" + ("</p>" if r() < 0.9 else ""), [t]
        if k < 0.82:
            t = self.words(2, 9)
            h = self.pick(("h2", "h3", "h4"))
            return f"<{h}>{t}</{h}>", [t]
        if k < 0.9:
            items = [self.words(2, 15) for _ in range(self.r.randint(2, 5))]
            tag = self.pick(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{i}</li>" for i in items) + f"</{tag}>", items
        if k < 0.925:
            terms = [(self.words(1, 3), self.words(3, 20)) for _ in range(self.r.randint(1, 4))]
            end = self.r.random() < 0.8
            return "<dl>" + "".join(f"<dt>{a}" + "</dt>" * end + f"<dd>{b}" + "</dd>" * end for a, b in terms) + "</dl>", [t for pair in terms for t in pair]
        if k < 0.94:
            head, t = self.words(1, 6), self.words(4, 40) + "."
            return f"<details><summary>{head}</summary><p>{t}</p></details>", [head, t]
        if k < 0.95:
            t = self.words(3, 15)
            return f"<figure><img src=x><figcaption>{t}</figcaption></figure>", [t]
        if k < 0.965:
            t = self.words(8, 40)
            return f"<blockquote>{t}</blockquote>", [t]
        if k < 0.98:
            rows = [[self.words(1, 4) for _ in range(2)] for _ in range(self.r.randint(1, 3))]
            return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</table>", [c for row in rows for c in row]
        t = self.words(3, 20)
        return f"<pre>{t}</pre>", [t]

    def junk(self, kind: str) -> tuple[str, list[str]]:
        tag, texts, inner = self.pick(JUNK_TAGS[kind]), [], ""
        r = self.r.random
        if kind in ("nav", "footer") and r() < 0.15:  # a line of links without names
            sep, some = self.pick((" ", " | ", " - ")), [self.words(1, 2) for _ in range(self.r.randint(2, 6))]
            tag = self.pick(("div", "p", "td"))
            return f"<{tag}>" + sep.join(f'<a href="/{k}">{t}</a>' for k, t in enumerate(some)) + f"</{tag}>", [sep.join(some)]

        def add(t: str) -> str:
            texts.append(t)
            return t

        if kind == "nav" or (kind in ("footer", "aside", "share") and r() < 0.5):
            n = self.r.randint(2, 8)
            items = "".join(f'<li><a href="/{k}">{add(self.words(1, 3 if kind == "nav" else 8))}</a></li>' for k in range(n))
            inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
            if r() < 0.2 and kind != "nav" and tag not in ("ul", "ol"):
                inner = f"<h3>{add(self.words(1, 3))}</h3>" + inner
        elif kind == "header":
            inner = f'<{self.pick(("h1", "div", "p", "h2"))}>{add(self.words(1, 5))}</div>' if r() < 0.7 else f'<a href="/">{add(self.words(1, 3))}</a>'
            if r() < 0.4:
                inner += f"<p>{add(self.words(2, 9))}</p>"
        elif kind == "form":
            inner = "".join(f"<label>{add(self.words(1, 4))}</label><input name=q>" for _ in range(self.r.randint(1, 3))) + f"<button>{add(self.words(1, 2))}</button>"
            if r() < 0.4:
                inner = f"<p>{add(self.words(4, 20))}.</p>" + inner
        elif kind == "comments":
            if tag != "ol" and r() < 0.5:
                inner = f"<h3>{add(self.words(1, 4))}</h3>"
            for _ in range(self.r.randint(1, 5)):
                one = f"<p>{add(self.words(4, 50))}.</p>"
                if r() < 0.5:
                    one = f"<div>{add(self.words(1, 3))}</div>" + one
                inner += f"<li>{one}</li>" if tag == "ol" else f"<div{self.attrs(JUNK_NAMES['comments'])}>{one}</div>"
        elif kind == "footer":
            inner = f"&copy; {add('© ' + self.words(1, 6))[2:]}" if r() < 0.6 else f"<p>{add(self.words(3, 25))}.</p>"
            if r() < 0.3:
                inner += f"<p>{add(self.words(2, 12))}</p>"
        else:
            inner = add(self.words(2, 30) + self.pick((".", "", "!"))) if r() < 0.5 else f"<p>{add(self.words(2, 30))}.</p>"
            if r() < 0.3:
                inner += f'<p><a href="/y">{add(self.words(1, 6))}</a></p>'
        names = JUNK_NAMES[kind]
        own = self.attrs(names)
        if kind in ("nav", "header", "footer", "form") and r() < 0.15:  # told by what is in them
            own = self.named(self.loose())
        elif not own and tag in ("div", "section", "ul", "ol", "ins", "dialog", "form") and kind != "form":
            own = self.named(self.pick(names))
        return f"<{tag}{own}>{inner}</{tag}>", texts

    def page(self) -> tuple[str, list[tuple[str, bool]]]:
        r, out, labels = self.r.random, [], []

        def put(piece: tuple[str, list[str]], main: bool):
            out.append(piece[0])
            labels.extend((t, main) for t in piece[1])

        before = [k for k in ("header", "nav", "notice", "form", "ad", "nav", "share") if r() < (0.7 if k == "nav" else 0.35)]
        self.r.shuffle(before)
        kind = self.pick(("article", "article", "article", "main", "main-article", "div", "section", "role", "wrap", "bare", "bare", "bare", "loose", "loose", "loose", "loose"))
        shut = {"article": ("<article>", "</article>"), "main": ("<main>", "</main>"), "main-article": ("<main><article>", "</article></main>"), "section": (f'<section class="{self.pick(MAIN_NAMES)}">', "</section>"), "role": ('<div role="main">', "</div>")}
        opened, closed = shut.get(kind, (f"<div{self.named(self.pick(MAIN_NAMES), self.loose() if r() < 0.33 else '')}>", "</div>"))
        if kind == "loose":  # containers whose names tell nothing
            depth = self.pick((1, 1, 2, 3))
            opened, closed = "".join(f"<div{self.named(self.loose(), self.loose() if r() < 0.4 else '')}>" for _ in range(depth)), "</div>" * depth
        if kind == "bare":  # no element or name tells the article
            opened, closed = self.pick((("", ""), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("<table><tr><td>", "</td></tr></table>"), ("<center>", "</center>")))
            if r() < 0.4:
                before = []
        if kind == "wrap":
            opened, closed = f'<div class="wrap">{opened}<article>', f"</article>{closed}</div>"
        wide, beside = ("", ""), ("", "")  # columns around the article, around what follows, and around all
        if r() < 0.3:
            opened, closed = f"<div{self.named(self.loose())}>{opened}", f"{closed}</div>"
            beside = (f"<div{self.named(self.loose())}>", "</div>") if r() < 0.5 else beside
            wide = (f"<div{self.named(self.loose())}>", "</div>") if r() < 0.7 else wide
        out.append(wide[0])
        for k in before:
            put(self.junk(k), False)
        if r() < (0.1 if kind in ("bare", "loose") else 0.3):
            put(self.junk("aside"), False)
        out.append(opened)
        if r() < 0.85:
            t, h = self.words(2, 12), "h2" if kind in ("bare", "loose") and r() < 0.3 else "h1"
            put((f"<div><{h}>{t}</{h}></div>" if r() < 0.1 else f"<{h}>{t}</{h}>", [t]), True)
        split = r() < 0.1  # paragraphs in a division of their own
        out.append(f"<div{self.named(self.loose()) if r() < 0.5 else ''}>" * split)
        self.plain = r() < 0.12  # divisions instead of paragraphs
        if r() < 0.2:
            put(self.junk("share"), False)
        for _ in range(self.r.randint(1, 21) if r() < 0.9 else 1):
            put(self.main_block(), True)
            if r() < 0.05:
                put(self.junk(self.pick(("ad", "aside", "notice", "share", "form"))), False)
        if r() < 0.12:
            put(self.junk("share"), False)
        out.append("</div>" * split + closed)
        after = [k for k in ("comments", "aside", "ad", "share", "form", "notice", "nav", "footer") if r() < {"footer": 0.8, "comments": 0.35}.get(k, 0.25)]
        if kind in ("bare", "loose") and r() < 0.6:
            after = []
        out.append(beside[0])
        for k in after:
            put(self.junk(k), False)
        out.append(beside[1] + wide[1])
        end = "</body></html>" if r() < 0.9 else ""
        return f'<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{"".join(out)}{end}', labels


def written_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vectors, labels) of pages whose blocks are cut as they were written."""
    writer, out = PageWriter(seed), []
    plain = lambda t: " ".join(_html.unescape(re.sub(r"<[^>]*>", "", t)).split()).rstrip(".!")
    while len(out) < n:
        page, labels = writer.page()
        blocks = cut_blocks(page)
        if [plain(t) for t, _ in labels] == [b[0].rstrip(".!") for b in blocks]:
            out.append((block_vectors(blocks, np.arange(len(blocks)) / len(blocks)), np.array([m for _, m in labels])))
    return out


def train_labeller(pages: int = 3000, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 1) -> Labeller:
    data = written_pages(pages, seed)
    net, rng = Labeller(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    data.sort(key=lambda d: len(d[1]))
    steps = epochs * -(-len(data) // batch)
    t = 0
    for _ in range(epochs):
        for b in rng.permutation(-(-len(data) // batch)):
            some = data[b * batch : (b + 1) * batch]
            x, mask = padded([d[0] for d in some])
            y = np.zeros(mask.shape, bool)
            for k, d in enumerate(some):
                y[: len(d[1]), k] = d[1]
            _, grad = net.gradients(x, mask, y)
            t += 1
            for k in net.p:
                g = np.clip(grad[k], -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] -= (rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


_trained: list[Labeller] = []


def trained_labeller() -> Labeller:
    if not _trained:
        _trained.append(train_labeller())
    return _trained[0]


def main_texts(pages: list[str], net: Labeller, cells: int = 12_000) -> list[str]:
    """The main text of each page."""
    cut = [cut_blocks(p) for p in pages]
    flat = [b for c in cut for b in c]
    if not flat:
        return [""] * len(pages)
    place = np.concatenate([np.arange(len(c)) / max(1, len(c)) for c in cut])
    x = block_vectors(flat, place)
    edge = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
    main = np.zeros(len(flat), bool)
    order = sorted((k for k in range(len(cut)) if cut[k]), key=lambda k: len(cut[k]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(cut[order[to]]) <= cells:
            to += 1
        got, mask = padded([x[edge[k] : edge[k + 1]] for k in order[at:to]])
        z = net.logits(got, mask) > 0
        for j, k in enumerate(order[at:to]):
            main[edge[k] : edge[k + 1]] = z[: len(cut[k]), j]
        at = to
    return ["\n".join(b[0] for b, keep in zip(c, main[edge[k] : edge[k + 1]]) if keep) for k, c in enumerate(cut)]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", net: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points of the text)."""
    net = net or trained_labeller()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    out = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = main_texts([h or "" for h in part.column(2).to_pylist()], net)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in out.fields])

    return rows.mapInArrow(run, out)
