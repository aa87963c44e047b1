"""Names of containers, nesting and optional end tags: what the extractor must not depend on."""

import time

import pytest

from tidewater.llm import html_extract as h

#: Names of layouts and made-up ones, that tell nothing about what is in them.
NAMES = "col col-md-8 inner center mid text-col left right row grid wrapper container box module xq zvb foo section area pane cell node c1 el js-x abc blok w70 layout page-inner wrap-inner main-col l-12 u-wide kx9 gamma holder ztop unit-3 lead".split()
BLOCKS = ["Another heading", "The first paragraph has several words in it.", "The second one goes on for a while, with a comma.", "And the third ends it all."]
AROUND = (
    '<header class="site-header"><a href="/">Brand</a></header><nav class="nav"><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav>',
    '<div class="sidebar"><h3>Related</h3><ul><li><a href=/1>One more story</a></li></ul></div><footer class="footer"><p>All rights reserved.</p></footer>',
)

#: Pages written after the training pages were settled, and not used to choose anything.
UNSEEN_PAGES = {
    "columns": (
        "<body><div class='top-nav'><ul><li><a href=/a>Start</a><li><a href=/b>About</a></ul></div><div class='row'><div class='col-xs-9'><h1>Rain over the hills</h1><p>It had rained for three days when we set out, and the road was soft.</p><p>By noon the sky had cleared, and we could see the far side of the valley.</p><table><tr><td>Day one<td>12 km<tr><td>Day two<td>9 km</table></div>"
        "<div class='col-xs-3'><div class='widget related'><h4>More stories</h4><ul><li><a href=/1>Snow on the pass</a></li><li><a href=/2>The old mill</a></li></ul></div></div></div><footer><p>Copyright of the authors.</p></footer>",
        ["Rain over the hills", "It had rained for three days when we set out, and the road was soft.", "By noon the sky had cleared, and we could see the far side of the valley.", "Day one", "12 km", "Day two", "9 km"],
    ),
    "made-up names": (
        "<div id=qqz><div class='t9 vv'><h1>Keeping bees in town</h1><p>Most roofs are warm enough, and there is more to forage than one would think.</p><p>Start with two hives, so that you can compare them.</p><dl><dt>Frame<dd>What the comb is built in.<dt>Super<dd>The box for the honey.</dl></div></div><div class='newsletter'><p>Get our letter every week.</p><form><label>Mail</label><input><button>Send</button></form></div>",
        ["Keeping bees in town", "Most roofs are warm enough, and there is more to forage than one would think.", "Start with two hives, so that you can compare them.", "Frame", "What the comb is built in.", "Super", "The box for the honey."],
    ),
}


@pytest.mark.parametrize("attr", ["class", "id"])
def test_names_that_tell_nothing_lose_no_article(attr):
    net, lost = h.trained_labeller(), []
    for name in NAMES:
        body = f'<div {attr}="{name}"><h2>{BLOCKS[0]}</h2>' + "".join(f"<p>{b}</p>" for b in BLOCKS[1:]) + "</div>"
        for page in (body, AROUND[0] + body + AROUND[1]):
            if h.main_texts([page], net)[0].split("\n") != BLOCKS:
                lost.append((name, page is body))
    assert not lost


def test_telling_names_still_tell():
    net = h.trained_labeller()
    article = "".join(f"<p>{b}</p>" for b in BLOCKS[1:])
    for name in ("sidebar", "cookie-notice", "advert", "related", "comments"):
        page = f"<article><h1>{BLOCKS[0]}</h1>{article}</article><div class='col-md-4 {name}'><p>Something else is said in here.</p></div>"
        assert h.main_texts([page], net)[0].split("\n") == BLOCKS


def test_parts_of_an_article():
    net = h.trained_labeller()
    page = "<article><h1>Some title</h1><p>Words of the first paragraph are here.</p><details><summary>More on this</summary><p>Hidden words that readers can open.</p></details><dl><dt>Bread</dt><dd>Something baked from flour.</dd></dl><figure><figcaption>A view of the sea at dawn.</figcaption></figure></article>"
    assert h.main_texts([page], net)[0].split("\n") == ["Some title", "Words of the first paragraph are here.", "More on this", "Hidden words that readers can open.", "Bread", "Something baked from flour.", "A view of the sea at dawn."]


@pytest.mark.parametrize("name", list(UNSEEN_PAGES))
def test_pages_not_used_for_choices(name):
    page, want = UNSEEN_PAGES[name]
    assert h.main_texts([page], h.trained_labeller())[0].split("\n") == want


def test_deep_nesting_is_linear():
    took = []
    for n in (4000, 16_000):
        began = time.process_time()
        blocks = h.cut_blocks("".join(f"<div class=n{k}>x " for k in range(n)) + "</p></div>" * n)
        took.append(time.process_time() - began)
        assert len(blocks) == n
    assert took[1] < 12 * took[0] + 0.5


def test_optional_end_tags_at_any_depth():
    text = lambda page: [(b[0], int(b[1][h._slot("li")])) for b in h.cut_blocks(page)]
    inner = "<div>" * 9
    assert text(f"<ul><li>{inner}one<li>two<ul><li>three</ul>") == [("one", 1), ("two", 1), ("three", 1)]
    path = h.Path()
    for name in ("ul", "li", "div", "div"):
        path.push(name, ())
    assert path.last("li") == 1 and path.last("p") == -1
    path.cut(1)
    assert path.last("li") == -1 and path.kept()[h._slot("ul")] == 1 and path.kept()[h._slot("div")] == 0


def test_repeated_ids_and_long_pages(spark):
    long = "<article><h1>Title of it</h1>" + "<p>Some words of a very long page follow here.</p>" * 5000 + "</article>"
    rows = [(1, "u", "<p>One text that is here, with words.</p>", "clash"), (1, "u", "<p>Another text is here, with words.</p>", "clash"), (2, "v", long, "clash")]
    got = h.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")).collect()
    assert sorted(r["text"] for r in got if r["page_id"] == 1) == ["Another text is here, with words.", "One text that is here, with words."]
    assert next(r for r in got if r["page_id"] == 2)["text"].count("\n") == 5000
