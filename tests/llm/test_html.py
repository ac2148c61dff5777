import math
import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from mosaiq.llm.html import extract

ARTICLE = "<article><h1>Title here</h1><p>First, paragraph; with text.</p><p>Second &amp; last&nbsp;one.</p></article>"


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        (f"<body><nav><ul><li><a>Home</a></li></ul></nav>{ARTICLE}<footer>&copy; x</footer></body>", "Title here\nFirst, paragraph; with text.\nSecond & last one."),
        ("<p>a\n  b<br>c<p>d<div>e</div>f", "a b c\nd\ne\nf"),
        ("<article><p>x<script>var a = '</p><p>';</script>y<style>p{}</style></p><!-- <p>no</p> --></article>", "xy"),
        ("<div class='content'><p>Body, text.</p></div><div id='comments'><p>Great post!</p></div>", "Body, text."),
        ("<div class='sidebar-left'>menu</div><div class=headerBar>h</div><main><p>Kept.</p><aside>no</aside></main>", "Kept."),
        ("<article><p>a<b>b</b><i>c</i> d</p><form><p>no</p><input></form><div class='cookie-notice'>no</div></article>", "abc d"),
        ("<article><p>cut off &lt;here&gt; <b", "cut off <here>"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one\ntwo\nc1\nc2"),
        ('<article><p title="a>b" data-x=\'<p>\'>ok</p></article>', "ok"),
        ("<article><p>address and badly readable shading</p></article>", "address and badly readable shading"),
        ("<article><p class='shadow address'>stays</p><p class='ad'>goes</p></article>", "stays"),
        ("<article class='post has-sidebar'><p>Main, text.</p></article><article class='comment'><p>I agree, fully.</p></article>", "Main, text."),
    ],
)
def test_extract(page, expected):
    assert extract(page) == expected


def test_long_and_deep_pages():
    assert extract("<article>" + "<p>word, word.</p>" * 5000 + "</article>").count("\n") == 4999
    assert extract("<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."


def test_short_blocks_beside_long_ones_stay():
    assert extract("<article><h1>T</h1>" + "<p>" + "long, text. " * 200 + "</p><p>No.</p></article>").split("\n")[-1] == "No."


def test_rejected_paths_beside_the_text_go():
    long = ("A long paragraph, with commas, and several clauses; it goes on, and on, for a good while. " * 4).strip()
    menu = "<ul><li><a>Home</a></li><li><a>About</a></li></ul>"
    assert extract(f"<body>{menu}<h1>T</h1><p>{long}</p><p>{long}</p><div>links</div></body>").split("\n") == ["T", long, long]
    after = "<ul><li><a>links</a></li><li><a>more</a></li><li><a>last</a></li></ul>"
    assert extract(f"<body>{menu}<h1>T</h1><p>{long}</p><h2>short</h2><p>{long}</p><p>{long}</p>{after}</body>").split("\n") == ["T", long, "short", long, long]


LONG = ("A long paragraph, with commas, and several clauses; it goes on, and on, for a good while. " * 4).strip()
MENU = "<ul><li><a>Home</a></li><li><a>News</a></li><li><a>Sport</a></li><li><a>About us</a></li></ul>"


def test_names_alone_do_not_decide():
    page = f"<body>{MENU}<div class='tags-wrapper'><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div>Related one</div><div>Related two</div><footer>Copyright</footer></body>"
    assert extract(page).split("\n") == ["T", LONG, LONG]
    page = f"<article><h1>T</h1><p>{LONG}</p><section class='social-history'><p>{LONG}</p></section><div><a>Share on A</a> <a>Share on B</a></div><div>Next story</div><p>{LONG}</p></article>"
    assert extract(page).split("\n") == ["T", LONG, LONG, LONG]
    assert extract(f"<body>{MENU}<div class='comments'><p>{LONG}</p><p>{LONG}</p></div></body>").split("\n") == [LONG, LONG]  # all there is


@pytest.mark.parametrize("page", ["<a " * 330_000, "<div>" * 200_000, "</div>" * 160_000, "<b>" * 100_000 + "<p>x" * 100_000, "<a b='" * 160_000, "<a =" * 250_000, "<!--" * 250_000, "<table><tr><td>" * 60_000])
def test_broken_pages_take_linear_time(page):
    began = time.perf_counter()
    extract(page)
    assert time.perf_counter() - began < 20  # about a second on a free core; a quadratic reader takes minutes


def test_odd_references():
    assert extract("<p>a &#" + "9" * 5000 + "; b &#0000000000065; &#x110000; &amp;lt; &am</p>") == "a � b A � &lt; &am"


class Tree(HTMLParser):
    """Blocks of a well-formed page as (path of (tag, class), ancestors, text, letters outside links, letters in links)."""

    def __init__(self):
        super().__init__()
        self.open, self.found, self.fresh, self.n = [], [], True, 0

    def handle_starttag(self, tag, attrs):
        self.n += 1
        self.open.append((tag, dict(attrs).get("class", ""), self.n))
        self.fresh |= tag not in ("a", "b")

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag
        self.fresh |= tag not in ("a", "b")

    def handle_data(self, data):
        if any(t in ("nav", "footer", "aside", "form") for t, _, _ in self.open) or (self.fresh and not data.strip()):
            return
        if self.fresh:
            blocks = [x for x in self.open if x[0] not in ("a", "b")]
            self.found.append([tuple((t, c) for t, c, _ in blocks), blocks, "", 0, 0])
            self.fresh = False
        n = sum(c != " " for c in data)
        self.found[-1][2] += data
        self.found[-1][4 if any(t == "a" for t, _, _ in self.open) else 3] += n


def plainly(page):
    """The same rules by loops over a tree, for pages without names that tell anything."""
    tree = Tree()
    tree.feed(page)
    blocks = [(*b[:2], " ".join(b[2].split()), *b[3:]) for b in tree.found]
    if not any(b[3] for b in blocks):
        return ""
    points = lambda b: sum(c in ",.;:!?" for c in b[2]) if b[3] > b[4] else 0
    mean = lambda xs: sum(xs) / len(xs)
    raw = [{p: (sum(own := [f(b) for b in blocks if b[0] == p]) + k) / len(own) for p in {b[0] for b in blocks}} for k, f in ((0, lambda b: b[3]), (1, points))]
    kernel = {d: math.exp(-d * d / 2) for d in range(-2, 3)}

    def smoothed(r, i):
        near = [(w, r[blocks[i + d][0]]) for d, w in kernel.items() if 0 <= i + d < len(blocks)]
        return sum(w * x for w, x in near) / sum(w for w, _ in near)

    fused = {}
    for p in raw[0]:
        at = [i for i, b in enumerate(blocks) if b[0] == p]
        fused[p] = math.sqrt(raw[0][p] * raw[1][p] * mean([smoothed(raw[0], i) for i in at]) * mean([smoothed(raw[1], i) for i in at]))
    limit = 0.1 * sum(fused[b[0]] * b[3] for b in blocks) / sum(b[3] for b in blocks)
    good = [fused[b[0]] >= limit for b in blocks]
    total = sum(b[3] + b[4] for b, g in zip(blocks, good, strict=True) if g)
    held = Counter()
    for b, g in zip(blocks, good, strict=True):
        for depth, x in enumerate(b[1], 1):
            held[x[0], x[2], depth] += (b[3] + b[4]) * g
    marked = [k for k, v in held.items() if k[0] in ("article", "main") and 2 * v >= total] or [k for k, v in held.items() if v == total]
    root = max(marked, key=lambda k: (k[2], held[k])) if marked else ("", 0, 0)
    rows = [(b, g) for b, g in zip(blocks, good, strict=True) if not root[1] or any(x[2] == root[1] for x in b[1])]
    first, last = min(i for i, (_, g) in enumerate(rows) if g), max(i for i, (_, g) in enumerate(rows) if g)
    text, head = ("h1", "h2", "p", "li"), ("h1", "h2")
    out = []
    for i, (b, g) in enumerate(rows):
        tag, worded = b[1][-1][0] if b[1] else "", b[3] > b[4]
        title = i < first and tag in head and all(rows[j][0][1][-1][0] in head or rows[j][0][4] for j in range(i + 1, first))
        if g or worded and (tag in text and (first < i < last or i > last and root[0] in ("article", "main")) or title):
            out.append(b[2])
    return "\n".join(out)


def test_equals_brute_force():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["alpha", "beta,", "gamma.", "delta", "eps;"]) for _ in range(n))

    def element(depth):
        tag = rng.choice(["div", "div", "section", "article", "p", "p", "p", "h2", "ul", "nav", "aside", "footer", "main"])
        if tag in ("p", "h2"):
            return f"<{tag}>{say(rng.choice([1, 4, 30, 60]))} <a href='#'>{say(rng.choice([1, 3, 20]))}</a><b>{say(2)}</b></{tag}>"
        if tag == "ul":
            return "<ul>" + "".join(f"<li><a>{say(2)}</a> {say(rng.choice([0, 1, 9]))}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        named = rng.choice(["", "", " class='x'", " class='story'"])
        return f"<{tag}{named}>{say(rng.choice([0, 0, 2, 25]))}{''.join(element(depth + 1) for _ in range(rng.randint(0, 4 - depth)))}</{tag}>"

    full = 0
    for _ in range(400):
        page = "<body>" + "".join(element(0) for _ in range(rng.randint(1, 6))) + "</body>"
        got = extract(page)
        assert got == plainly(page), page
        full += bool(got)
    assert full > 200


def test_query_edges(spark, tmp_path):
    from mosaiq.llm.queries import op7_tag_paths

    rows = [(1, "u", "<p>x y</p>", 7), (1, "u", "<p>x y</p>", 7), (None, None, None, 8), (2, "v", "", 9)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text int").write.parquet(f"{tmp_path}/a/pages.parquet")
    got = sorted(map(tuple, op7_tag_paths(spark, f"{tmp_path}/a").collect()), key=str)
    assert got == sorted([(1, "u", "x y", 3), (1, "u", "x y", 3), (None, None, "", 0), (2, "v", "", 0)], key=str)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/b/pages.parquet")
    assert op7_tag_paths(spark, f"{tmp_path}/b").collect() == []
