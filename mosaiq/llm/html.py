"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text that one block element holds, each with
its root-to-leaf path of tags and class names. For each path the length of text
outside links and its punctuation are summed and divided by the number of
blocks; both ratios are smoothed over neighbouring blocks in page order and fused
with the plain ones, and the paths that reach a share of the page's mean are
content. Names that mark advertisements, comments and the like only weigh a
path's ratios down, and not at all on pages of which they would leave next to
nothing. The content root is the article or main element that holds most content,
else the deepest element that holds all of it. The text is that of the blocks on
content paths within the root and, between them, of headings, list items and
other text blocks that aren't mostly links.

Reading is one pass with positions of open elements by tag, so its time and memory
grow with the page's length however it is broken or nested.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
#: Elements that end when one of these opens beside them.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("article aside body div footer form header html main nav section table ul ol dl".split())
CELLS = frozenset("td th".split())
#: Elements that hold no main text; a header counts so outside of articles and main elements only.
ELSEWHERE = frozenset("head nav header footer aside form button menu dialog label input select noscript template svg math object canvas".split()) | RAW
#: Names that make main text less likely, and reader comments, which no ratio can tell from an article.
UNLIKELY = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies footer header masthead menu modal nav "
    "navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe tags teaser toolbar widget widgets".split()
)
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
#: Words that say where a named element stands, not what it holds.
NEUTRAL = frozenset("block bottom box buttons inner item items left link links list right text top".split())
#: Weights of a path for each ancestor with such a name, and the share of the page's mean that content paths reach.
UNLIKELY_WEIGHT, COMMENT_WEIGHT, SHARE = 0.05, 0.02, 0.1
#: Names count for nothing on a page where they would leave less than this share of what the ratios alone choose.
TRUSTED = 0.1
#: Spread of the smoothing, in blocks.
SPREAD = 1.0
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Text blocks that stay between content blocks, whatever their own ratios.
TEXTUAL = HEADINGS | frozenset("p li dt dd td th caption pre blockquote figcaption summary details".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_BARE = re.compile(r"\s*/?>")
_ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?)?")
_END_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[,.;:!?…、。，！？¿¡]")
_NUMBER = re.compile(r"&#(?:0*([0-9]+)|[xX]0*([0-9a-fA-F]+));?")


def decoded(text: str) -> str:
    """Character references decoded, numbers of any length too."""
    if "&" not in text:
        return text
    if "&#" in text:  # numbers beyond Unicode, however long
        text = _NUMBER.sub(lambda m: "�" if len(m[1] or m[2]) > 7 else m[0], text)
    return entities.unescape(text)


@dataclass
class Block:
    element: int
    parts: list[str] = field(default_factory=list)
    plain: int = 0  # letters outside links, and in them
    linked: int = 0

    def line(self) -> str:
        return " ".join("".join(self.parts).split())


class Page:
    """Elements in page order, as parallel lists, and the blocks of text."""

    def __init__(self):
        self.parent, self.depth, self.tag, self.path, self.weight, self.out, self.link, self.holder, self.main = [-1], [0], [""], [0], [1.0], [False], [False], [0], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []

    def open(self, parent: int, tag: str, attributes: dict[str, str]) -> int:
        at, path, weight, out, main = len(self.tag), self.path[parent], self.weight[parent], self.out[parent], self.main[parent]
        if tag in ELSEWHERE and not (tag == "header" and main):
            out = True
        if attributes:
            weight *= prior(tag, attributes)
            out = out or hidden(tag, attributes)
        if tag in BLOCK:
            named = attributes.get("class")
            path = self.paths.setdefault((path, f"{tag}.{named}" if named else tag), len(self.paths) + 1)
            self.holder.append(at)
        else:
            self.holder.append(self.holder[parent])
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.path.append(path)
        self.main.append(main or tag in ("article", "main"))
        self.weight.append(weight)
        self.out.append(out)
        self.link.append(self.link[parent] or tag == "a")
        return at


def prior(tag: str, attributes: dict[str, str]) -> float:
    """The weight of an element by its class, id and role names."""
    if tag in ("html", "body", "main"):
        return 1.0
    kinds = set()
    for key in ("class", "id", "role"):
        for name in attributes.get(key, "").split():
            words = {w.lower() for w in _WORDS.findall(name)}
            telling = words - NEUTRAL
            if words & COMMENTS:
                kinds.add("comment")
            elif telling and telling <= UNLIKELY:
                kinds.add("unlikely")
    return (COMMENT_WEIGHT if "comment" in kinds else 1.0) * (UNLIKELY_WEIGHT if "unlikely" in kinds else 1.0)


def hidden(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("html", "body"):
        return False
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(attributes.get("style", "")))


def read(source: str) -> Page:
    """The blocks of a page. What an unfinished tag or comment at the page's end begins is no text."""
    page = Page()
    stack = [0]
    places: dict[str, list[int]] = {}  # of open elements in the stack, by tag
    scopes, cells = [0], []
    now, fresh, at, size = 0, True, 0, len(source)

    def pop(to: int) -> None:
        while len(stack) > to:
            tag = page.tag[stack.pop()]
            places[tag].pop()
            if tag in SCOPES:
                scopes.pop()
            elif tag in CELLS:
                cells.pop()

    def push(element: int) -> None:
        tag, k = page.tag[element], len(stack)
        stack.append(element)
        places.setdefault(tag, []).append(k)
        if tag in SCOPES:
            scopes.append(k)
        elif tag in CELLS:
            cells.append(k)

    def say(raw: str) -> None:
        nonlocal fresh
        if page.out[now]:
            return
        text = decoded(raw)
        if fresh:
            if not text.strip():
                return
            page.blocks.append(Block(page.holder[now]))
            fresh = False
        block = page.blocks[-1]
        block.parts.append(text)
        count = len(text) - text.count(" ")
        if page.link[now]:
            block.linked += count
        else:
            block.plain += count

    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            say(source[at:])
            break
        if lt > at:
            say(source[at:lt])
        closing = source.startswith("/", lt + 1)
        name = _NAME.match(source, lt + 1 + closing)
        if name is None:
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                end, width = (end, 3) if not source.startswith(("<!-->", "<!--->"), lt) else (source.find(">", lt), 1)
            elif closing or source.startswith(("<!", "<?"), lt):
                end, width = source.find(">", lt), 1
            else:  # a sign, no tag
                say("<")
                at = lt + 1
                continue
            if end < 0:
                break
            at = end + width
            continue
        tag, at = name[0].lower(), name.end()
        attributes: dict[str, str] = {}
        bare = _BARE.match(source, at)
        if bare:
            at, last = bare.end(), bare[0]
        elif source.find(">", at) < 0:
            break
        else:
            while at < size and source[at] != ">":
                m = _ATTRIBUTE.match(source, at)
                if m.end() == at or (m[1] is not None and source[m.end() : m.end() + 1] in ("'", '"') and source[at : m.end()].rstrip().endswith("=")):
                    at = size  # a quote without an end
                    break
                if m[1]:
                    attributes.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
                    if m[2] is None and m[3] is None and m[4] is None:
                        rest = m.end()
                        while rest < size and source[rest].isspace():
                            rest += 1
                        if source.startswith("=", rest):  # a value that doesn't begin, or a quote without an end
                            rest += 1
                            while rest < size and source[rest].isspace():
                                rest += 1
                            if rest >= size or source[rest] in "\"'":
                                at = size
                                break
                            at = rest
                            continue
                at = m.end()
            if at >= size:
                break
            last = source[at - 1 : at + 1]
            at += 1
        if tag in BLOCK:
            fresh = True
        if closing:
            held = places.get(tag)
            if held and (tag in SCOPES or tag in CELLS or held[-1] > max(scopes[-1], cells[-1] if cells else 0)):
                pop(held[-1])
                now = stack[-1]
            continue
        if tag == "br":
            say(" ")
        if tag in VOID:
            continue
        ends = SIBLINGS.get(tag, ())
        if ends or tag in CLOSES_P and places.get("p"):
            floor = scopes[-1] if tag in ("tr", "td", "th") else max(scopes[-1], cells[-1] if cells else 0)
            first = len(stack)
            for other in (*ends, "p") if tag in CLOSES_P else ends:
                held = places.get(other, ())
                k = bisect_right(held, floor)
                if k < len(held):
                    first = min(first, held[k])
            if first < len(stack):
                pop(first)
                now = stack[-1]
        element = page.open(now, tag, attributes)
        if tag in RAW:
            end = _END_RAW[tag].search(source, at)
            close = source.find(">", end.end()) if end else -1
            if close < 0:
                break
            at = close + 1
            continue
        if last.startswith("/") and tag not in BLOCK and tag != "a":
            continue
        push(element)
        now = element
    return page


def path_ratios(paths: np.ndarray, length: np.ndarray, points: np.ndarray, spread: float = SPREAD) -> np.ndarray:
    """The fused ratio of each path (0, 1, ...): the geometric mean of plain and smoothed ratios of text and of punctuation, squared."""
    n = int(paths.max()) + 1
    count = np.bincount(paths, minlength=n)
    text, point = np.bincount(paths, length, n) / count, (np.bincount(paths, points, n) + 1) / count
    kernel = np.exp(-0.5 * (np.arange(-2, 3) / spread) ** 2)
    near = np.convolve(np.ones(len(paths)), kernel)[2:-2]
    smooth = [np.bincount(paths, np.convolve(r[paths], kernel)[2:-2] / near, n) / count for r in (text, point)]
    return np.sqrt(text * point * smooth[0] * smooth[1])


def content(page: Page, lines: list[str]) -> tuple[np.ndarray, bool]:
    """Whether each block is on a content path, and whether names were of use."""
    _, paths = np.unique([page.path[b.element] for b in page.blocks], return_inverse=True)
    length = np.array([b.plain for b in page.blocks], np.float64)
    if not length.sum():
        return np.zeros(len(paths), bool), False
    points = np.array([len(_PUNCTUATION.findall(x)) if b.plain > b.linked else 0 for b, x in zip(page.blocks, lines, strict=True)], np.float64)
    weight = np.array([page.weight[b.element] for b in page.blocks])
    fused = path_ratios(paths, length, points)
    limit = SHARE * np.average(fused[paths], weights=length)
    weighted = fused * np.bincount(paths, weight) / np.bincount(paths)
    alone, named = (fused >= limit)[paths], (weighted >= limit)[paths]
    trusted = bool(length[named].sum() >= TRUSTED * length[alone].sum())
    return (named if trusted else alone), trusted


def root_of(page: Page, chosen: list[Block], named: bool) -> int:
    """The deepest article or main element that holds half of the content, else the deepest element that holds all."""
    held = [0.0] * len(page.tag)
    for b in chosen:
        held[b.element] += (b.plain + b.linked) * (page.weight[b.element] if named else 1)
    for e in range(len(held) - 1, 0, -1):
        if held[e]:
            held[page.parent[e]] += held[e]
    most = held[0] * (1 - 1e-9)
    marked = [e for e, tag in enumerate(page.tag) if tag in ("article", "main") and 2 * held[e] >= most]
    return max(marked or [e for e, x in enumerate(held) if x >= most], key=lambda e: (page.depth[e], held[e]))


def extract(source: str | None) -> str:
    """The main text: its blocks in page order, one line each.

    Null and empty pages, and pages without text, give "". Pages of any length are read whole; equal pages give equal texts.
    """
    page = read(source or "")
    page.blocks = [b for b in page.blocks if b.line()]
    if not page.blocks:
        return ""
    lines = [b.line() for b in page.blocks]
    good, named = content(page, lines)
    if not good.any():  # links only
        return ""
    root = root_of(page, [b for b, g in zip(page.blocks, good, strict=True) if g], named)
    end = root + 1
    inside = [False] * len(page.tag)  # elements stand in page order, so a subtree is one range
    inside[root] = True
    while end < len(page.tag) and inside[page.parent[end]]:
        inside[end] = True
        end += 1
    at = [k for k, b in enumerate(page.blocks) if inside[b.element]]
    tag = [page.tag[page.blocks[k].element] for k in at]
    accepted = [bool(good[k]) for k in at]
    if not any(accepted):
        return ""
    first, last = accepted.index(True), len(at) - accepted[::-1].index(True)
    whole = page.tag[root] in ("article", "main")
    out = []
    for i, k in enumerate(at):
        block = page.blocks[k]
        worded = block.plain > block.linked and (not named or page.weight[block.element] >= page.weight[root])
        if accepted[i] or worded and (first < i < last or whole and i >= last) and tag[i] in TEXTUAL:
            out.append(i)
        elif worded and i < first and tag[i] in HEADINGS and all(tag[j] in HEADINGS or page.blocks[at[j]].linked for j in range(i + 1, first)):
            out.append(i)
    return "\n".join(lines[at[i]] for i in out)


def extract_batch(column: pa.Array) -> dict[str, object]:
    """Text and number of code points of each page; see extract()."""
    texts = [extract(x) for x in column.to_pylist()]
    return {"text": texts, "n_chars": [len(t) for t in texts]}
