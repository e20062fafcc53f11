"""Main text of web pages by tree scoring.

One pass over the markup builds the element tree in document order, so a subtree is a range of node
numbers. What is never article text (scripts, styles, forms, navigation, side and foot matter, and
elements whose class, id or role says so) is marked and takes no part. Each paragraph then passes
points for its length and commas to its parent in full, to the next ancestor by half and beyond by a
share that falls with the distance; an ancestor's points are discounted by the share of its text that
stands in links. The best container is kept, or the article element around it, with those siblings
that score near it; lists of links inside are left out.

Defined cases: null, empty and text-free pages give an empty text; broken markup, missing end tags and
unclosed comments are read as far as they go; page length is not bounded and nesting needs no
recursion; equal pages have equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagelake.llm.common import ship, table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*+(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+>?", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: Start tags that end an open element of the second set, up to a border of the third.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
_NEVER = {"nav", "footer", "aside", "button", "select", "svg", "math", "canvas", "object", "embed", "audio", "video", "dialog", "menu", "head", "label", "datalist", "input"}
_SIDE = frozenset(
    "ad ads adv advert advertisement advertising advertorial adsense banner bottombar breadcrumb breadcrumbs byline captcha comment comments cookie cookies consent dialog disclaimer disqus feedback foot footer "
    "gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup popular promo promotion promoted recommended related "
    "replies reply respond rss share sharing shoutbox sidebar signin signup skip skyscraper social sponsor sponsored subscribe subscription taboola tags teaser toolbar topbar trending widget widgets alert".split()
)
#: Those of the words above that also hide where nothing else is left of a page.
_FIRM = frozenset(
    "ad ads adv advert advertisement advertising adsense breadcrumb breadcrumbs captcha comment comments cookie cookies consent disqus foot footer gdpr login menu menubar nav navbar navigation newsletter "
    "outbrain pager pagination paywall popup replies reply respond rss share sharing shoutbox sidebar signin signup skip social sponsor sponsored subscribe subscription taboola".split()
)
#: Words that an article's own heading carries.
_TITLE = frozenset("header masthead banner".split())
#: Class names that begin so name a topic, which can be any word.
_TOPIC = re.compile(r"(?:^|\s)(?:tag|category|cat|topic|author|format)-\S*", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form", "toolbar"}
_GOOD = frozenset("article body content entry hentry main page post story text blog".split())
_START = {"div": 5, "article": 10, "main": 8, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3}
_HEAD = {"h1", "h2", "h3", "h4", "h5", "h6"}
_WRAPS = {"div", "section", "article", "main", "body", "html", "center", "form", "td", "figure", "details", "fieldset"}


class Tree:
    """Elements in document order, and the text pieces between their tags."""

    def __init__(self, page: str):
        self.tag, self.parent, self.last = ["#root"], [-1], [0]
        self.side, self.good, self.links = [False], [False], [0]
        self.words: list[frozenset] = [frozenset()]  # of _SIDE
        self._names: dict[str, int] = {}  # open elements by name
        self.blocks_in = [False]
        self.pieces: list[tuple[int, int, bool, str]] = []  # node, segment, in a link, text
        self._segment, self._in_link = 0, 0
        self._stack = [0]
        self._read(page)
        self._close_to(1)
        self.last[0] = len(self.tag) - 1

    def _text(self, raw: str) -> None:
        if raw:
            self.pieces.append((self._stack[-1], self._segment, self._in_link > 0, html.unescape(raw) if "&" in raw else raw))

    def _close_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            n = self._stack.pop()
            self.last[n] = len(self.tag) - 1
            self._names[self.tag[n]] -= 1
            if self.tag[n] == "a":
                self._in_link -= 1
            if self.tag[n] in _BLOCK:
                self._segment += 1

    def _open(self, name: str, token: str) -> None:
        if name in _BLOCK and self._names.get("p"):
            for d in range(len(self._stack) - 1, 0, -1):
                t = self.tag[self._stack[d]]
                if t == "p":
                    self._close_to(d)
                    break
                if t in _BLOCK or t in ("td", "th", "button"):
                    break
        if name in _CLOSES and any(map(self._names.get, _CLOSES[name][0])):
            ends, border = _CLOSES[name]
            for d in range(len(self._stack) - 1, 0, -1):
                t = self.tag[self._stack[d]]
                if t in border:
                    break
                if t in ends:
                    self._close_to(d)
                    if name not in ("tr", "tbody"):
                        break
        if name == "a" and self._in_link:
            for d in range(len(self._stack) - 1, 0, -1):
                if self.tag[self._stack[d]] == "a":
                    self._close_to(d)
                    break
        n, up = len(self.tag), self._stack[-1]
        side, good, words = name in _NEVER, False, frozenset()
        if " " in token or "\n" in token or "\t" in token:
            side, good, words = self._judge(name, token, side)
        self.tag.append(name)
        self.parent.append(up)
        self.last.append(n)
        self.side.append(side)
        self.words.append(words)
        self.good.append(good)
        self.links.append(0)
        self.blocks_in.append(False)
        if name in _BLOCK:
            self._segment += 1
            self.blocks_in[up] = True
        elif name in ("td", "th"):
            self._text(" ")
        if name in _VOID:
            return
        self._stack.append(n)
        self._names[name] = self._names.get(name, 0) + 1
        if name == "a":
            self._in_link += 1
            self.links[n] = 1

    @staticmethod
    def _judge(name: str, token: str, side: bool) -> tuple[bool, bool, frozenset]:
        attrs = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(token[1 + len(name) :])}
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
            return True, False, frozenset()
        if name in ("html", "body", "main"):
            return side, True, frozenset()
        named = attrs.get("class", "")
        if "-" in named:
            named = _TOPIC.sub(" ", named)
        words = {w.lower() for w in _TOKENS.findall(named + " " + attrs.get("id", ""))}
        good = bool(words & _GOOD) or attrs.get("itemprop", "").lower() == "articlebody" or attrs.get("role", "").lower() in ("main", "article")
        return side or attrs.get("role", "").lower() in _ROLES, good, words & _SIDE

    def _read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            m = _TOKEN.search(page, at)
            if m is None:
                break
            self._text(page[at : m.start()])
            token, at = m[0], m.end()
            if token[1] in "!?":
                if token.startswith("<![CDATA["):
                    self._text(token[9:].removesuffix("]]>"))
                continue
            name = _NAME.match(token)[1].lower()
            if token[1] == "/":
                if name == "br":
                    self._text(" ")
                    continue
                if self._names.get(name):
                    for d in range(len(self._stack) - 1, 0, -1):
                        if self.tag[self._stack[d]] == name:
                            self._close_to(d)
                            break
                continue
            if name == "br":
                self._text(" ")
                continue
            if name in _RAW:
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                if name == "hr":
                    self._segment += 1
                at = stop.end() if stop else end
                continue
            self._open(name, token)
        else:
            return
        self._text(page[at:])


def _length(text: str) -> int:
    return len(" ".join(text.split()))


#: A main text of fewer characters is held against the one that class words hide, which must be so many times as long.
SHORT, TIMES = 200, 4


def extract(page: str | None) -> str:
    """The main text: blocks joined by an empty line.

    Elements are left out by the words of their class and id. Where that leaves little, the page is scored
    again with only those left out whose words are unmistakable, and the longer text by far counts.
    """
    if not page:
        return ""
    t = Tree(page)
    found = _main_text(t, _SIDE)
    if len(found) < SHORT and any(w and not w & _FIRM for w in t.words):
        more = _main_text(t, _FIRM)
        if len(more) > TIMES * len(found):
            return more
    return found


def _main_text(t: Tree, hide: frozenset) -> str:
    n = len(t.tag)
    side = t.side[:]
    in_article = [False] * n
    for i in range(1, n):
        up = t.parent[i]
        in_article[i] = in_article[up] or t.tag[i] in ("article", "main")
        if t.tag[i] == "header" and not in_article[up]:
            side[i] = True
        words = t.words[i] & hide
        if words and not (in_article[up] and words <= _TITLE):
            side[i] = True
        side[i] = side[i] or side[up]
    # text by segment: owner, characters, characters in links, commas
    segments: dict[int, list] = {}
    own, linked = [0] * n, [0] * n
    for node, seg, link, text in t.pieces:
        if side[node]:
            continue
        size = len(text) if text.strip() else 0
        own[node] += size
        linked[node] += size * link
        if size:
            s = segments.setdefault(seg, [node, 0, 0])
            s[1] += size
            s[2] += text.count(",") + text.count("、") + text.count("，") + text.count("،")
    links = t.links[:]
    for i in range(n - 1, 0, -1):
        own[t.parent[i]] += own[i]
        linked[t.parent[i]] += linked[i]
        links[t.parent[i]] += 0 if side[i] else links[i]
    if not own[0]:
        return ""
    # a form holds fields, unless the page is wrapped in one
    for i in range(1, n):
        if t.tag[i] in ("form", "fieldset") and own[i] < 0.5 * own[0]:
            side[i] = True
        side[i] = side[i] or side[t.parent[i]]
    points: dict[int, float] = {}
    for node, size, commas in segments.values():
        if side[node] or size < 25:
            continue
        owner = node
        while owner and t.tag[owner] not in _BLOCK and t.tag[owner] not in ("td", "th"):
            owner = t.parent[owner]
        if t.tag[owner] in _HEAD:
            continue
        value = 1 + commas + min(size / 100, 3.0)
        up = owner if owner and t.tag[owner] in _WRAPS and (t.blocks_in[owner] or t.tag[owner] in ("body", "html", "article", "main")) else t.parent[owner]
        level = 0
        while up > 0:
            if up not in points:
                points[up] = _START.get(t.tag[up], 0) + 25 * t.good[up]
            points[up] += value / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = t.parent[up], level + 1

    def density(i: int) -> float:
        return linked[i] / own[i] if own[i] else 0.0

    final = {i: p * (1 - density(i)) for i, p in points.items() if t.tag[i] not in ("html",)}
    best = min(final, key=lambda i: (-final[i], i), default=None)
    if best is None:
        options = [i for want in ("article", "main", "body") for i in range(1, n) if t.tag[i] == want and not side[i] and own[i]]
        best = options[0] if options else 0
    for i in _ancestors(t, best):
        if t.tag[i] in ("article", "main"):
            best = i
            if t.tag[i] == "article":
                break
    ranges = [best]
    up = t.parent[best]
    if t.tag[best] not in ("article", "main", "body", "#root") and up >= 0:
        floor, ranges = max(10.0, 0.2 * final.get(best, 0.0)), []
        child = up + 1
        while child <= t.last[up]:
            if t.parent[child] == up and not side[child]:
                size = own[child]
                near = final.get(child, 0.0) >= floor
                para = t.tag[child] == "p" and ((size > 80 and density(child) < 0.25) or (0 < size <= 80 and not linked[child]))
                head = t.tag[child] in _HEAD and child < best and size > 0
                if child == best or near or para or head:
                    ranges.append(child)
            child = t.last[child] + 1
    for i in range(1, n):  # lists of links
        if not side[i] and t.tag[i] in ("ul", "ol", "div", "section", "table", "dl", "p") and i not in ranges and links[i] >= 2 and density(i) > 0.5 and not any(i < r <= t.last[i] for r in ranges):
            side[i] = True
        side[i] = side[i] or side[t.parent[i]]
    blocks: dict[int, list[str]] = {}
    spans = [(r, t.last[r]) for r in ranges]
    for node, seg, _, text in t.pieces:
        if not side[node] and any(a <= node <= b for a, b in spans):
            blocks.setdefault(seg, []).append(text)
    joined = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n\n".join(x for x in joined if x)


def _ancestors(t: Tree, i: int) -> Iterator[int]:
    while i > 0:
        yield i
        i = t.parent[i]


def extract_pages(df: DataFrame, keep: list[str], source: str = "html") -> DataFrame:
    """The columns ``keep`` with text and n_chars."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelake.llm.html_text import extract

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = [extract(x) for x in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), "text string", "n_chars long"])
    return df.selectExpr(*(f"`{k}`" for k in keep), f"`{source}` as _html").mapInArrow(run, schema)


def op5_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])
