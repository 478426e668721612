"""Main text of web pages by two-pass block rules.

A page is cut in blocks at block-level tags, in time linear in its length. The first pass labels every block,
wherever it stands, by its length, link density and stop-word density as good, near (good), short (open) or bad.
Markup counts as evidence in this pass: a block in an element that is
no part of an article (menus, footers, forms, adverts, comments, ... by tag, role, class or id) is bad,
and the label of one in an article is raised by a step. The second pass gives open blocks the
label of their nearest decided neighbours. Which of them decides is told by likeness (the same element around both), then by nearness.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintet.llm.common import by_bytes

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.22, 0.30
LINKS_MOST = 0.2
#: Within an article, text may link more; and so many blocks of links in a line are a menu.
ARTICLE_LINKS_MOST, MENU_BLOCKS = 0.6, 3
#: A character of a script without spaces counts as so many.
WIDE = 3

# Function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its
like more my no not of on one only or other our out she so some than that the their them then there these they this to up was we were
what when which who will with would you your
aber alle als am an auch auf aus bei bin bis da das dass dem den der des die dies doch du durch ein eine einem einen einer eines er es
für hat hatte ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns unter von vor war was wenn
wer wie wir zu zum zur
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais même ne nous on ou où par pas plus pour qu que
qui sa sans se ses si son sont sur tout un une vous
al como con cuando del desde donde el ella ellos entre era es esta este esto fue ha hay la las lo los más me mi muy no nos o para pero
por que se ser sin sobre son su sus también tiene todo un una uno y ya
""".split()
)
#: Elements whose content is no text, and those of them that swallow the rest of a page if they are not closed.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select option datalist head".split())
SWALLOWS = frozenset("script style textarea title iframe".split())
#: Elements that are no part of an article.
OUTSIDE = frozenset("nav aside footer form button dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: First or last words of a class or id that mark what is no part of an article.
HINTS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
notices popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer masthead topbar toolbar comment
comments disqus newsletter subscribe subscription signup login pagination pager""".split()
)
#: Words of a class or id whose element is judged by its text alone, even in an article.
DOUBTS = frozenset("""header aside widget widgets alert notification reply replies respond discussion share sharing social related
recommended recommendations search copyright legal skip teaser teasers""".split())
#: Last words of a class or id that name text, whatever comes before.
_TEXTS = frozenset("article analysis body content free main page story text title wrapper container layout".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody tfoot thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first ends an open element of the second, up to one of the third.
_CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}
#: Elements that a closing tag of another kind does not reach out of.
_BARRIERS = frozenset("article body main aside nav footer form section td th".split())
_REACH = _BARRIERS | {"html", "div", "table", "tr"}

# Character classes exclude < and >, and quantifiers give nothing back, so a try ends at the next of them.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*+")
_TO_VALUE = re.compile(r"""[^>=]*+(?:=\s*+(["']?)|(>)|\Z)""")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORDS = re.compile(r"[^\W_]+")
_CASES = re.compile(r"([a-z])([A-Z])")
#: Letters of scripts that are written without spaces.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")
#: Letters of the script that the stop words are written in.
_LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u024f\u1e00-\u1eff]")


@dataclass
class Block:
    text: str
    links: int = 0  # characters in links
    heading: bool = False
    article: bool = False
    label: str = ""
    outside: bool = False
    doubtful: bool = False
    kind: str = "p"  # the element around it
    marked: tuple = (None, None)  # the nearest form and hinted element around it


@dataclass
class _Marked:
    """A form or hinted element, which wraps the page if an article's heading lies in it."""

    up: _Marked | None
    wraps: bool = False
    chars: int = 0

    def wrap(self) -> None:
        node = self
        while node and not node.wraps:
            node.wraps, node = True, node.up


def _hinted(names: str) -> tuple[bool, bool]:
    """Whether class and id names mark what is no part of an article, or what may be none."""
    hint = doubt = False
    for name in names.split():
        parts = [p for p in re.split(r"[^a-z0-9]+", _CASES.sub(r"\1-\2", name).lower()) if p]
        if not parts or parts[0] in ("has", "with", "no", "without"):
            continue
        if parts[-1] in _TEXTS:
            doubt = doubt or bool((HINTS | DOUBTS).intersection(parts))
        else:
            hint = hint or parts[0] in HINTS or parts[-1] in HINTS
            doubt = doubt or bool((HINTS | DOUBTS).intersection(parts))
    return hint, doubt


@lru_cache(4096)
def _short_evidence(attrs: str) -> tuple[bool, bool, bool, bool]:
    return _evidence(attrs)


def _evidence(attrs: str) -> tuple[bool, bool, bool, bool]:
    """What attributes say: hidden or of a role outside articles, hinted, doubtful, an article's role."""
    found = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTR.findall(attrs)}
    role = found.get("role", "").lower()
    away = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*+:\s*+none", found.get("style", "").lower())) or role in ROLES
    return away, *_hinted(f"{found.get('class', '')} {found.get('id', '')}"), role in ("main", "article")


class _Page:
    """The tags of a page; searches that find nothing, or something further on, are not made again."""

    def __init__(self, html: str):
        self.html, self.next, self.raw = html, {}, {}

    def find(self, mark: str, at: int) -> int:
        """The first place of a character from ``at`` on, the page's end if there is none."""
        if self.next.get(mark, -1) < at:
            found = self.html.find(mark, at)
            self.next[mark] = len(self.html) if found < 0 else found
        return self.next[mark]

    def tag(self, at: int) -> tuple[bool, str, str, int]:
        """``(closes, name, attributes, end)`` of the tag that begins at a place; a tag that is not ended takes the rest."""
        m = _TAG.match(self.html, at)
        if m:
            return bool(m[1]), m[2].lower(), m[3], m.end()
        m = _NAME.match(self.html, at)
        end = self.end(m.end())
        closes = self.html[at + 1] == "/"
        return closes, self.html[at + 1 + closes : m.end()].lower(), self.html[m.end() : max(m.end(), end - 1)], end

    def end(self, at: int) -> int:
        """Where a tag ends whose attributes begin at a place. A quote is a pair only if a space, / or > follows it;
        the tag of an unpaired one ends with the first >."""
        html, n = self.html, len(self.html)
        while True:
            m = _TO_VALUE.match(html, at)
            if m[2]:
                return m.end()
            if m.end() >= n:
                return n
            at = m.end()
            if m[1]:
                close = self.find(m[1], at)
                if close + 1 < n and (html[close + 1] in "/>" or html[close + 1].isspace()):
                    at = close + 1
                else:
                    return min(n, self.find(">", at) + 1)

    def after(self, name: str, at: int) -> int | None:
        """Behind the closing tag of an element without text; None if it has none."""
        if self.raw.get(name, at) is None:
            return None
        ends = r"</head\s*+>|(?=<body\b)" if name == "head" else rf"</{re.escape(name)}\s*+[^>]*+>"
        m = re.compile(ends, re.I).search(self.html, at)
        self.raw[name] = m and m.end()
        return m and m.end()


def blocks(html: str, hints: bool = True) -> list[Block]:
    """The page's blocks in order, those that are no part of an article too."""
    page, out = _Page(html), []
    text: list[str] = []
    links = anchors = 0
    stack: list[tuple] = []  # tag, outside, article, doubtful, marked
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    barriers: list[int] = []
    around: list[int] = []  # places of block elements but p
    nothing = ("", False, False, False, (None, None))
    forms: list[_Marked] = []

    def flush() -> None:
        nonlocal links
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                _, outside, article, doubtful, marked = stack[-1] if stack else nothing
                near = [t for t, *_ in stack[-4:]]
                kind = next((t for t in reversed(near) if t in BLOCKS), "")
                out.append(Block(whole, links, any(t[0] == "h" and t[1:].isdigit() for t in near), article, "", outside, doubtful, kind, marked))
            text.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            text.append(piece)
            if anchors:
                links += len(piece.strip())

    def pop(to: int) -> None:
        nonlocal anchors
        while len(stack) > to:
            tag = stack.pop()[0]
            opened[tag].pop()
            anchors -= tag == "a"
            for places in (barriers, around):
                if places and places[-1] == len(stack):
                    places.pop()

    def last(tag: str) -> int:
        places = opened.get(tag)
        return places[-1] if places else -1

    at, end = 0, len(html)
    while at < end:
        begin = page.find("<", at)
        add(html[at:begin])
        if begin >= end:
            break
        at, c = begin + 1, html[begin + 1 : begin + 2]
        if c in ("!", "?"):
            if html.startswith("<!--", begin):
                close = html.find("-->", begin + 2)
                at = end if close < 0 else close + 3
            elif html.startswith("<![CDATA[", begin):
                close = html.find("]]>", at)
                add(html[begin + 9 : end if close < 0 else close])
                at = end if close < 0 else close + 3
            else:
                at = page.find(">", at) + 1
            continue
        if not (c.isascii() and c.isalpha()) and not (c == "/" and html[begin + 2 : begin + 3].isascii() and html[begin + 2 : begin + 3].isalpha()):
            add("<")
            continue
        closes, tag, attrs, at = page.tag(begin)
        empty = attrs.endswith("/")
        if tag in RAW and not closes:
            if not empty:
                behind = page.after(tag, at)
                at = behind if behind is not None else end if tag in SWALLOWS else at
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            add(" ")
        if closes:
            k = last(tag)
            if k >= 0 and (tag in _REACH or not barriers or k >= barriers[-1]):
                pop(k)
            continue
        if tag in VOID or empty and tag not in BLOCKS:
            continue
        if tag in _CLOSES:
            own, bounds = _CLOSES[tag]
            if (k := last(own)) > max(map(last, bounds)):
                pop(k)
        elif tag in BLOCKS and (k := last("p")) >= 0 and (not around or k > around[-1]):
            pop(k)
        _, outside, article, doubtful, marked = stack[-1] if stack else nothing
        away = hint = doubt = is_article = False
        if attrs and tag not in ("html", "body"):
            away, hint, doubt, is_article = _short_evidence(attrs) if len(attrs) <= 200 else _evidence(attrs)
            if tag == "main" or not hints:
                hint = doubt = False
        is_article = is_article or tag in ("article", "main")
        if tag in ("main", "h1") or is_article and not hint:
            for m in marked if tag in ("main", "h1") else marked[:1]:  # what holds the article isn't left out
                if m:
                    m.wrap()
        article = article or is_article
        if tag == "form" and not marked[0]:  # forms don't nest
            forms.append(_Marked(None))
            marked = (forms[-1], marked[1])
        if hint:
            marked = (marked[0], _Marked(marked[1]))
        outside = outside or away or tag in OUTSIDE and tag != "form" or tag == "header" and not article
        places = len(stack)
        stack.append((tag, outside, article, doubtful or doubt, marked))
        opened.setdefault(tag, []).append(places)
        if tag in _BARRIERS:
            barriers.append(places)
        if tag in BLOCKS and tag != "p":
            around.append(places)
        anchors += tag == "a"
    flush()
    whole = sum(len(b.text) for b in out if not b.outside)
    for b in out:
        if b.marked[0] and not b.outside:
            b.marked[0].chars += len(b.text)
    for m in forms:
        m.wraps = m.wraps or 2 * m.chars > whole
    for b in out:
        b.outside = b.outside or any(m and not m.wraps for m in b.marked)
    return out


def _size(text: str) -> int:
    """Characters; those of scripts without spaces count more."""
    return len(text) if text.isascii() else len(text) + (WIDE - 1) * len(_UNSPACED.findall(text))


def stop_density(text: str) -> float | None:
    """The share of stop words; None for a text mostly in a script that none of them is written in."""
    ws = _WORDS.findall(text.lower())
    if not text.isascii() and 2 * len(_LATIN.findall(text)) < sum(map(len, ws)):
        return None
    return sum(w in STOP_WORDS for w in ws) / max(1, len(ws))


_RAISED = {"bad": "near", "near": "good", "good": "good", "short": "short"}


def classify(found: list[Block], with_stop_words: bool = True) -> None:
    """The first pass: labels every block good, near, short or bad.

    By what surrounds it, then link density, length and stop-word density. Density counts against that of the page's
    longer blocks where these have few stop words, as in jargon or a language without any here. In an article, a label is a step better, and
    blocks of links are open unless they are a menu: so many in a line. Without stop words, or in a
    script that has none here, length alone tells good from near.
    """
    dense = [min(1.0, b.links / len(b.text)) > (ARTICLE_LINKS_MOST if b.article and not b.doubtful else LINKS_MOST) for b in found]
    menu = [False] * len(found)
    k = 0
    while k < len(found):
        e = k
        while e < len(found) and dense[e] and found[e].kind == found[k].kind:
            e += 1
        menu[k:e] = [e - k >= MENU_BLOCKS] * (e - k)
        k = max(e, k + 1)
    sizes = [_size(b.text) for b in found]
    stops = [stop_density(b.text) if with_stop_words and n >= LENGTH_LOW and not d and not b.outside else None for b, n, d in zip(found, sizes, dense, strict=True)]
    told = [(n, x) for n, x in zip(sizes, stops, strict=True) if x is not None]
    usual = sum(n * x for n, x in told) / max(1, sum(n for n, _ in told))
    low, high = min(STOP_LOW, usual / 2), min(STOP_HIGH, 3 * usual / 4)
    for k, (b, n) in enumerate(zip(found, sizes, strict=True)):
        article = b.article and not b.doubtful
        if b.outside or menu[k] or not article and (dense[k] or "\N{COPYRIGHT SIGN}" in b.text):
            b.label = "bad"
        elif dense[k]:
            b.label = "short"
        elif n < LENGTH_LOW:
            b.label = "bad" if b.links and not article else "short"
        else:
            stop = stops[k]
            if stop is None:
                b.label = "good" if n >= LENGTH_HIGH else "near"
            else:
                b.label = ("good" if n > LENGTH_HIGH else "near") if stop >= high else "near" if stop >= low else "bad"
            if article:
                b.label = _RAISED[b.label]


def _neighbours(labels: list[str]) -> list[tuple[int, int]]:
    """For each block the nearest decided ones before and after it, -1 and n if there is none."""
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for k in range(1, n):
        before[k] = k - 1 if labels[k - 1] in ("good", "bad") else before[k - 1]
    for k in range(n - 2, -1, -1):
        after[k] = k + 1 if labels[k + 1] in ("good", "bad") else after[k + 1]
    return list(zip(before, after, strict=True))


def revise(found: list[Block], article: bool = False) -> list[bool]:
    """The second pass: open blocks take a label from their nearest decided neighbours; whether each is good.

    First, near blocks become good unless all decided neighbours are bad.
    Then short ones take the label on both sides. Where sides differ, a neighbour in the same kind of element decides if the
    other is in another; then the nearer one; at equal distance, or for a heading, the one that follows.
    In an article only blocks with bad ones on both sides are bad. Short ones without any decided block are bad elsewhere.
    """
    labels = [b.label for b in found]
    n = len(found)
    for k, (left, right) in enumerate(_neighbours(labels)):
        if found[k].label == "near":
            said = [found[x].label for x in (left, right) if 0 <= x < n]
            labels[k] = "good" if not said or "good" in said or article and len(said) < 2 else "bad"
    revised = list(labels)
    for k, (left, right) in enumerate(_neighbours(labels)):
        if labels[k] in ("good", "bad"):
            continue
        said = [labels[x] for x in (left, right) if 0 <= x < n]
        if article:
            revised[k] = "bad" if said == ["bad", "bad"] else "good"
        elif not said:
            revised[k] = "bad"
        elif len(set(said)) == 1:
            revised[k] = said[0]
        else:
            b, like = found[k], [found[k].kind == found[x].kind for x in (left, right)]
            follows = b.heading or (like[1] if like[0] != like[1] else right - k <= k - left)
            revised[k] = labels[right if follows else left]
    return [x == "good" for x in revised]


def choose(found: list[Block], with_stop_words: bool = True) -> list[bool]:
    """Whether each block is of the main text.

    Blocks of articles and the others are revised apart, so what stands around an article has no say in it. If most of the good
    text that stands in articles or elsewhere is in articles, the rest is left out. If nothing is good,
    what is open in an article is.
    """
    classify(found, with_stop_words)
    keep = [False] * len(found)
    chars = [0, 0]
    for article in (False, True):
        own = [k for k, b in enumerate(found) if b.article == article and not (article and b.outside)]
        for k, good in zip(own, revise([found[k] for k in own], article), strict=True):
            keep[k] = good
            chars[article] += good * _size(found[k].text)
    if chars[True] and 2 * chars[True] >= chars[False]:
        keep = [good and b.article for good, b in zip(keep, found, strict=True)]
    return keep


def main_text(html: str | None) -> str:
    """The article's blocks, each on a line; empty for null, an empty page, or if there is none.

    If no block is good, classes and ids, and then stop words, are left out of account.
    """
    if not html:
        return ""
    for hints in (True, False):
        found = blocks(html, hints)
        for with_stop_words in (True, False):
            keep = choose(found, with_stop_words)
            if any(keep):
                return "\n".join(b.text for b, good in zip(found, keep, strict=True) if good)
    return ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    A null or empty html has an empty text. Rows are judged one by one, so rows that repeat an id, or have none, each
    have their own result; null urls stay null. An empty table gives an empty one. Pages are read whole, whatever their
    length, in time linear in it. Characters that UTF-8 can't hold become a question mark. Other columns are not
    read, so their names may be anything.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            texts = [main_text(h.as_py()) for h in b.column(2)]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
