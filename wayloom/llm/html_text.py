"""Main text of web pages: flat text blocks, judged by a decision tree over a block and its neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayloom.llm.common import batched, extended, table

# Elements whose content is never text of the page.
_HIDDEN = frozenset("script style noscript template svg object iframe select option button textarea canvas audio video head title".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
# Elements whose content isn't read as markup: it ends at the first closing tag of that name.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in "script style noscript template textarea iframe title annotation annotation-xml".split()}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BLOCKY = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Kinds of places, in the order of the feature columns.
_KINDS = ("article", "menu", "header", "footer", "aside", "form", "advert", "comment", "notice")
_BY_TAG = {"article": "article", "main": "article", "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "notice", "address": "footer"}
# What a part of a class, id or role may be called after, and what may follow that word: "share" and "share-buttons", but not "share-price".
_PLACED = "list|lists|box|boxes|link|links|button|buttons|bar|widget|widgets|wrap|wrapper|wrapping|container|section|area|block|blocks|items?|inner|outer|top|bottom|left|right|header|body|title|text|content|slot|unit|form|row|col|column|panel|group|posts?|articles?|stories|thread|icons?|message|menu|nav|[0-9]+"
_WORDS = {
    "comment": "user-?comments?|comments?|replies|respond|disqus|discussion",
    "advert": "ads?|adverts?|advertisements?|adslot|banner|promos?|promotions?|sponsor|sponsored|outbrain|taboola",
    "notice": "cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscribe|paywall",
    "menu": "nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager|toc|tabs|skip",
    "aside": "sidebar|side|aside|related|recommended|widgets?|trending|popular|share|sharing|social|tags",
    "footer": "footer|foot|copyright|legal|colophon",
    "header": "page-?header|site-?header|masthead|topbar|branding|logo",
    "form": "form|search|login|signup",
    "article": "article|post|entry|content|story|main|body-?text|article-?body",
}
_BY_NAME = [(kind, re.compile(rf"(?:[a-z0-9]+[-_]+)*(?:{words})(?:[-_]+(?:{_PLACED}))*")) for kind, words in _WORDS.items()]
_NO_TAG = r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?"
_TAG = r"<(/?)([A-Za-z][^\s/>]*)"
# Comments and tags; a tag whose quotes don't close ends at the first >. Where no > is left, only the first kinds can be.
_TOKEN = re.compile(rf"""{_NO_TAG}|{_TAG}((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|{_TAG}([^>]*+)>""", re.S)
_LAST = re.compile(_NO_TAG, re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDE = re.compile(r"(?i)hidden|display\s*:\s*none")
_NONE = re.compile(r"(?i)display\s*:\s*none")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")

#: Inline elements inside each other that are told apart.
_DEEP = 256

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", *_KINDS)


class Block:
    __slots__ = ("text", "words", "linked", "heading", "kinds")

    def __init__(self, text: str, linked: int, heading: bool, kinds: frozenset[str]):
        self.text, self.linked, self.heading, self.kinds = text, linked, heading, kinds
        self.words = len(text.split())


def _kind(tag: str, attrs: str) -> frozenset[str]:
    found = {_BY_TAG[tag]} if tag in _BY_TAG else set()
    if attrs and tag not in ("html", "body"):
        names = [n for a, b, c in _NAMES.findall(attrs) for n in _HUMP.sub("-", a or b or c).lower().split()]
        for kind, pattern in _BY_NAME if names else ():
            if any(pattern.fullmatch(n) for n in names):
                found.add(kind)
                break
    return frozenset(found)


def _hides(attrs: str) -> bool:
    """Whether an attribute named hidden, or the value of style or aria-hidden, hides the element."""
    if not _HIDE.search(attrs):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "style" and _NONE.search(value) or name == "aria-hidden" and value.strip().lower() == "true":
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order: runs of text between tags that break lines, with character references decoded
    and white space made single. Text in comments, scripts, styles and other hidden elements is none. A block stands in the kinds of places that
    all of its text stands in: an inline element inside a sentence neither ends its block nor places it. Unclosed and
    misnested tags are borne; a page without markup is one block."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], bool, int]] = []  # name, kinds of places inside it, hidden, place of the last element here that breaks lines
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    within: list[frozenset[str]] = []  # kinds of places of each part that isn't white space alone
    in_link, heading, kinds, hidden = 0, False, frozenset(), False
    pos = 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, len(html.unescape(" ".join(linked)).split()), heading, frozenset.intersection(*within) if within else kinds))
            parts.clear()
            linked.clear()
            within.clear()

    def push(tag: str, attrs: str) -> None:
        above, was, base = stack[-1][1:] if stack else (frozenset(), False, -1)
        stack.append((tag, above | _kind(tag, attrs), was or tag in _HIDDEN or _hides(attrs), base if tag in _INLINE else len(stack)))
        open_[tag] += 1

    def pop(at: int) -> None:
        open_.subtract(x[0] for x in stack[at:])
        del stack[at:]

    def put(text: str) -> None:
        parts.append(text)
        if in_link:
            linked.append(text)
        if not text.isspace():
            within.append(kinds)

    last = page.rfind(">")
    while m := (_TOKEN if pos <= last else _LAST).search(page, pos):
        if m.start() > pos and not hidden:
            put(page[pos : m.start()])
        pos = m.end()
        if m.re is _LAST or not (m[2] or m[5]):
            continue
        tag, closing, attrs = (m[2] or m[5]).lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "br":  # a line break inside a block is white space
            if not hidden:
                parts.append("\n")
            continue
        if tag in _RAW and not closing and not attrs.endswith("/"):
            end = _RAW[tag].search(page, pos)
            if end:
                pos = end.end()
            elif not tag.startswith("annotation"):
                pos = len(page)
            continue
        if tag == "a":
            if not closing:
                in_link = 1
            else:
                in_link = 0
            continue
        base = stack[-1][3] if stack else -1
        if tag in _INLINE:
            if not closing and tag not in _VOID and not attrs.endswith("/") and (len(stack) - base < _DEEP or not hidden and _hides(attrs)):
                push(tag, attrs)
            elif closing and open_[tag] > 0:
                at = next((i for i in range(len(stack) - 1, base, -1) if stack[i][0] == tag), -1)
                if at >= 0:
                    pop(at)
            kinds, hidden = stack[-1][1:3] if stack else (frozenset(), False)
            continue
        flush()
        if tag in _VOID:
            continue
        in_link = 0 if tag in _BLOCKY else in_link
        if not closing:
            if base >= 0 and (stack[base][0] in _CLOSES.get(tag, ()) or stack[base][0] == "p" and tag in _BLOCKY):
                pop(base)
            if not attrs.endswith("/"):
                push(tag, attrs)
        elif open_[tag] > 0:
            pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        kinds, hidden = stack[-1][1:3] if stack else (frozenset(), False)
        heading = not closing and tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    if pos < len(page) and not hidden:
        put(page[pos:])
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row a block: its words and link density, those of its neighbours, and the kinds of places it stands in."""
    n = len(found)
    x = np.zeros((n + 2, len(FEATURES)))
    for i, b in enumerate(found, 1):
        x[i, 0], x[i, 1], x[i, 6] = b.words, min(1.0, b.linked / max(1, b.words)), b.heading
        x[i, 7:] = [k in b.kinds for k in _KINDS]
    x[1:-1, 2:4], x[1:-1, 4:6] = x[:-2, :2], x[2:, :2]
    return x[1:-1]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 1) -> tuple:
    """A decision tree by Gini impurity: (share of main text,) or (feature, threshold, below, above)."""
    p = float(y.mean()) if len(y) else 0.0
    if depth == 0 or p in (0.0, 1.0) or len(y) < 2 * least:
        return (p,)
    best = (1e-9, 0, 0.0)
    total = p * (1 - p) * len(y)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, w = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        k = cut + 1.0
        a, b = w[cut] / k, (w[-1] - w[cut]) / (len(y) - k)
        gain = total - a * (1 - a) * k - b * (1 - b) * (len(y) - k)
        i = int(gain.argmax())
        if gain[i] > best[0] + 1e-12:
            best = (float(gain[i]), f, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if best[0] <= 1e-9:
        return (p,)
    below = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least))


def judge(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    out, below = np.zeros(len(x), dtype=bool), x[:, tree[0]] <= tree[1]
    out[below], out[~below] = judge(tree[2], x[below]), judge(tree[3], x[~below])
    return out


_PROSE = ("the river rises in the northern hills and runs south for most of its length before it turns to the coast where three towns share a harbour " * 8).split()


def _plain_layouts() -> list[tuple[str, list[bool]]]:
    """Pages of bare div, p and list elements, so that only words and links of a block and its neighbours tell text from the rest: menus, teasers and
    lists of links before, between and after paragraphs of all lengths, with links inside them, and short lines at the end."""
    out, say = [], lambda n, at=0: " ".join(_PROSE[at % 20 : at % 20 + n]).capitalize()
    link = lambda n, at=0: f"<a href='/{at}'>{say(n, at)}</a>"
    for i in range(48):
        menu = [(f"<div>{link(1 + (i + k) % 3, k)}</div>", False) for k in range(3 + i % 4)]
        teasers = [(f"<div>{link(5 + (i + 2 * k) % 8, k)}</div>", False) for k in range(2 + i % 3)]
        bar = [(f"<div>{link(2, 1)} | {link(1, 2)} | {link(2, i)}</div>", False)]
        long = [(f"<p>{say(25 + (i * 7 + 13 * k) % 70, k)}.</p>", True) for k in range(2 + i % 3)]
        linked = [(f"<p>{say(12 + i % 9)} {link(2 + i % 4, i)} {say(14, i)}.</p>", True)]
        short = [(f"<p>{say(3 + i % 6, i)}.</p>", True)]
        heads = [(f"<h1>{say(3 + i % 7, i)}</h1>", True)] * (i % 3 > 0)
        items = [(f"<li>{say(6 + (i + k) % 9, k)}.</li>", True) for k in range(2 + i % 2)]
        end = [(f"<div>{say(2 + i % 5, i)}</div>", False), (f"<div>{link(1, i)} {link(2, i + 1)}</div>", False)]
        middle = [long + short + linked, linked + long, long + items + linked, long[:1] + short + long[1:] + linked][i % 4]
        for parts in (menu + heads + middle + bar + end, bar + teasers + heads + middle + teasers + end, menu + bar + heads + middle + teasers + end[:1], teasers + menu + heads + long + bar + end)[i % 2 :: 2]:
            out.append(("".join(p for p, _ in parts), [y for _, y in parts]))
    return out


def labelled_pages() -> list[tuple[str, list[bool]]]:
    """The small labelled table: pages, and whether each of their blocks is main text. Bare layouts, which words and links tell apart, and layouts
    with texts of all lengths in places that are named."""
    lengths = [(1, 40, 2, 90), (30, 1, 12, 5), (3, 3, 60, 1), (100, 20, 1, 2)]
    say = lambda n, at=0: " ".join(_PROSE[at : at + n]).capitalize() + "."
    out = _plain_layouts()
    for i, body in enumerate(lengths):
        for j, rest in enumerate(lengths):
            aside, fine, more = say(rest[0], i), say(rest[1], j), say(rest[3], i + j)
            menu = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>" + say(rest[2] % 7 + 1, i) + "</a></li></ul></nav>"
            text = "".join(f"<p>{say(n, k)}</p>" for k, n in enumerate(body))
            article = f"<article><h1>{say(body[i])}</h1>{text}<p><a href='/z'>{say(body[j])}</a></p></article>"
            main, yes = [True] * 6, [True] * 4
            foot = f"<footer>&copy; {fine}</footer>"
            out += [
                (menu + f"<div class='ad'>{aside}</div>" + article + foot, [False] * 3 + main + [False]),
                (f"<header><h2>{fine}</h2><p>{aside}</p></header>" + article + foot, [False] * 2 + main + [False]),
                (article + f"<aside><h3>{fine}</h3><p>{aside}</p><p>{more}</p></aside>" + foot, main + [False] * 4),
                (f"<form><p>{aside}</p><p>{fine}</p></form>" + article, [False] * 2 + main),
                (f"<div class='cookie-notice'>{aside}</div>" + article + f"<div id='comments'><h3>{more}</h3><p>{aside}</p><p>{fine}</p></div>", [False] + main + [False] * 3),
                (f"<div class='menu'><a href='/'>{fine}</a><br><a href='/x'>{aside}</a></div>" + f"<main><h1>{more}</h1>{text}</main>" + foot, [False] + [True] + yes + [False]),
                (f"<div class='content'><h1>{more}</h1>{text}</div><div class='sidebar'><p>{aside}</p></div>", [True] + yes + [False]),
                (f"<article><header><h1>{more}</h1></header>{text}<footer>{aside}</footer></article>", [True] + yes + [False]),
                (text + foot, yes + [False]),
                (f"<div class='banner'>{aside}</div><h1>{more}</h1>{text}", [False, True] + yes),
                ("<div><a href='/'>Start</a></div><div><a href='/a'>Archive</a></div>" + f"<h1>{more}</h1>{text}" + "<div>Copyright <a href='/'>Example Site</a> <a href='/t'>Terms of use</a></div>", [False] * 2 + [True] + yes + [False]),
            ]
            for kind in ("advert", "comments", "newsletter", "related", "share", "search-form", "breadcrumb", "footer"):
                out.append((f"<article><h2>{more}</h2><p>{say(body[1])}</p><div class='{kind}'><p>{aside}</p><p>{fine}</p></div><p>{say(body[2])}</p></article>", [True, True, False, False, True]))
    return out


def train_tree() -> tuple:
    xs, ys = [], []
    for page, labels in labelled_pages():
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels: {page[:80]}")
        xs.append(features(found))
        ys.append(np.array(labels, dtype=float))
    return grow(np.vstack(xs), np.concatenate(ys))


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    kept = judge(tree, features(found))
    return "\n\n".join(b.text for b, k in zip(found, kept) if k)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds text and n_chars to pages: the main text of each page; every row returns once and other columns stay.

    Null and empty pages have an empty text; so has a page of which no block is main text. Nothing is cut off."""
    made = ("text", "n_chars")
    kept = [c for c in pages.columns if c not in made]
    schema = extended(pages.select(*kept), "text string, n_chars long")
    tree = train_tree()

    def run(batches):
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*kept, *made])

    return batched(pages.select(*kept)).mapInArrow(run, schema)


def op7_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
