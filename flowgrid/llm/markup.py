"""A page's elements and blocks of text, read leniently from its markup."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import xxhash

# What the elements of HTML are.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTS = HEADINGS | frozenset("p li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption address".split())
BLOCKS = TEXTS | frozenset(
    "html head body article aside center details dialog div fieldset footer form header hgroup main menu nav noframes optgroup option search section select summary template svg button video audio object canvas math".split()
)
IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: An element of this name ends open ones of these names, up to an element of those.
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tr": ("tr td th", "table"), **dict.fromkeys(("thead", "tbody", "tfoot"), ("thead tbody tfoot tr td th", "table")),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
# Elements, and words of class, id and role, that mark what is not the article.
ASIDE = frozenset("nav aside footer form menu dialog head template svg button select option search video audio object canvas math".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer "
    "discussion disqus footer form gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion "
    "recommended related replies reply responses search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
HEADER_WORDS = frozenset({"header"})
MAIN_WORDS = frozenset("article content entry main post story".split())
NEGATIONS = frozenset("has no with without".split())

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

#: How a node counts: part of the page's main text, never, or only its headings.
FULL, NEVER, ONLY_HEADINGS = range(3)


class Node(NamedTuple):
    """An element with its place among elements: ``path`` is a hash of the names and classes from the root to it."""

    path: int
    name: str
    use: int
    level: int  # 2 in an article, 1 in what is marked as main, else 0
    chain: tuple[int, ...]
    names: tuple[str, ...]


class Block(NamedTuple):
    node: Node
    text: str
    links: int  # characters of it inside links


ROOT = Node(xxhash.xxh64_intdigest("") >> 1, "", FULL, 0, (), ())


@lru_cache(maxsize=1 << 14)
def _marks(name: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Of a tag: its label, and whether it is marked as aside, hidden, header or main."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)} if "=" in attributes else {}
    hidden = found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower() or bool(_HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", '""', attributes)))
    words = set()
    for token in " ".join(found.get(k, "") for k in ("class", "id", "role")).split():
        parts = [w.lower() for w in _WORD.findall(token)]
        if parts and parts[0] not in NEGATIONS:
            words.update(parts)
    label = " ".join([name, *sorted(_DIGITS.sub("0", found.get("class", "")).split())])
    return label, bool(words & ASIDE_WORDS), hidden, bool(words & HEADER_WORDS), bool(words & MAIN_WORDS)


@lru_cache(maxsize=1 << 16)
def _child(parent: Node, name: str, attributes: str) -> Node:
    label, aside, hidden, header, main = _marks(name, attributes)
    whole = name in ("html", "body", "article", "main")  # classes of these say something of the page
    level = max(parent.level, 2 if name == "article" else 1 if name == "main" or main and not whole and not aside else 0)
    use = parent.use
    if hidden or name in ASIDE or aside and not whole:
        use = NEVER
    elif (name == "header" or header and not whole) and use == FULL:
        use = ONLY_HEADINGS if parent.level else NEVER
    elif use == ONLY_HEADINGS and name in HEADINGS:
        use = FULL
    path = xxhash.xxh64_intdigest(label, seed=parent.path) >> 1
    return Node(path, name, use, level, (*parent.chain, path), (*parent.names, name))


def inline_path(node: Node, name: str) -> int:
    return xxhash.xxh64_intdigest(name, seed=node.path) >> 1


def text_path(node: Node, text: str) -> int:
    return xxhash.xxh64_intdigest("\0" + text, seed=node.path) >> 1


def read(html: str) -> tuple[list[tuple[int, Node, str]], list[Block]]:
    """All opened elements in order (path, the block element it is or stands in, name), and the blocks of text in order.

    A block is the text between two starts or ends of block elements: references decoded, white space made one blank, trimmed.
    Scripts, styles, comments and the like have no text. Elements that are never closed end with what they are in.
    """
    opened, blocks, stack, text, links = [], [], [ROOT], [], 0
    link_depth = 0  # of the block element in which a link was opened
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                blocks.append(Block(stack[-1], joined, min(links, len(joined))))
            text.clear()
        links = 0

    while at < end:
        mark = _MARK.search(html, at)
        begin = mark.start() if mark else end
        if begin > at:
            text.append(html[at:begin])
            if link_depth:
                links += begin - at
        if not mark:
            break
        at = mark.end()
        name = mark[2] or mark[5]
        if not name:
            if mark[0].startswith("<![CDATA["):
                text.append(mark[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if mark[1] or mark[4]:  # an end
            if name == "a":
                link_depth = 0
            elif name in BLOCKS:
                k = len(stack) - 1
                while k and stack[k].name != name:
                    k -= 1
                flush()
                if k:
                    del stack[k:]
                    if len(stack) < link_depth:
                        link_depth = 0
            continue
        attributes = mark[3] if mark[2] else mark[6]
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            opened.append((inline_path(stack[-1], name), stack[-1], name))
            at = close.end() if close else end
        elif name not in BLOCKS:
            opened.append((inline_path(stack[-1], name), stack[-1], name))
            if name == "br":
                text.append(" ")
            elif name == "hr":
                flush()
            elif name == "a":
                link_depth = len(stack)
        else:
            flush()
            top = stack[-1].name
            if top == "p" or top in HEADINGS and name in HEADINGS or top == "head" and name not in IN_HEAD:
                stack.pop()
            if name in ENDS:
                ended, upto = ENDS[name]
                k = len(stack)
                for j in range(len(stack) - 1, 0, -1):
                    if stack[j].name in upto:
                        break
                    if stack[j].name in ended:
                        k = j
                del stack[k:]
            if name in ("html", "body") and any(n.name == name for n in stack):
                continue
            stack.append(_child(stack[-1], name, attributes.strip()))
            opened.append((stack[-1].path, stack[-1], name))
            if len(stack) <= link_depth:
                link_depth = 0
    flush()
    return opened, blocks
