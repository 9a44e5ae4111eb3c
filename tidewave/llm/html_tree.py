"""Pages as trees of blocks, and wrappers (union-free regular expressions) over such trees.

A page's text lies in leaves: a leaf is the text of one block between two block tags,
whatever inline tags stand in it. A wrapper node is a list

    [signature, quantity, children, leaf]

where quantity is "1", "?", "+" or "*" and ``leaf`` is what a text leaf carries: the
places of its texts within one page, or sums over pages. "()" signs a repeated group
of several siblings. No node offers alternatives, hence union-free.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from functools import lru_cache

#: How HTML's elements behave.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul button select template noscript svg canvas object video audio datalist".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: An opening tag of the first kind ends open elements of the second kind up to one of the third.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, roles and words of class or id that never hold an article's text.
HARD_TAGS = frozenset("nav footer aside form head select option button datalist template noscript svg canvas object video audio dialog menu".split())
HARD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
HARD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb "
    "breadcrumbs pagination pager masthead topbar footer colophon copyright sidebar widget widgets related recommended recommendations "
    "popular trending share sharing social follow newsletter subscribe subscription signup signin login paywall cookie cookies consent gdpr "
    "notice notices alert disclaimer popup modal overlay toolbar search comment comments respond disqus replies reply skip banner".split()
)
#: Compounds begin or end with them too; the last are not meant.
HARD_STARTS = ("cookie", "advert", "sponsor", "comment", "newsletter", "breadcrumb", "subscri", "recommend", "sidebar", "navbar", "footer")
HARD_ENDS = ("menu", "nav", "navbar", "sidebar", "footer", "banner", "comments", "navigation", "breadcrumbs")
NOT_HARD = frozenset("commentary commentator recommendable".split())
#: Those of them that frames of a whole page bear too, and those that tell a main part.
LAYOUT_WORDS = frozenset("sidebar nav navbar menu footer header widget widgets banner toolbar masthead topbar search".split())
MAIN_WORDS = frozenset("article post entry story content".split())
#: Deeper elements are read as part of the one at this depth.
DEEPEST = 150

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^'\">]*(?:(?:\"[^\"]*\"|'[^']*')[^'\">]*)*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"'>]|\Z)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def signature(tag: str, attributes: str) -> str:
    """The tag with the words of its class, id and role; "!" first if the element is hidden. Numbers don't count."""
    if not attributes or attributes.isspace():
        return tag
    words, role, hidden = set(), "", False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id"):
            words.update(w.lower() for w in _WORD.findall(value))
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
    out = tag + "".join(f".{w}" for w in sorted(words)) + (f"@{role}" if role else "")
    return f"!{out}" if hidden else out


class Page:
    """A page's tree, and its leaves' texts with how much of each stands in links."""

    def __init__(self, source: str | None):
        self.texts: list[str] = []
        self.links: list[int] = []
        self.root = ["", "1", [], None]
        self._stack: list[tuple[str, list]] = [("", self.root)]
        self._parts: list[str] = []
        self._linked, self._in_link = 0, False
        self._read(source or "")

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                self._stack[-1][1][2].append(["#", "1", [], [len(self.texts)]])
                self.texts.append(text)
                self.links.append(min(self._linked, len(text)))
        self._parts, self._linked = [], 0

    def _say(self, text: str) -> None:
        self._parts.append(text)
        if self._in_link:
            self._linked += len(text)

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        self._in_link = False
        stack = self._stack
        if stack[-1][0] == "p" or stack[-1][0] in HEADINGS and tag in HEADINGS:
            stack.pop()
        if tag in IMPLIED_END:
            ends, limits = IMPLIED_END[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in limits:
                    break
                if stack[i][0] in ends:
                    del stack[i:]
        if tag == "hr" or tag in ("html", "body") or len(stack) > DEEPEST:
            return
        node = [signature(tag, attributes), "1", [], None]
        stack[-1][1][2].append(node)
        stack.append((tag, node))

    def _close(self, tag: str) -> None:
        self._flush()
        self._in_link = False
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                del self._stack[i:]
                return

    def _read(self, source: str) -> None:
        at, skip, depth = 0, None, 0  # skip: a hidden or unwanted inline element that is being passed over
        while True:
            found = _MARK.search(source, at)
            if not skip:
                self._say(source[at : found.start()] if found else source[at:])
            if not found:
                break
            at = found.end()
            end, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                if not skip and found[0].startswith("<![CDATA["):
                    self._say(html.escape(found[0][9:].removesuffix("]]>")))
                continue
            tag = tag.lower()
            if tag in RAW and not end:
                closing = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = closing.end() if closing else len(source)
            elif skip:
                if tag in BLOCKS:
                    skip = None
                elif tag == skip:
                    depth += -1 if end else 1
                    if not depth:
                        skip = None
            if skip or tag in RAW:
                continue
            if tag in BLOCKS:
                if end:
                    self._close(tag)
                else:
                    self._open(tag, attributes)
            elif tag == "br":
                self._say(" ")
            elif tag == "a":
                self._in_link = not end
            if tag not in BLOCKS and tag not in VOID and not end and hard(signature(tag, attributes)):
                skip, depth = tag, 1
        self._flush()

    def skeleton(self) -> list:
        """The tree with repeated siblings as one; leaves keep the places of their texts."""
        return ["", "1", collapse([reduced(x) for x in self.root[2]]), None]


@lru_cache(maxsize=1 << 16)
def hard(sign: str) -> bool:
    """Whether an element of this signature is no part of an article, wherever it stands."""
    if sign.startswith("!"):
        return True
    body, _, role = sign.partition("@")
    tag, *words = body.split(".")
    return tag in HARD_TAGS or role in HARD_ROLES or any(map(hard_word, words))


def hard_word(word: str) -> bool:
    return word in HARD_WORDS or word not in NOT_HARD and (word.startswith(HARD_STARTS) or word.endswith(HARD_ENDS))


def words_of(sign: str) -> list[str]:
    return sign.partition("@")[0].split(".")[1:]


def reduced(node: list) -> list:
    return node if node[0] == "#" else [node[0], node[1], collapse([reduced(x) for x in node[2]]), None]


def _several(q: str) -> str:
    return "*" if q in "?*" else "+"


def _joint(a: str, b: str) -> str:
    """The quantity of what is a in one page and b in another."""
    many, none = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return ("*" if none else "+") if many else "?" if none else "1"


def merge(a: list, b: list, quantity: str) -> list:
    """One node for two of the same signature."""
    if a[0] == "#":
        return ["#", quantity, [], add_leaves(a[3], b[3])]
    return [a[0], quantity, align(a[2], b[2]), None]


def add_leaves(a, b):
    if isinstance(a, list):
        return a + b
    same = a["at"] == b["at"]  # two slots of the same pages
    return {
        "pages": max(a["pages"], b["pages"]) if same else a["pages"] + b["pages"], "chars": a["chars"] + b["chars"], "links": a["links"] + b["links"],
        "constant": min(a["constant"], b["constant"]) if same else a["constant"] + b["constant"], "at": a["at"],
    }


def collapse(nodes: list) -> list:
    """Runs of like siblings, or of like groups of up to four, become one repeated node."""
    out: list = []
    for node in nodes:
        out.append(node)
        again = True
        while again:
            again = False
            if len(out) > 1 and out[-2][0] == out[-1][0] != "()":
                last = out.pop()
                both = "+" if "1" in (out[-1][1], last[1]) or "+" in (out[-1][1], last[1]) else "*"
                out[-1] = merge(out[-1], last, both)
                again = True
                continue
            for p in (2, 3, 4):
                tail = [x[0] for x in out[-p:]]
                if len(out) > p and out[-p - 1][0] == "()" and [x[0] for x in out[-p - 1][2]] == tail:
                    group = out[-p - 1]
                    group[2] = [merge(x, y, _joint(x[1], y[1])) for x, y in zip(group[2], out[-p:], strict=True)]
                    del out[-p:]
                    again = True
                    break
                if len(out) >= 2 * p and [x[0] for x in out[-2 * p : -p]] == tail and "()" not in tail:
                    pair = zip(out[-2 * p : -p], out[-p:], strict=True)
                    group = ["()", "+", [merge(x, y, _joint(x[1], y[1])) for x, y in pair], None]
                    out[-2 * p :] = [group]
                    again = True
                    break
    return out


def pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of nodes of two sibling lists that stand for each other: like signatures, in order."""
    seen: dict[str, int] = {}
    place: dict[tuple[str, int], int] = {}
    for i, x in enumerate(a):
        k = seen[x[0]] = seen.get(x[0], -1) + 1
        place[(x[0], k)] = i
    seen.clear()
    found = []
    for j, y in enumerate(b):
        k = seen[y[0]] = seen.get(y[0], -1) + 1
        if (i := place.get((y[0], k))) is not None and (y[0] != "()" or [c[0] for c in a[i][2]] == [c[0] for c in y[2]]):
            found.append((i, j))
    # The longest rising run of places in a, for places in b that rise already.
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (i, _) in enumerate(found):
        k = bisect_left(tails, i)
        tails[k : k + 1] = [i]
        ends[k : k + 1] = [n]
        back.append(ends[k - 1] if k else -1)
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(found[n])
        n = back[n]
    return out[::-1]


def optional(node: list) -> list:
    return [node[0], "*" if node[1] in "+*" else "?", node[2], node[3]]


def align(a: list, b: list) -> list:
    """One sibling list for two: what stands in both once, what mismatches as optional, what repeats as repeated."""
    out: list = []
    i = j = 0
    for p, q in [*pairs(a, b), (len(a), len(b))]:
        out += [optional(x) for x in a[i:p]] + [optional(x) for x in b[j:q]]
        if p < len(a):
            out.append(merge(a[p], b[q], _joint(a[p][1], b[q][1])))
        i, j = p + 1, q + 1
    return collapse(out)


def leaves(node: list) -> list[list]:
    """Text leaves in order."""
    if node[0] == "#":
        return [node]
    return [x for child in node[2] for x in leaves(child)]


def shape(node: list) -> list:
    """The tree without what its leaves carry."""
    return [node[0], node[1], [shape(x) for x in node[2]]]


def expression(node: list) -> str:
    """The wrapper as a regular expression over tags and texts, for people."""
    inner = "".join(map(expression, node[2]))
    own = "#" if node[0] == "#" else f"({inner})" if node[0] in ("()", "") else f"<{node[0]}>{inner}</>"
    return own if node[1] == "1" else f"({own}){node[1]}"


def fingerprint(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))
