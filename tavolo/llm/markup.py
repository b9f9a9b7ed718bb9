"""Reading web pages: tokens, a folded tree of labelled elements, and text by tree node.

``read_page`` walks the tokens of a page once.  Elements that shape the
page (blocks, and inline ones whose class names a page part) become nodes
of a folded tree: siblings of one label are one node, so the tree has a
node for each kind of place and not for each paragraph.  A label is the
tag with its classes and id, digits left out.  Text belongs to the node
that holds it, white space already single, with a blank where a block
starts or ends; joined in page order, the pieces are the page's text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body br caption head html legend optgroup option tbody td tfoot th thead tr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title".split())
# an element of the first kind ends open ones of the others (up to a boundary)
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",),
        "optgroup": ("option", "optgroup"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
        "tbody": ("td", "th", "tr", "tbody", "thead", "tfoot"), "thead": ("td", "th", "tr", "tbody", "thead", "tfoot"),
        "tfoot": ("td", "th", "tr", "tbody", "thead", "tfoot"), "a": ("a",), "button": ("button",)}
BOUNDARY = {"li": frozenset(("ul", "ol", "menu", "table", "td", "th")), "dd": frozenset(("dl", "table", "td", "th")),
            "dt": frozenset(("dl", "table", "td", "th"))}
SCOPE = frozenset(("table", "td", "th", "caption", "button", "template", "object", "marquee"))
TABLE_PARTS = frozenset(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"))

# Elements and roles that are never main text.
CHROME_TAGS = frozenset(
    "aside button canvas datalist dialog fieldset footer form head iframe input label map math menu nav noembed "
    "noframes noscript object script search select style svg template textarea title".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
                         "search status toolbar".split())
# Names that pages give to such parts (the first or last word of a class or id).
CHROME_NAMES = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment commentlist comments consent "
    "cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notification "
    "overlay pager pagination paywall popup promo promotion recommended related replies reply respond share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
NOT_NAMES = frozenset(("has", "no", "with", "without", "is", "not"))
MAIN_TAGS = frozenset(("article", "main"))
# Blink's limit: elements below this depth are siblings at it, so no text is lost.
MAX_DEPTH = 512

S = r"[ \t\n\r\f]"
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^ \t\n\r\f/>]*)"
                   rf"""((?:[^>"'=]++|={S}*"[^"]*"|={S}*'[^']*'|["'=])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(rf"""(?:^|[ \t\n\r\f"'/])(class|id|role|itemprop){S}*={S}*(?:"([^"]*)"|'([^']*)'|([^ \t\n\r\f"'>]+))""",
                       re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[ \t\n\r\f/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
DIGITS = re.compile("[0-9]+")
WORDS = re.compile("[a-z]+")


@dataclass
class Page:
    """Nodes ``(parent, label)`` in order of appearance, and ``(node, text, linked)`` pieces."""
    nodes: list[tuple[int, str]] = field(default_factory=lambda: [(-1, "root")])
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)

    def skeleton(self) -> str:
        return "\n".join(f"{p} {label}" for p, label in self.nodes)

    def texts(self) -> dict[int, str]:
        """Each node's texts on this page, joined."""
        out: dict[int, list[str]] = {}
        for node, text, _ in self.pieces:
            if not text.isspace():
                out.setdefault(node, []).append(text)
        return {n: " ".join(t) for n, t in out.items()}


def parse_skeleton(skeleton: str) -> list[tuple[int, str]]:
    out = []
    for line in skeleton.split("\n"):
        parent, label = line.split(" ", 1)
        out.append((int(parent), label))
    return out


def hash64(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _names(attributes: str) -> tuple[str, str]:
    """(classes and id as ``.a.b#c`` without digits, role or item property)."""
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m.group(1).lower(), unescape(m.group(2) or m.group(3) or m.group(4) or ""))
    names = "".join(f".{c}" for c in sorted(set(DIGITS.sub("", found.get("class", "")).lower().split())))
    ids = "".join(DIGITS.sub("", found.get("id", "")).lower().split())
    role = found.get("role", "").strip().lower()
    if found.get("itemprop", "").strip().lower() == "articlebody":
        role = "main"
    return (names + (f"#{ids}" if ids else "") + (f"@{''.join(role.split())}" if role else "")), role


def names_chrome(label: str) -> bool:
    """Whether a class, id or role of a label names a page part other than main text."""
    at = re.search("[.#@]", label)
    if not at:
        return False
    for kind, name in re.findall(r"([.#@])([^.#@]+)", label[at.start():]):
        if kind == "@":
            if name in CHROME_ROLES:
                return True
            continue
        words = WORDS.findall(name)
        if words and words[0] not in NOT_NAMES and (words[0] in CHROME_NAMES or words[-1] in CHROME_NAMES):
            return True
    return False


def tag_of(label: str) -> str:
    return re.match("[^.#@]*", label).group()


def read_page(html: str) -> Page:
    """The folded tree and text pieces of a whole page (see the module's text)."""
    page = Page()
    kids: dict[tuple[int, str], int] = {}
    # open elements: (tag, node, whether a block)
    stack: list[tuple[str, int, bool]] = [("", 0, True)]
    open_tags: dict[str, int] = {}
    pieces = page.pieces
    text_from = 0
    gap = False     # a block started or ended since the last text

    def cut(i: int) -> None:
        nonlocal gap
        while len(stack) > i:
            tag, _, block = stack.pop()
            open_tags[tag] -= 1
            gap = gap or block

    def find(tags, boundary) -> int:
        """Index of the innermost open element of ``tags`` inside ``boundary``; 0 if none."""
        if not any(open_tags.get(t) for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in boundary:
                return 0
        return 0

    def text(piece: str) -> None:
        nonlocal gap
        if not piece:
            return
        piece = unescape(piece) if "&" in piece else piece
        words = piece.split()
        if not words:
            if pieces:
                pieces.append((stack[-1][1], " ", False))
            return
        if open_tags.get("head"):
            cut(find(("head",), ()))
        lead = " " if gap or piece[0].isspace() else ""
        tail = " " if piece[-1].isspace() else ""
        pieces.append((stack[-1][1], lead + " ".join(words) + tail, open_tags.get("a", 0) > 0))
        gap = False

    at, end = 0, len(html)
    while True:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[text_from:])
            return page
        text(html[text_from:m.start()])
        at = text_from = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK
        if m.group(1):
            if tag == "br" or tag == "p" and not open_tags.get("p"):
                gap = True      # such end tags stand for an empty element
            elif block or tag in CHROME_TAGS:
                i = find((tag,), () if tag in TABLE_PARTS or tag in ("body", "html") else SCOPE - {tag})
                if i:
                    cut(i)
            elif open_tags.get(tag):
                # an inline end tag reaches no further than the block around it
                i = len(stack) - 1
                while i and not stack[i][2] and stack[i][0] != tag:
                    i -= 1
                if i and stack[i][0] == tag:
                    open_tags[tag] -= 1
                    del stack[i]
            continue
        if open_tags.get("head") and tag not in HEAD_ONLY and tag not in ("head", "html"):
            cut(find(("head",), ()))
        if tag in CLOSES_P and (i := find(("p",), SCOPE)):
            cut(i)
        if tag in ENDS and (i := find(ENDS[tag], BOUNDARY.get(tag, frozenset(("table",))))):
            # the outermost of the run that ends here
            while i > 1 and stack[i - 1][0] in ENDS[tag] and tag not in ("li", "dd", "dt", "a"):
                i -= 1
            cut(i)
        gap = gap or block
        if tag in RAW:
            close = RAW_END[tag].search(html, at)
            at = text_from = close.end() if close else end
            continue
        if tag in VOID:
            continue
        names, _ = _names(m.group(3)) if m.group(3).strip() else ("", "")
        node = stack[-1][1]
        if block or tag in CHROME_TAGS or names and names_chrome(tag + names):
            if len(stack) < MAX_DEPTH:
                key = (node, tag + names)
                if key not in kids:
                    kids[key] = len(page.nodes)
                    page.nodes.append(key)
                node = kids[key]
        stack.append((tag, node, block))
        open_tags[tag] = open_tags.get(tag, 0) + 1


def chrome_nodes(nodes: list[tuple[int, str]]) -> list[bool]:
    """Per node whether it, or a node around it, is a page part other than main text.

    A page's header is one, an article's is not.  A class name does not
    make a node that holds the page's first heading or ``main`` one.
    """
    holds = [tag_of(label) in ("h1", "main") for _, label in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i][0]] |= holds[i]
    out, in_article = [False] * len(nodes), [False] * len(nodes)
    for i, (parent, label) in enumerate(nodes):
        tag = tag_of(label)
        up = parent >= 0
        in_article[i] = tag == "article" or up and in_article[parent]
        out[i] = (up and out[parent] or tag in CHROME_TAGS or tag == "header" and not in_article[i]
                  or names_chrome(label) and tag not in ("html", "body", "main") and not holds[i])
    return out


def main_nodes(nodes: list[tuple[int, str]]) -> list[bool]:
    """Per node whether it lies in an element that is marked as the main text."""
    out = [False] * len(nodes)
    for i, (parent, label) in enumerate(nodes):
        out[i] = parent >= 0 and out[parent] or tag_of(label) in MAIN_TAGS or label.endswith("@main")
    return out
