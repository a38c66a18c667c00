"""Blocks of text of an HTML page, each with the region it stands in; a forgiving single pass, no tree.

Regions: ``content`` (inside what the page declares to be its article), ``chrome`` (declared menus, headers, footers, sidebars,
notices, adverts, forms, reader comments) and ``open`` (neither). An element's region is read from its name, its role and
the words of its class and id; the innermost declaration counts, but nothing inside a nav, footer, aside or comment list,
and no chrome inside an article, becomes content again. An article's own header belongs to it.
"""

from __future__ import annotations

import re
from html import unescape

# --- fixed values: element names and words of class, id and role ---
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SHUT = frozenset("nav footer aside menu button select svg canvas object audio video dialog head".split())
SHUT_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog menu menubar".split())
CHROME_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar footer colophon sidebar aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored "
    "promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social "
    "related recommended widget widgets pagination pager toolbar skip".split()
)
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies".split())
# --- end of fixed values ---

CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

MARK = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
OPEN, SOFT, CONTENT, HARD = range(4)
REGION = {OPEN: "open", SOFT: "chrome", CONTENT: "content", HARD: "chrome"}
_END = {name: re.compile(rf"</{name}(?![a-zA-Z0-9-])", re.I) for name in RAW}


def _declared(state: int, name: str, attrs: str) -> int:
    """The state inside an element that opens in ``state``."""
    if state == HARD or name in SHUT:
        return HARD
    words: set[str] = set()
    role = prop = ""
    if attrs and name not in ("html", "body"):
        for key, a, b, c in NAMES.findall(attrs):
            key, value = key.lower(), a or b or c
            if key == "role":
                role = value.strip().lower()
            elif key == "itemprop":
                prop = value
            else:
                words.update(w.lower() for w in WORD.findall(value))
    if words & COMMENT_WORDS or role in SHUT_ROLES:
        return HARD
    if name in ("article", "main") or role in ("article", "main") or "articleBody" in prop:
        return CONTENT
    if name == "header" or role == "banner" or "header" in words:
        return state if state == CONTENT else SOFT
    if name in ("form", "fieldset") or role in ("form", "alert") or words & CHROME_WORDS:
        return HARD if state == CONTENT else SOFT
    return state


def blocks(html: str) -> tuple[list[tuple[str, str]], bool]:
    """(text, region) of every block in page order, and whether the page declares an article.

    A block is what stands between borders of block-level elements: references decoded, white space turned into single
    spaces, trimmed; empty ones are left out. A line break inside a block is white space. Text of scripts, styles, the head and
    of marks cut off at the end is no text.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, int]] = []
    state, declared = OPEN, False
    shown: list[str] = []
    cut: list[str] = []
    region, blank = OPEN, True

    def border() -> None:
        nonlocal blank
        blank = True
        for parts, where in ((shown, region), (cut, HARD)):
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    out.append((text, REGION[where]))
                parts.clear()

    at, size = 0, len(html)
    while at < size:
        m = MARK.search(html, at)
        end = m.start() if m else size
        if end > at:
            piece = html[at:end]
            if "&" in piece:
                piece = unescape(piece)
            if state in (SOFT, HARD):
                cut.append(piece)
            else:
                if blank:
                    region, blank = state, piece.isspace()
                shown.append(piece)
        if not m:
            break
        at = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            (cut if state in (SOFT, HARD) else shown).append(" ")
            continue
        block = name in BLOCK
        if block:
            border()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    state = stack[i][1]
                    del stack[i:]
                    break
            continue
        if name in RAW:
            stop = _END[name].search(html, at)
            at = stop.start() if stop else size
            continue
        if name in VOID or attrs.endswith("/") and not block:
            continue
        if name == "body":
            stack.clear()
            state = OPEN
            continue
        if block:
            # a paragraph, and inline elements left open in it, end where a block begins
            while stack and stack[-1][0] not in BLOCK or stack and stack[-1][0] == "p":
                state = stack.pop()[1]
        if name in CLOSES:
            own, inside = CLOSES[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in inside:
                    break
                if stack[i][0] in own.split():
                    state = stack[i][1]
                    del stack[i:]
                    break
        stack.append((name, state))
        state = _declared(state, name, attrs)
        declared |= state == CONTENT
    border()
    return out, declared
