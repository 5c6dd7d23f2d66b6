"""Pages as runs of tags and text, with the element path and the part that each belongs to."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

#: Elements whose content is no markup; what they hold is never text of the page, nor is that of the next group.
RAW = ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")
NEVER = frozenset((*RAW, "head", "noscript", "template", "svg", "math", "form", "button", "select", "object", "dialog", "aside", "footer", "canvas", "audio", "video"))
#: Elements that are no main text unless one of MAIN opens within them.
AROUND = frozenset(("nav", "menu", "header"))
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold blocks and are no block of running text themselves.
HOLDERS = frozenset("html body div section article main center td details fieldset header".split())
#: Opening one of these ends an open one of the group, up to the element that holds the group.
ENDS = {
    **dict.fromkeys(("li",), (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir")))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset(("tr", "table")))),
    **dict.fromkeys(("tr",), (frozenset(("tr", "td", "th")), frozenset(("table",)))),
    **dict.fromkeys(("option",), (frozenset(("option",)), frozenset(("select",)))),
}
#: Words in a class or id that mark what stands around the main text, and values of role= that do.
AROUND_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner toolbar pager pagination skip topbar".split()
)
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo sidebar footer cookie cookies consent notice comment comments disqus"
    " respond newsletter subscribe share sharing social related recommended popup modal widget".split()
)
NEVER_ROLES = frozenset(("complementary", "contentinfo", "search", "form", "dialog", "alert", "alertdialog"))
AROUND_ROLES = frozenset(("navigation", "banner", "menu", "menubar", "toolbar"))
#: First words that make a class a statement about the whole page or article.
STATES = frozenset(("has", "with", "no", "is", "without", "single"))

_BARE = r"""(?:[^'"<>]++|"[^"]*+"|'[^']*+')*+"""
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW)})\b{_BARE}>(?:.*?</(?P=raw)\b[^>]*>|.*)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>{_BARE})>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ATTRIBUTE = re.compile("class|id|role", re.I)
_SPLIT = re.compile(r"[-_\s]+|(?<=[a-z])(?=[A-Z])")
TEXT, OPEN, CLOSE = 0, 1, 2
#: Levels that a path spells out; elements below are told apart by their own name only, so that paths stay short.
SPELLED = 64

# how an element bears on the text in it
PLAIN, IN_MAIN, IS_AROUND, IS_NEVER = 0, 1, 2, 3


@dataclass(slots=True)
class Event:
    kind: int
    #: The tag, or the decoded text.
    value: str
    #: The path of elements that hold it, or that it opens or closes.
    path: str
    #: PLAIN, IN_MAIN, IS_AROUND or IS_NEVER; whether within a link.
    part: int
    linked: bool


def decoded(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def _marked(names: str, role: str, exempt: bool) -> int:
    if role in NEVER_ROLES:
        return IS_NEVER
    if role in AROUND_ROLES:
        return IS_AROUND
    found = PLAIN
    for name in names.split():
        words = [w.lower() for w in _SPLIT.split(name) if w]
        if not words or words[0] in STATES or (exempt and len(words) > 1):
            continue
        ends = {words[0], words[-1]}
        if ends & NEVER_WORDS:
            return IS_NEVER
        if ends & AROUND_WORDS:
            found = IS_AROUND
    return found


def _opened(tag: str, attributes: str, outer: int) -> tuple[int, str]:
    """How the element bears on its text, and its name in paths."""
    names, role = "", ""
    if _ATTRIBUTE.search(attributes):
        for key, a, b, c in _NAMED.findall(attributes):
            value = html.unescape(a or b or c)
            if key.lower() == "role":
                role = value.strip().lower()
            else:
                names += " " + value
    # names with digits are those of one page
    label = tag + "".join("." + n for n in names.split()[:3] if not any(map(str.isdigit, n)))
    if outer == IS_NEVER or tag in NEVER:
        return IS_NEVER, label
    mark = PLAIN if tag in ("html", "body") else _marked(names, role, tag in MAIN)
    if mark == IS_NEVER:
        return IS_NEVER, label
    if tag in MAIN or role in ("main", "article"):
        return IN_MAIN, label
    if tag in AROUND or mark == IS_AROUND:
        # an article's own header is part of it
        own = outer == IN_MAIN and (tag == "header" or "header" in names.lower())
        return IN_MAIN if own else IS_AROUND, label
    return outer, label


def events(page: str) -> Iterator[Event]:
    """The tags and the text of a page in order; comments, scripts and other raw elements leave nothing."""
    # tag, path, part, linked
    stack: list[tuple[str, str, int, bool]] = []
    open_tags: Counter[str] = Counter()
    top = ("", "", PLAIN, False)
    at = 0

    def cut(depth: int) -> Iterator[Event]:
        nonlocal top
        while len(stack) > depth:
            tag, path, part, linked = stack.pop()
            open_tags[tag] -= 1
            yield Event(CLOSE, tag, path, part, linked)
        top = stack[-1] if stack else ("", "", PLAIN, False)

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            yield Event(TEXT, decoded(page[at : m.start()]), top[1], top[2], top[3])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            for depth in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                if stack[depth][0] == tag:
                    yield from cut(depth)
                    break
                if tag not in BLOCK and stack[depth][0] in BLOCK:
                    break  # an inline element does not end outside of its block
            continue
        if tag in BLOCK:
            group, holders = ENDS.get(tag, (frozenset(("p",)), None))
            for depth in range(len(stack) - 1, -1, -1):
                open_ = stack[depth][0]
                if open_ in group or open_ == "p":
                    yield from cut(depth)
                    if holders is None:
                        break
                elif open_ in BLOCK and (holders is None or open_ in holders):
                    break
        part, label = _opened(tag, m["attributes"] or "", top[2])
        if len(stack) <= SPELLED:
            path = f"{top[1]}/{label}"
        else:
            path = f"{stack[SPELLED - 1][1]}//{label}"
        if tag in VOID:
            yield Event(OPEN, tag, path, top[2], top[3])
            continue
        top = (tag, path, part, top[3] or tag == "a")
        stack.append(top)
        open_tags[tag] += 1
        yield Event(OPEN, tag, path, part, top[3])
    if at < len(page):
        yield Event(TEXT, decoded(page[at:]), top[1], top[2], top[3])
    yield from cut(0)
