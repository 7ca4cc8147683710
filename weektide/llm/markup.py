"""HTML pages as trees of elements and text, for wrappers to align."""

from __future__ import annotations

import html
import re

# Nesting below this depth is laid flat, so that no page can exhaust the stack; its text stays.
MAX_DEPTH = 120

# Element names of the HTML standard and their kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big br button canvas cite code data del dfn em font i img input ins kbd label map mark math "
    "noscript object output picture q rp rt ruby s samp select small span strike strong sub sup svg template time tt u "
    "var video audio wbr".split()
)
# Elements that a new one of the same group ends, and where the search for an open one stops.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"p": set("table td th article section main aside nav header footer form button body ul ol".split())}
SCOPE = set("ul ol dl table select article section main body".split())

# What elements and the words of their class, id and role say about their content.
DROPPED = set("nav footer aside form noscript template object svg math canvas audio video select button dialog menu head".split()) | RAW
FRAME_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer foot contentinfo sidebar aside complementary "
    "cookie cookies consent gdpr notice notices notification alert banner popup modal overlay dialog ad ads adv advert "
    "adverts advertisement advertising sponsor sponsored promo promotion form search login signup subscribe subscription "
    "newsletter share sharing social related recommended recommendations pagination pager toolbar widget copyright legal "
    "disclaimer hidden".split()
)
COMMENT_WORDS = set("comment comments reply replies respond disqus discussion".split())
CONTENT_WORDS = set("article articlebody post entry story content main".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^<>]*\Z|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NOT_WORD = re.compile(r"[^a-z]+")


def marker(name: str, attrs: str) -> str:
    """``-`` frame around the content, ``c`` comments, ``h`` header, ``+`` content, or nothing."""
    if name == "header":
        return "h"
    if not attrs.strip():
        return ""
    found = ""
    for attribute, value in ATTRIBUTE.findall(attrs):
        attribute, value = attribute.lower(), value.strip("\"'")
        if attribute == "hidden" or (attribute == "aria-hidden" and value.lower() == "true"):
            return "-"
        if attribute == "style":
            if re.search(r"display\s*:\s*none", value, re.I):
                return "-"
            continue
        words = set(NOT_WORD.split(CAMEL.sub(" ", value).lower()))
        if words & COMMENT_WORDS:
            return "c"
        if words & FRAME_WORDS:
            found = "-"
        elif "header" in words and not found:
            found = "h"
        elif words & CONTENT_WORDS and not found:
            found = "+"
    return found


class Element:
    """An element by name and marker, with elements and texts in page order."""

    __slots__ = ("name", "key", "children")

    def __init__(self, name: str, mark: str):
        self.name, self.key, self.children = name, f"{name}:{mark}" if mark else name, []


def parse(page: str | None) -> Element:
    """Tree of a page. Unclosed, unknown and broken elements are taken as browsers take them, roughly."""
    root = Element("#page", "")
    stack = [root]
    page = page or ""
    at = 0
    while at < len(page):
        token = TOKEN.match(page, at)
        at = token.end()
        name = token["name"]
        if name is None:
            text = token["cdata"] if token["cdata"] is not None else html.unescape(token["text"] or "")
            if text:
                stack[-1].children.append(text)
            continue
        name = name.lower()
        if token["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        known = name if name in BLOCK or name in INLINE or name in VOID or name in RAW else "x"
        if known in BLOCK:
            close(stack, {"p"}, SCOPES["p"])
        if known in ENDS:
            close(stack, ENDS[known], SCOPE)
        element = Element(known, marker(known, token["attrs"]))
        stack[-1].children.append(element)
        if known in RAW:
            end = re.compile(rf"</{known}\s*>|\Z", re.I).search(page, at)
            at = end.end()
        elif known not in VOID and not token["attrs"].endswith("/") and len(stack) < MAX_DEPTH:
            element.name = name
            stack.append(element)
    return root


def close(stack: list[Element], names: set[str], scope: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            del stack[i:]
            return
        if stack[i].name in scope:
            return
