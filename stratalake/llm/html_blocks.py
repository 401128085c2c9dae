"""Text blocks of an HTML page, each with the part of the page it stands in.

Tags are read one after another with a stack of open elements, so markup that is never
closed or wrongly nested still gives blocks. Elements whose name, role, class or id says
menu, header, footer, sidebar, notice, advert, form or reader comments give no blocks.
"""

from __future__ import annotations

import re
from html import unescape

#: Parts of a page, the better known to be main text the higher.
HIDDEN, DROPPED, PLAIN, MAIN, ARTICLE = range(5)

#: Names of HTML elements.
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes noscript xmp".split())
BLOCKS = set("""address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section select
    summary table tbody td tfoot th thead tr ul""".split())
NEVER = set("nav aside footer menu dialog template svg math canvas audio video object applet map datalist select button".split())
ENDS_PARAGRAPH = BLOCKS - set("br button caption legend optgroup option select tbody td tfoot th thead tr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BARRIERS = set("ul ol dl table select article section main body div".split())

NEVER_ROLES = set("navigation complementary contentinfo search form dialog alertdialog alert menu menubar toolbar banner".split())
#: Words of a class or id that name a part outside the main text.
COMMENTS = set("comment comments commentlist disqus".split())
ASIDE = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion cookie cookies consent gdpr
    newsletter subscribe subscription signup sidebar sidebars nav navbar navigation breadcrumb breadcrumbs share sharing social footer pagination
    pager popup modal masthead topbar related recommended respond replies""".split())
#: Words that also name parts of an article, so inside one they count as a whole name only.
LOOSE = set("header banner notice notices menu menus overlay search login skip copyright widget widgets toolbar".split())
#: A part with a sidebar is none.
JOINING = set("with has no without".split())
CONTENT = set("content main article post entry story articlebody maincontent".split())

_NAME = r"[A-Za-z][^\s/>]*"
_ATTRIBUTE = r"[^\s/>=][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)?"
TAG = re.compile(rf"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)({_NAME})((?:{_ATTRIBUTE}|[\s/=])*+)>|[!?/][^>]*>)", re.S)
OPENS = re.compile(r"<(?:/?[A-Za-z]|[!?])")
FIELD = re.compile(r"([^\s/>=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))|([^\s/>=]+)")
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


def fields(text: str) -> dict[str, str]:
    """Attributes by name; the first of a name counts."""
    out: dict[str, str] = {}
    for m in FIELD.finditer(text):
        out.setdefault((m[1] or m[5]).lower(), unescape(next((v for v in m.group(2, 3, 4) if v is not None), "")))
    return out


def _named(value: str) -> tuple[set[str], set[str]]:
    """Whole class names, and all words they are made of, in lower case."""
    whole = value.split()
    return {w.lower() for w in whole}, {p.lower() for w in whole for p in WORDS.findall(w)}


def _zone(name: str, attributes: str, outer: int) -> int:
    """The part of the page that an element opens inside a part."""
    if outer == HIDDEN:
        return HIDDEN
    own = fields(attributes) if attributes and not attributes.isspace() else {}
    style = own.get("style", "").replace(" ", "").lower()
    role = own.get("role", "").lower()
    if name in NEVER or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return HIDDEN
    if role in NEVER_ROLES and not (role == "banner" and outer == ARTICLE) or name == "header" and outer != ARTICLE:
        return HIDDEN
    whole, words = _named(f"{own.get('class', '')} {own.get('id', '')}") if "class" in own or "id" in own else (set(), set())
    if name == "article":
        return HIDDEN if whole & (COMMENTS | ASIDE) else ARTICLE
    if name in ("html", "body"):
        return outer
    if words & COMMENTS:
        return HIDDEN
    if name == "main" or role == "main" or own.get("itemprop", "").lower() == "articlebody":
        return max(outer, MAIN)
    if name == "form" or outer == DROPPED:
        return DROPPED
    heads = outer == ARTICLE and name in ("header", "hgroup", "h1", "h2", "h3", "h4", "h5", "h6")
    if whole & (ASIDE | LOOSE) and not heads:
        return HIDDEN
    if words & (ASIDE if outer == ARTICLE else ASIDE | LOOSE) and not words & JOINING and not heads:
        return DROPPED
    return max(outer, MAIN) if words & CONTENT else outer


class Page:
    """Blocks of one page in page order: ``zones`` and ``lines``."""

    def __init__(self, html: str | None):
        self.zones: list[int] = []
        self.lines: list[str] = []
        self.stack: list[tuple[str, int]] = []
        self.now: list[str] = []
        self.zone = self.now_zone = PLAIN
        self._read(html or "")
        self._end_block()

    def _end_block(self) -> None:
        if self.now:
            line = " ".join("".join(self.now).split())
            self.now.clear()
            if line:
                self.zones.append(self.now_zone)
                self.lines.append(line)

    def _text(self, text: str) -> None:
        if text and self.zone >= PLAIN:
            if self.zone != self.now_zone:
                self._end_block()
                self.now_zone = self.zone
            self.now.append(unescape(text) if "&" in text else text)

    def _pop(self, index: int) -> None:
        del self.stack[index:]
        self.zone = self.stack[-1][1] if self.stack else PLAIN

    def _close(self, names: set[str], barriers: set[str]) -> None:
        """Closes the innermost open element of these names, unless a barrier stands before it."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in names:
                return self._pop(i)
            if name in barriers:
                return None
        return None

    def _open(self, name: str, attributes: str) -> None:
        if name in ENDS_PARAGRAPH:
            self._close({"p"}, BARRIERS)
        if name in SIBLINGS:
            self._close(SIBLINGS[name], BARRIERS)
        if name not in VOID:
            self.zone = _zone(name, attributes, self.zone)
            self.stack.append((name, self.zone))

    def _read(self, html: str) -> None:
        at = seek = 0
        while (cut := html.find("<", seek)) >= 0:
            m = TAG.match(html, cut)
            if not m:
                if OPENS.match(html, cut):  # never closed: the rest is no text
                    self._text(html[at:cut])
                    return
                seek = cut + 1
                continue
            self._text(html[at:cut])
            at = seek = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if name in BLOCKS:
                self._end_block()
            if m[1]:
                self._close({name}, set() if name in BLOCKS else BLOCKS)
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                if not end:
                    return
                at = seek = end.end()
            else:
                self._open(name, m[3])
        self._text(html[at:])
