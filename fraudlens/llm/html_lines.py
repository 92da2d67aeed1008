"""HTML to text lines with zones, in one linear pass over the markup.

A line is the text of one block: references decoded, white space turned into
single spaces. Its zone says what the markup alone tells about it: ``A`` inside an
article or main element, ``C`` inside menus, headers, footers, sidebars, notices,
adverts, forms, comments and the like, ``U`` (undecided) elsewhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

ARTICLE, CHROME, UNDECIDED = "A", "C", "U"
#: Inside a form, which may wrap a whole page: chrome, except for an article in it.
_FORM = "F"

# Elements of HTML, by what they mean here: names fixed by the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp template svg object".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark "
                    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CHROME_TAGS = frozenset("nav footer aside form menu dialog head button select datalist video audio canvas".split())
_MAIN = frozenset(("article", "main"))
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# Words of class and id attributes that name what is not the article.
_CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices disclaimer alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "sidebars footer comment comments disqus respond reply replies share sharing social newsletter subscribe "
    "subscription related recommended widget popup modal overlay login signup masthead toolbar pagination".split())
# Beside these words the others describe a layout around the article, not a part to drop.
_LAYOUT_WORDS = frozenset("with has no without content main article post page wrapper layout container".split())

_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What a tag's end is looked for by: its mark, or an equals sign, which a quoted value may follow.
_MARK = re.compile(r"[>=]")
_VALUE = re.compile(r"""\s*+(["'])""")
_ATTRIBUTE = re.compile(r"""([^\s/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]*+)))?""")
_READ = frozenset(("class", "id", "role"))
_WORDS = re.compile(r"[a-z]+")


def _names_chrome(tag: str, attributes: str) -> bool | None:
    """True: not the article; None: the main part; False: the attributes tell nothing."""
    main = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name not in _READ:
            continue
        if name == "role":
            if value in _CHROME_ROLES:
                return True
            main = main or value in ("main", "article")
        else:
            for one in value.split():  # each class by itself
                words = set(_WORDS.findall(one))
                if words & _CHROME_WORDS and not words & _LAYOUT_WORDS and tag not in ("html", "body", "main"):
                    return True
    return None if main else False


class _Tags:
    """Ends of tags, quoted values of any length heeded, in time linear in the page.

    A quote after an equals sign opens a value if one like it follows to close it. A search
    that finds no end leaves the equals signs it passed, from which none is found later either."""

    def __init__(self, html: str):
        self._html = html
        self._last = {q: html.rfind(q) for q in "\"'"}
        self._endless: set[int] = set()

    def end(self, at: int) -> int:
        """Position of the mark that ends a tag whose attributes begin at ``at``: the
        first one outside values, or the first one where values hold all of them; -1: none."""
        html, passed, first = self._html, [], at
        while m := _MARK.search(html, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            if m.start() in self._endless:
                break
            passed.append(m.start())
            value = _VALUE.match(html, at)
            if value and self._last[value[1]] >= value.end():
                at = html.find(value[1], value.end()) + 1
        self._endless.update(passed)
        return html.find(">", first)


def lines(html: str | None) -> list[tuple[str, str]]:
    """(text, zone) of every line that is not empty, in page order."""
    return [(text, CHROME if zone == _FORM else zone) for text, zone in _lines(html)] if html else []


def _lines(html: str) -> Iterator[tuple[str, str]]:
    zone = UNDECIDED
    stack: list[tuple[str, str]] = []  # open elements, and the zone outside each
    opened: Counter = Counter()
    held: list[str] = []
    tags = _Tags(html)
    at, end, last_tag_end = 0, len(html), html.rfind(">")

    def line() -> str:
        text = " ".join("".join(held).split())
        held.clear()
        return text

    def close(tag: str) -> str:
        """Close elements up to the named one; the zone outside it."""
        while True:
            name, outside = stack.pop()
            opened[name] -= 1
            if name == tag:
                return outside

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            held.append(unescape(html[at:lt]))
        if lt == end:
            break
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if lt > last_tag_end:  # no tag ends any more
            held.append(unescape(html[lt:]))
            break
        m = _TAG_NAME.match(html, lt)
        stop = tags.end(m.end()) if m else -1
        if stop < 0:
            if html[lt + 1:lt + 2] in ("!", "?", "/"):  # a declaration, or an end tag without a name
                at = html.find(">", lt) + 1
            else:
                held.append("<")
                at = lt + 1
            continue
        at = stop + 1
        closing, tag, attributes = m[1], m[2].lower(), html[m.end():stop]
        inline = tag in _INLINE
        if closing:
            if not inline and (text := line()):
                yield text, zone
            if opened[tag] and (not inline or stack[-1][0] == tag):
                if inline and (text := line()):
                    yield text, zone
                zone = close(tag)
            continue
        if tag in _RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            if not inline and (text := line()):
                yield text, zone
            at = end if not stop else stop.start()
            opened[tag] += 1
            stack.append((tag, zone))
            continue
        if inline:
            if attributes and zone != CHROME and _names_chrome(tag, attributes):
                if text := line():
                    yield text, zone
                stack.append((tag, zone))
                opened[tag] += 1
                zone = CHROME
            continue
        if text := line():
            yield text, zone
        if tag in _VOID:
            continue
        if stack and stack[-1][0] == "p":
            zone = close("p")
        elif tag == "li" and stack and stack[-1][0] == "li":
            zone = close("li")
        stack.append((tag, zone))
        opened[tag] += 1
        named = _names_chrome(tag, attributes) if attributes else False
        if named is True or tag in _CHROME_TAGS or (tag == "header" and zone != ARTICLE):
            zone = _FORM if tag == "form" and zone == UNDECIDED and not named else CHROME
        elif (tag in _MAIN or named is None) and zone != CHROME:
            zone = ARTICLE
    if text := line():
        yield text, zone
