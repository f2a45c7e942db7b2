"""One pass over a page's HTML: candidate elements with attributes, text, inherited visibility and paint order.

The tree is the path of open elements. Each carries what its descendants inherit: whether it is displayed, its visibility, the opacity
of all its ancestors, and the stacking context that it paints in. Styles are those of ``style`` attributes and the browser's own for
hidden things; style sheets, and boxes, are beyond a scan of HTML.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: What the page scan selects.
TAGS = ("button", "input", "textarea", "select", "img", "h1", "h2", "h3", "h4", "h5", "h6")
ROLES = ("button", "link", "textbox", "searchbox", "checkbox", "radio", "combobox", "listbox", "img", "heading")
#: Fixed values of HTML: elements without content, elements that are never displayed, and blocks, which end a paragraph.
VOID = {"input", "img", "br", "hr", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
NEVER = {"head", "script", "style", "template", "noscript", "title", "meta", "link", "base", "datalist", "param"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: Fixed values of HTML: open elements that a start tag ends where their own end tag was left out.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "td": ("td", "th"), "th": ("td", "th"),
    "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody", "thead"), **dict.fromkeys(BLOCKS, ("p",)),
}


def style_of(text: str | None) -> dict[str, str]:
    """Declarations of a style attribute; of one property the last counts, the important ones before others."""
    out: dict[str, str] = {}
    firm: set[str] = set()
    for part in (text or "").lower().split(";"):
        name, _, value = (x.strip() for x in part.partition(":"))
        if name and value:
            important = value.replace(" ", "").endswith("!important")
            if important or name not in firm:
                out[name] = value.rpartition("!")[0].strip() if important else value
            if important:
                firm.add(name)
    return out


def _number(text: str | None) -> float | None:
    try:
        return float(text[:-1]) / 100 if text.endswith("%") else float(text)
    except (AttributeError, ValueError):
        return None


def _integer(text: str | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


class Node:
    """An open element: its row, if it is a candidate, and what its descendants inherit.

    ``context`` is the place of the stacking context in paint order, ``group`` that of the nearest element that paints as one: a context, or
    a positioned element without a z-index, whose own contexts belong to the context around it.
    """

    __slots__ = ("context", "group", "none", "opacity", "pointer", "row", "shut", "tag", "visibility")

    def __init__(self, tag, none=False, visibility="visible", opacity=1.0, pointer=True, context=(), group=(), shut=False, row=None):
        self.tag, self.none, self.visibility, self.opacity, self.pointer = tag, none, visibility, opacity, pointer
        self.context, self.group, self.shut, self.row = context, group, shut, row


class Scan(HTMLParser):
    """``found``: a list a candidate, of the columns that sources.pages.scan_html names, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.n = [Node("")], 0
        self.found, self.keys = [], []
        self.fieldsets = []  # [disabled, has had a legend, inside its first legend] of each open one

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        while self.path[-1].tag in ENDS.get(tag, ()):
            self.path.pop()
        node, key = self._node(tag, a, self.path[-1])
        if tag == "fieldset":
            self.fieldsets.append(["disabled" in a, False, False])
        elif tag == "legend" and self.fieldsets and not self.fieldsets[-1][1]:
            self.fieldsets[-1][1:] = [True, True]
        if tag in TAGS or (tag == "a" and "href" in a) or (a.get("role") or "").lower() in ROLES:
            row = [tag.upper(), a.get("role"), a.get("type"), a.get("id"), a.get("name"), a.get("autocomplete"), a.get("aria-label"), a.get("placeholder"), a.get("alt"), "", "href" in a, "hidden" in a, "disabled" in a, a.get("aria-disabled"), *(self.fieldsets[-1][::2] if self.fieldsets else (None, None))]
            row += ["none" if node.none else None, node.visibility, node.opacity, "readonly" in a, (a.get("contenteditable") or "inherit").lower()]
            self.found.append(row)
            self.keys.append(key)
            node.row = row
        if tag not in VOID:
            self.path.append(node)

    def _node(self, tag, a, parent) -> tuple[Node, tuple | None]:
        """The node of a start tag, and its place in paint order if a pointer can hit it."""
        self.n += 1
        style = style_of(a["style"]) if a.get("style") else {}
        shown = style.get("display")
        shut = parent.shut and not (tag == "summary" and parent.shut == "first")
        if tag == "summary" and parent.shut == "first":
            parent.shut = "rest"
        usual = tag in NEVER or "hidden" in a or (tag == "dialog" and "open" not in a) or (tag == "input" and (a.get("type") or "").lower() == "hidden")
        none = parent.none or bool(shut) or shown == "none" or (usual and shown is None)
        seen = style.get("visibility")
        seen = "visible" if seen == "initial" else seen if seen in ("visible", "hidden", "collapse") else parent.visibility
        own = _number(style.get("opacity"))
        own = 1.0 if own is None else min(max(own, 0.0), 1.0)
        events = style.get("pointer-events")
        pointer = parent.pointer if events in (None, "inherit") else events != "none"
        node = Node(tag, none, seen, parent.opacity * own, pointer, shut="first" if tag == "details" and "open" not in a else False)
        key = self._place(node, parent, style, own)
        return node, key if pointer and not none and seen == "visible" else None

    def _place(self, node, parent, style, opacity) -> tuple:
        """The node's place in paint order. Of a context, in this order: itself, contexts of negative z-index, what is not positioned, positioned
        elements and contexts without a z-index or with 0, contexts of positive z-index; equals in document order."""
        position, z = style.get("position", "static"), _integer(style.get("z-index"))
        placed = position in ("relative", "absolute", "fixed", "sticky")
        whole = opacity < 1 or any(style.get(p, "none") != "none" for p in ("transform", "filter", "perspective")) or style.get("isolation") == "isolate"
        makes = whole or position in ("fixed", "sticky") or (placed and z is not None)
        if makes or placed:
            z = z or 0 if placed else 0
            node.group = (*parent.context, (1 if z < 0 else 4 if z == 0 else 5, z, self.n))
            node.context = node.group if makes else parent.context
            return (*node.group, (0, 0, self.n))
        node.group, node.context = parent.group, parent.context
        return (*node.group, (3, 0, self.n))

    def handle_endtag(self, tag):
        if tag == "fieldset" and self.fieldsets:
            self.fieldsets.pop()
        elif tag == "legend" and self.fieldsets:
            self.fieldsets[-1][2] = False
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i].tag == tag:
                del self.path[i:]
                break

    def handle_data(self, data):
        for node in self.path:
            if node.row is not None:
                node.row[9] += data


#: An ampersand that begins no character reference with a semicolon.
_LOOSE = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


def scan(html: str | None, strict: bool = False) -> list[list]:
    """Candidates of a page, each with its place in paint order at the end; null for those that no pointer can hit.

    Browsers read some character references without their semicolon, too. ``strict`` leaves those as they are written.
    """
    page = Scan()
    page.feed(_LOOSE.sub("&amp;", html or "") if strict else html or "")
    page.close()
    order = {k: i for i, k in enumerate(sorted(k for k in page.keys if k is not None))}
    return [[*row, order.get(key)] for row, key in zip(page.found, page.keys, strict=True)]
