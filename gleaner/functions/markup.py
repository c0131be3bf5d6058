"""A small page tree for the extraction jobs: parse, select, read, write.

Runs inside Spark tasks, one page at a time. It is no general HTML library: it
knows what the site rules need and treats sloppy pages the way browsers do
(implied end tags, head elements in the head, raw script text).
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_TEXT = frozenset("title textarea".split())
IN_HEAD = frozenset("base link meta script style title noscript template".split())
KEEPS_SPACES = frozenset("pre plaintext title textarea".split())
CLOSES_P = frozenset(
    "address article aside blockquote center dd details dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
SCOPE = frozenset("html body table td th caption button object template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag, the open elements it ends, and where the search for them stops.
IMPLIED = {
    "li": ({"li"}, SCOPE | {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, SCOPE | {"dl"}),
    "dd": ({"dt", "dd"}, SCOPE | {"dl"}),
    "a": ({"a"}, SCOPE),
    "option": ({"option"}, SCOPE | {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
TABLE_PARTS = frozenset("tbody thead tfoot".split())
TABLE_TAGS = TABLE_PARTS | {"table", "tr", "td", "th", "caption"}
# Elements whose start separates words in the text of a page. The set and its order are, as far as known, the block elements of the
# jsoup library (MIT licence), whose texts these must agree with; the HTML standard counts fewer.
BLOCK = frozenset(
    "html head body frameset script noscript style meta link title frame noframes section nav aside hgroup header "
    "footer p h1 h2 h3 h4 h5 h6 ul ol pre div blockquote hr address figure figcaption form fieldset ins del dl dt "
    "dd li table caption thead tfoot tbody colgroup col tr th td video audio canvas details menu plaintext "
    "template article main svg math br".split()
)
SCHEMES = frozenset("http https ftp file jar mailto".split())

# A tag or quote left open runs to the end of the page, so a scan never starts over.
TOKEN = re.compile(
    r"<(?:!--(?:.*?-->|.*)|[!?][^>]*+(?:>|\Z)|/([A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|([A-Za-z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))?)?")
BLANKS = "".join(map(chr, range(33)))


class Element:
    """An element; text children are plain strings as written in the page."""

    __slots__ = ("tag", "written", "_attributes", "children", "parent")

    def __init__(self, tag: str, written: str = "", parent: "Element | None" = None):
        self.tag, self.written, self.parent = tag, written, parent
        self._attributes: dict[str, str | None] | None = None
        self.children: list[Element | str] = []
        if parent is not None:
            parent.children.append(self)

    @property
    def attributes(self) -> dict[str, str | None]:
        """Attributes by lower-case name; None for a name written without a value."""
        if self._attributes is None:
            self._attributes = {}
            for name, valued, double, single, bare in ATTRIBUTE.findall(self.written):
                self._attributes.setdefault(name.lower(), unescape(double or single or bare) if valued else None)
        return self._attributes

    def get(self, name: str) -> str | None:
        """An attribute's value, ``''`` when it has none, None when it is absent."""
        found = self.attributes.get(name, self)
        return None if found is self else found or ""

    def walk(self):
        """This element and all below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(child for child in reversed(node.children) if type(child) is Element)


def parse(page: str) -> Element:
    """The tree of a page; its root holds one ``html`` element with head and body."""
    root = Element("#root")
    html = Element("html", "", root)
    head, body = Element("head", "", html), Element("body", "", html)
    stack, in_body, at = [html, body], False, 0
    # How many of each tag are open, so that a deep page is not searched in vain.
    is_open: defaultdict[str, int] = defaultdict(int)

    def close(tags: set[str], stop: set[str] | frozenset[str]) -> None:
        for tag in tags:
            if is_open[tag]:
                break
        else:
            return
        for depth in range(len(stack) - 1, 1, -1):
            if stack[depth].tag in tags:
                for node in stack[depth:]:
                    is_open[node.tag] -= 1
                del stack[depth:]
                return
            if stack[depth].tag in stop:
                return

    while at < len(page):
        token = TOKEN.search(page, at)
        start = token.start() if token else len(page)
        if start > at:
            text = page[at:start]
            if not in_body:
                in_body = not text.isspace()
            if in_body:
                stack[-1].children.append(text)
        if not token:
            break
        at = token.end()
        ended, tag, written = token.group(1), token.group(2), token.group(3)
        if ended:
            close({ended.lower()}, {"table"} if ended.lower() in TABLE_TAGS else SCOPE)
            continue
        if not tag or page[at - 1] != ">":
            continue
        tag = tag.lower()
        if tag in ("html", "head", "body"):
            target = {"html": html, "body": body}.get(tag)
            if target is not None and not target.written:
                target.written, target._attributes = written, None
            in_body = in_body or tag == "body"
            continue
        if not in_body and tag in IN_HEAD:
            parent = head
        else:
            in_body = True
            if tag in CLOSES_P:
                close({"p"}, SCOPE)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                is_open[stack.pop().tag] -= 1
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag == "tr" and stack[-1].tag == "table":
                stack.append(Element("tbody", "", stack[-1]))
                is_open["tbody"] += 1
            if tag in ("td", "th") and stack[-1].tag in TABLE_PARTS:
                stack.append(Element("tr", "", stack[-1]))
                is_open["tr"] += 1
            parent = stack[-1]
        closed = written.endswith("/") and not re.search(r"=[^\s\"']*/$", written)
        node = Element(tag, written[:-1] if closed else written, parent)
        if tag in RAW or tag in RAW_TEXT:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not closed and parent is not head:
            stack.append(node)
            is_open[tag] += 1
    return root


def _single_spaces(text: str) -> str:
    for blank in "\t\n\f\r":
        if blank in text:
            text = text.replace(blank, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def text_of(element: Element) -> str:
    """The words of an element with single spaces; a block start separates words."""
    parts: list[str] = []
    last = ""
    todo: list[tuple[Element | str, bool, bool]] = [(element, False, False)]
    while todo:
        node, keep, keep_below = todo.pop()
        if type(node) is str:
            words = unescape(node) if "&" in node else node
            if not keep:
                words = _single_spaces(words)
                if last and last in " \t\n\f\r" and words[:1] == " ":
                    words = words[1:]
            if words:
                parts.append(words)
                last = words[-1]
            continue
        if last and node.tag in BLOCK and last not in " \t\n\f\r":
            parts.append(" ")
            last = " "
        if node.tag not in RAW:
            keeps = node.tag in KEEPS_SPACES
            todo.extend((child, keeps or keep_below, keeps) for child in reversed(node.children))
    return "".join(parts).strip(BLANKS)


def base_url(tree: Element, page_url: str) -> str:
    """What a page's references are relative to: its ``base`` element, if it has one, else its own URL."""
    head = tree.children[0].children[0]
    for node in head.children:
        if type(node) is Element and node.tag == "base" and node.get("href"):
            return resolve(page_url, node.get("href")) or page_url
    return page_url


def text_of_all(elements: list[Element]) -> str:
    """The texts of several elements; each but those before any text follows a space."""
    parts: list[str] = []
    for element in elements:
        if parts:
            parts.append(" ")
        words = text_of(element)
        if words:
            parts.append(words)
    return "".join(parts)


def _escape(text: str, marks: str) -> str:
    for mark, written in (("&", "&amp;"), ("\xa0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        if mark in marks and mark in text:
            text = text.replace(mark, written)
    return text


def inner_html(element: Element) -> str:
    """The markup between an element's tags."""
    parts: list[str] = []
    # Children still to write; a tuple holds an end tag.
    todo: list[Element | str | tuple[str]] = list(reversed(element.children))
    raw = element.tag in RAW
    while todo:
        node = todo.pop()
        if type(node) is str:
            parts.append(node if raw else _escape(unescape(node) if "&" in node else node, "&\xa0<>"))
            continue
        if type(node) is tuple:
            parts.append(node[0])
            continue
        written = "".join(
            f" {name}" if value is None else f' {name}="{_escape(value, "&" + chr(160) + chr(34))}"'
            for name, value in node.attributes.items()
        )
        parts.append(f"<{node.tag}{written}>")
        if node.tag in RAW:
            parts.extend(str(child) for child in node.children)
            parts.append(f"</{node.tag}>")
        elif node.tag not in VOID:
            todo.append((f"</{node.tag}>",))
            todo.extend(reversed(node.children))
    return "".join(parts)


def outer_html(element: Element) -> str:
    """An element's markup with its own tags."""
    holder = Element("#holder")
    holder.children.append(element)
    return inner_html(holder)


SIMPLE = re.compile(
    r"#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<name>[^\s\]=^$*!~]+)\s*(?:(?P<op>[\^$*!]?=)\s*(?P<value>[^\]]*))?\]"
    r"|(?P<tag>\*|[A-Za-z][\w-]*)"
)
COMBINATOR = re.compile(r"\s*>\s*|\s+")
_selectors: dict[str, list] = {}


def selector(text: str) -> list:
    """A selector as alternatives, each a list of (combinator, tests) read from the left."""
    if text not in _selectors:
        if len(_selectors) > 10000:
            _selectors.clear()
        _selectors[text] = [_chain(part.strip()) for part in re.split(r",(?![^\[]*\])", text)]
    return _selectors[text]


def _chain(text: str) -> list:
    chain, joiner, tests, at = [], " ", [], 0
    while at < len(text):
        found = SIMPLE.match(text, at)
        if found:
            tests.append(found.groupdict())
        else:
            found = COMBINATOR.match(text, at)
            if not found or not tests:
                raise ValueError(f"selector not understood: {text}")
            chain.append((joiner, tests))
            joiner, tests = found.group().strip() or " ", []
        at = found.end()
    if not tests:
        raise ValueError(f"selector not understood: {text}")
    return chain + [(joiner, tests)]


def _fits(node: Element, tests: list) -> bool:
    for test in tests:
        if test["tag"]:
            good = test["tag"] == "*" or node.tag == test["tag"].lower()
        elif test["id"]:
            good = node.get("id") == test["id"]
        elif test["cls"]:
            good = test["cls"].lower() in (node.get("class") or "").lower().split()
        else:
            have = node.get(test["name"].lower())
            if test["op"] is None:
                good = have is not None
            else:
                want, value = test["value"].strip().strip("\"'").strip().lower(), (have or "").strip().lower()
                good = test["op"] == "!=" and value != want or have is not None and (
                    test["op"] == "=" and value == want
                    or test["op"] == "^=" and value.startswith(want)
                    or test["op"] == "$=" and value.endswith(want)
                    or test["op"] == "*=" and want in value
                )
        if not good:
            return False
    return True


def _reached(node: Element, chain: list, above: tuple[int, int]) -> tuple[int, int]:
    """Which steps of a chain end in this node, and which in it or an ancestor, as bits.

    ``above`` is the same of its parent: a step needs the one before it in the
    parent, or anywhere above, so each node is looked at once.
    """
    own, ends, within = 0, *above
    for step, (joiner, tests) in enumerate(chain):
        before = ends if joiner == ">" else within
        if (step == 0 or before >> (step - 1) & 1) and _fits(node, tests):
            own |= 1 << step
    return own, within | own


def select(top: Element, text: str) -> list[Element]:
    """The elements a selector finds in ``top``, itself included, in document order."""
    chains = [(chain, 1 << len(chain) - 1) for chain in selector(text)]
    none = [(0, 0)] * len(chains)
    found, states = [], {}
    for node in top.walk():
        above = none if node is top else states.get(id(node.parent), none)
        state = states[id(node)] = [_reached(node, chain, own) for (chain, _), own in zip(chains, above)]
        if any(own & last for (own, _), (_, last) in zip(state, chains)):
            found.append(node)
    return found


def _flatten(path: str) -> str:
    """A path without its dot segments; a leading ``..`` that leads nowhere stays."""
    kept: list[str] = []
    parts = path.split("/")
    for place, part in enumerate(parts):
        if part == "." or part == ".." and len(kept) > 1 and kept[-1] != "..":
            if part == "..":
                kept.pop()
            if place == len(parts) - 1:
                kept.append("")
        else:
            kept.append(part)
    return "/".join(kept)


PARTS = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", re.S)
SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):")


def resolve(page_url: str, ref: str | None) -> str:
    """A reference of a page as an absolute URL; ``''`` when it is absent or of an unknown scheme."""
    if ref is None:
        return ""
    ref = ref.strip(BLANKS)
    scheme = SCHEME.match(ref)
    if scheme:
        if scheme.group(1).lower() not in SCHEMES:
            return ""
        parts = PARTS.match(ref) if "/." in ref else None
        if not parts:
            return ref
        return f"{parts[1]}://{parts[2]}{_flatten(parts[3])}{parts[4] or ''}{parts[5] or ''}"
    base = PARTS.match(page_url)
    if not base:
        return ""
    origin, path, query = f"{base[1]}://{base[2]}", base[3], base[4] or ""
    if ref == "" or ref[0] == "#":
        return f"{origin}{path}{query}{ref}"
    if ref[0] == "?":
        return f"{origin}{path or '/'}{ref}"
    if ref[:2] == "//":
        return resolve(page_url, f"{base[1]}:{ref}")
    found = re.match(r"([^?#]*)(.*)", ref, re.S)
    target = found[1] if ref[0] == "/" else (path.rpartition("/")[0] + "/" + found[1])
    return f"{origin}{_flatten(target) if '/.' in target else target}{found[2]}"
