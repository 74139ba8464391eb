"""HTML extraction by layout-aware rendering: a tree of elements is built, and all of its visible text is written as a reader would see it.

Building: end tags that HTML lets authors leave out are implied, an end tag without its start is ignored, rows and cells outside a table are
plain blocks, and what is left open ends with the page. Visibility: elements that are never shown, `hidden`, `display: none` and `visibility: hidden` in attributes or in simple
rules (a tag, classes and ids of one element) of the page's own style sheets that hold for a screen of 1280 pixels, by weight, specificity and order. Layout: blocks begin lines, paragraphs and their like stand between blank lines, list items have
bullets or numbers and are indented, table cells are padded to columns of up to WIDEST characters (a colspan counts up to 1000 columns in which some cell begins; one of more than four digits is no number), indentation ends at DEEPEST columns, preformatted text keeps its white space.

Nothing that is visible is dropped: menus, asides and footers are text like any other.

Defined results: null or empty html gives empty text; text that is not HTML is itself, white space collapsed; repeated rows are each rendered; other columns are ignored
unless named in `keep`. Nesting of any depth is rendered without recursion.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import append_columns, free_name, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*+>|[^>]*+(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_DISPLAY = re.compile(r"none|(?:block|inline|flow|flow-root|flex|grid|table|ruby|list-item|contents|inherit|initial|unset|revert|inline-[a-z]+|table-[a-z-]+|ruby-[a-z-]+|revert-layer|-webkit-[a-z-]+)(?:\s+[a-z-]+)*")
#: Indentation grows up to so many columns, and cells are padded up to so many, so that no nesting and no long cell makes text out of nothing.
DEEPEST, WIDEST = 40, 60
#: The width of the screen that media queries are asked of.
WIDTH = 1280
_SPACE = re.compile(r"[ \t\n\r\f]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
_NEVER = frozenset("head script style template noscript iframe object embed noembed noframes title meta link canvas audio video datalist".split())
#: What drawings and formulas hold but do not show, and the attribute that marks it.
_UNDRAWN = {"svg": frozenset("defs desc metadata symbol clippath mask pattern marker".split()), "math": frozenset(("annotation", "annotation-xml"))}
_UNDRAWN_MARK = "<undrawn"
_MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset menu".split())
_BLOCK = _MARGIN | frozenset("html body div section article aside nav header footer main address li dt dd tr caption form figcaption details summary legend center thead tbody tfoot hgroup search dialog option optgroup".split())
_CELLS = frozenset(("td", "th"))
_ROWS = frozenset(("thead", "tbody", "tfoot", "tr"))
#: A start tag ends the nearest of the first set that is open, looking no further up than the second.
_IMPLIED = {
    **{t: (frozenset(("p",)), frozenset(("table", "td", "th", "caption", "button", "object", "template"))) for t in _BLOCK - {"html", "body", "tr", "caption", "thead", "tbody", "tfoot", "option", "optgroup", "li", "dt", "dd"}},
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "td": (_CELLS, frozenset(("table", "tr"))),
    "th": (_CELLS, frozenset(("table", "tr"))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("optgroup",)), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset()),
}
#: An end tag looks no further up than these for its start, unless it names one of them.
_SCOPE = frozenset(("table", "td", "th", "caption"))


class Element:
    """A tag, its attributes, and text and elements in order."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(html: str) -> tuple[Element, list[str]]:
    """The tree of a page, and the texts of its style sheets."""
    root = Element("#root", {})
    stack, styles, at = [root], [], 0
    places: dict[str, list[int]] = {}  # where on the stack each tag is open, so that no search walks over the stack

    def push(element: Element) -> None:
        places.setdefault(element.tag, []).append(len(stack))
        stack.append(element)

    def pop() -> None:
        places[stack.pop().tag].pop()

    def nearest(names: frozenset[str] | set[str]) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    def text(part: str, raw: bool = False) -> None:
        if part:
            if stack[-1].tag == "head" and part.strip():
                pop()
            stack[-1].children.append(part if raw else unescape(part))

    def end(names: frozenset[str] | set[str], until: frozenset[str]) -> bool:
        at = nearest(names)
        if not at or at < nearest(until):
            return False
        while len(stack) > at:
            pop()
        return True

    def start(tag: str, attrs: dict[str, str]) -> Element:
        made = Element(tag, attrs)
        stack[-1].children.append(made)
        return made

    while found := _TAG.search(html, at):
        text(html[at : found.start()])
        at = found.end()
        if found["cdata"]:
            text(found["cdata"], raw=True)
        if not found["name"]:
            continue
        tag = found["name"].lower()
        if found["end"]:
            if tag == "br":
                start("br", {})
            elif tag == "p" and not end({"p"}, _SCOPE):
                start("p", {})
            elif tag != "p":
                end({tag}, frozenset() if tag in _SCOPE or tag in _ROWS else _SCOPE)
            continue
        rest = found["rest"]
        attrs = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(rest)} if len(rest) > 2 else {}
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag in _IMPLIED:
            end(*_IMPLIED[tag])
            if tag in ("thead", "tbody", "tfoot", "tr"):
                end(_CELLS, frozenset(("table",)))
                if tag != "tr":
                    end(frozenset(("tr",)), frozenset(("table",)))
        if tag in _CELLS and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push(start("tr", {}))
        if stack[-1].tag == "head" and tag not in _NEVER | {"base", "basefont", "bgsound"}:
            pop()
        if any(tag in names and places.get(of) for of, names in _UNDRAWN.items()):
            attrs[_UNDRAWN_MARK] = ""
        made = start(tag, attrs)
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            inner = html[at : close.start() if close else len(html)]
            at = close.end() if close else len(html)
            made.children.append(unescape(inner) if tag in ("textarea", "title") else inner)
            if tag == "style":
                styles.append(inner)
        elif tag not in _VOID and not (rest.endswith("/>") and (tag in _UNDRAWN or any(places.get(t) for t in _UNDRAWN))):
            push(made)  # outside drawings and formulas, HTML ignores the slash of an element that may have content
            if tag == "pre" and html.startswith("\n", at):
                at += 1
    text(html[at:])
    return root, styles


def _holds(query: str) -> bool:
    """Whether a media query holds for a screen of WIDTH pixels. A feature not known here does not hold."""
    words = query.strip().lower().removeprefix("only ")
    turned = words.startswith("not ")
    for part in re.split(r"\s+and\s+|\s+and(?=\()", words.removeprefix("not ").strip()):
        width = re.fullmatch(r"\(\s*(min|max)-width\s*:\s*([\d.]+)(px|em|rem)\s*\)", part.strip())
        if width:
            limit = float(width[2]) * (1 if width[3] == "px" else 16)
            held = WIDTH >= limit if width[1] == "min" else WIDTH <= limit
        else:
            held = part.strip() in ("", "all", "screen") or re.fullmatch(r"\(\s*(orientation\s*:\s*landscape|prefers-color-scheme\s*:\s*light)\s*\)", part.strip()) is not None
        if not held:
            return turned
    return not turned


def _rules(style: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of a style sheet that hold for a screen, in order."""
    style, out, at, depth = re.sub(r"/\*.*?(?:\*/|\Z)", "", style, flags=re.S), [], 0, []
    skip = 0  # open blocks from the first on that does not hold
    for found in re.finditer(r"[{};]", style):
        said, at = style[at : found.start()].strip(), found.end()
        if found[0] == ";":
            if depth and depth[-1] is not None:
                depth[-1][1].append(said)
        elif found[0] == "{":
            name = re.match(r"@([\w-]+)(.*)", said, re.S)
            if skip:
                skip += 1
            elif name and name[1].lower() == "media":
                skip = 0 if any(map(_holds, name[2].split(","))) else 1
            elif name and not (name[1].lower() == "layer" or name[1].lower() == "supports" and not name[2].strip().lower().startswith("not")):
                skip = 1
            depth.append(None if name or skip else (said, []))
        elif depth:
            rule = depth.pop()
            if rule is not None:
                out.append((rule[0], ";".join([*rule[1], said])))
            skip = max(0, skip - 1)
    return out


def _declared(style: str) -> dict[str, tuple[bool, str]]:
    """What declarations say of display (none or shown) and of visibility (hidden or shown), and whether it is important; the last of equal weight wins."""
    said: dict[str, tuple[bool, str]] = {}
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        name, important = name.strip(), "!" in value
        value = value.partition("!")[0].strip()
        if name == "display" and _DISPLAY.fullmatch(value):
            state = "none" if value == "none" else "shown"
        elif name == "visibility" and value in ("hidden", "collapse", "visible", "initial"):
            state = "hidden" if value in ("hidden", "collapse") else "shown"
        else:
            continue
        if important or not said.get(name, (False, ""))[0]:
            said[name] = important, state
    return said


def _hiding(styles: list[str]) -> dict[str, list[tuple]]:
    """By tag, .class or #id: (all that an element must have, specificity, place, declarations) of the rules that speak of display or visibility."""
    rules: dict[str, list[tuple]] = {}
    if not any("none" in style or "hidden" in style or "collapse" in style for style in styles):
        return rules
    for place, (selectors, body) in enumerate(rule for style in styles for rule in _rules(style)):
        said = _declared(body)
        for selector in selectors.split(",") if said else ():
            selector = selector.strip()
            if re.fullmatch(r"(?:\*|[a-zA-Z][\w-]*)?(?:[.#][\w-]+)*", selector) and selector:
                parts = [x if x[0] in ".#" else x.lower() for x in re.findall(r"[.#]?[\w-]+|\*", selector)]
                rank = (0, sum(x[0] == "#" for x in parts), sum(x[0] == "." for x in parts), sum(x[0] not in ".#*" for x in parts))
                rules.setdefault(parts[-1], []).append((frozenset(parts), rank, place, said))
    return rules


def _state(e: Element, rules) -> str:
    """none (with all it holds), hidden (unless shown within), shown, or nothing said: of the declarations, the important, the specific and the last win."""
    attrs = e.attrs
    if e.tag in _NEVER or _UNDRAWN_MARK in attrs or e.tag == "input" and attrs.get("type", "").lower() == "hidden":
        return "none"
    display = "none" if "hidden" in attrs or e.tag == "dialog" and "open" not in attrs else ""
    if not rules and "style" not in attrs:
        return display
    won: dict[str, tuple] = {}
    own = {"*", e.tag, "#" + attrs.get("id", ""), *("." + c for c in attrs.get("class", "").split())}
    said = [(rank, place, what) for name in own if name in rules for needs, rank, place, what in rules[name] if needs <= own]
    if "style" in attrs:
        said.append(((1, 0, 0, 0), 0, _declared(attrs["style"])))
    for rank, place, what in said:
        for name, (important, state) in what.items():
            won[name] = max(won.get(name, ()), (important, rank, place, state))
    return "none" if (won["display"][3] if "display" in won else display) == "none" else won["visibility"][3] if "visibility" in won else ""


class _Page:
    """Lines written so far. Blank lines and spaces wait until text follows."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.lines = 0  # line ends that wait
        self.space = False
        self.indent = ""
        self.mark = ""  # of a list item whose text has not begun

    def block(self, lines: int) -> None:
        self.lines = max(self.lines, lines)
        self.space = False

    def write(self, text: str, kept: bool = False) -> None:
        if not kept:
            flat = _SPACE.sub(" ", text)
            if flat in ("", " "):
                self.space = self.space or flat == " "
                return
            if flat[0] == " ":
                self.space, flat = True, flat[1:]
            trailing = flat.endswith(" ")
            flat = flat.rstrip(" ")
        else:
            flat, trailing = text, False
        if self.lines or not self.parts:
            self.parts.append(("\n" * self.lines if self.parts else "") + (self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent))
            self.lines, self.mark = 0, ""
        elif self.space:
            self.parts.append(" ")
        self.parts.append(flat.replace("\n", "\n" + self.indent) if kept else flat)
        self.space = trailing

    def text(self) -> str:
        return "".join(self.parts)


def _write(root: Element, rules, flat: bool = False) -> str:
    """The visible text below root; with `flat`, as one line. Tables below it are rendered by calls of their own, deepest first."""
    page = _Page()
    # What is to be done, last first: an element or text with what it inherits, or a call that ends an element.
    todo: list = [(child, False, False, ()) for child in reversed(root.children)]
    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        node, hidden, pre, lists = item
        if isinstance(node, str):
            if not hidden:
                page.write(node, kept=pre)
            continue
        state = _state(node, rules)
        if state == "none":
            continue
        hidden = state == "hidden" or hidden and state != "shown"
        tag = node.tag
        if tag == "br":
            if not hidden:
                page.lines += 1
                page.space = False
            continue
        if tag == "img" and node.attrs.get("alt") and not hidden:
            page.write(node.attrs["alt"])
            continue
        if tag == "table" and not flat:
            page.block(2)
            for line in _rows(node, rules, hidden):
                page.write(line, kept=True)
                page.block(1)
            page.block(2)
            continue
        if tag == "text" or tag in _CELLS and flat:
            page.space = True
        spacing = 2 if tag in _MARGIN else 1 if tag in _BLOCK else 0
        if spacing:
            page.block(spacing if not (tag in ("ul", "ol") and lists) else 1)
        after = []
        inner = lists
        if tag in ("ul", "ol", "menu"):
            start = node.attrs.get("start", "1")
            inner = ([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1],)
        elif tag == "li" and not hidden:
            of = lists[-1] if lists else ["ul", 1]
            mark = f"{of[1]}. " if of[0] == "ol" else "- "
            of[1] += 1
            old = page.indent
            page.indent, page.mark = (old + " " * len(mark))[: max(DEEPEST, len(mark))], mark

            def leave(old=old) -> None:
                page.indent, page.mark = old, ""

            after.append(leave)
        elif tag in ("dd", "blockquote"):
            old = page.indent
            page.indent = (old + "  ")[:DEEPEST]
            after.append(lambda old=old: setattr(page, "indent", old))
        if spacing:
            after.append(lambda n=spacing if not (tag in ("ul", "ol") and lists) else 1: page.block(n))
        todo += reversed(after)
        todo += [(child, hidden, pre or tag == "pre", inner) for child in reversed(node.children)]
    out = page.text()
    return _SPACE.sub(" ", out).strip() if flat else out


def _rows(root: Element, rules, hidden: bool) -> list[str]:
    """A table's caption and rows as lines, cells padded to columns. A table within a cell is part of its line."""
    rows: list[list[tuple[str, int]]] = []
    lines: list[str] = []
    todo: list = [(c, hidden) for c in reversed(root.children)]
    while todo:
        node, covered = todo.pop()
        if isinstance(node, str):
            if node.strip() and not covered:
                lines.append(_SPACE.sub(" ", node).strip())
            continue
        state = _state(node, rules)
        if state == "none":
            continue
        covered = state == "hidden" or covered and state != "shown"
        if node.tag == "tr":
            cells = []
            for cell in node.children:
                if isinstance(cell, str):
                    shown, span = ("" if covered else _SPACE.sub(" ", cell).strip()), 1
                    if not shown:
                        continue
                else:
                    said = _state(cell, rules)
                    if said == "none":
                        continue
                    out_of_sight = said == "hidden" or covered and said != "shown"
                    holder = Element("#cell", {"style": "visibility:hidden"} if out_of_sight else {})
                    holder.children = cell.children if cell.tag in _CELLS else [cell]
                    shell = Element("#cell", {})
                    shell.children = [holder]
                    shown = _write(shell, rules, flat=True)
                    wide = cell.attrs.get("colspan", "1")
                    span = min(int(wide), 1000) if re.fullmatch(r"[0-9]{1,4}", wide) and cell.tag in _CELLS else 1
                cells.append((shown, max(1, span)))
            rows.append(cells)
        elif node.tag in _ROWS or node.tag in ("colgroup", "col"):
            todo += [(c, covered) for c in reversed(node.children)]
        else:
            holder = Element("#cell", {"style": "visibility:hidden"} if covered else {})
            holder.children = [node]
            shell = Element("#cell", {})
            shell.children = [holder]
            if shown := _write(shell, rules, flat=True):
                lines.append(shown)
    # Columns are the places where a cell of some row begins; what a cell spans beyond those has no width.
    begins = []
    for cells in rows:
        column = 0
        for _, span in cells:
            begins.append(column)
            column += span
    begins = sorted(set(begins))
    widths = [0] * len(begins)
    placed = []
    for cells in rows:
        column, line = 0, []
        for shown, span in cells:
            first, end = bisect_left(begins, column), bisect_left(begins, column + span)
            line.append((shown, first, end))
            if end - first <= 1:
                widths[first] = max(widths[first], min(len(shown), WIDEST))
            column += span
        placed.append(line)
    for cells in placed:
        parts = [shown.ljust(min(sum(widths[first:end]) + 2 * (end - first - 1), 4 * WIDEST)) for shown, first, end in cells]
        if line := "  ".join(parts).rstrip():
            lines.append(line)
    return lines


def render(html: str | None) -> str:
    """All visible text of a page."""
    if not html:
        return ""
    root, styles = parse(html)
    return "\n".join(line.rstrip() for line in _write(root, _hiding(styles)).split("\n"))


_RENDERED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_lines", T.LongType())])


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """Columns `keep` of pages with the visible text, its length and number of lines. No shuffle."""

    name = free_name("_html", keep, _RENDERED.names)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [render(h) for h in batch.column(batch.schema.get_field_index(name)).to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())]

    return append_columns(pages.select(*[F.col(k) for k in keep], F.col(html_col).alias(name)), keep, _RENDERED, run)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract(table(spark, sf_dir, "pages"), ["page_id"])
