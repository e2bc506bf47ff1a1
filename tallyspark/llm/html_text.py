"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a renderer of the visible text.

The builder reads tags with one scanner, closes elements whose end tags HTML lets authors leave out, and opens what tags imply. The renderer
walks the tree: hidden elements are left out, white space collapses as on screen, blocks begin on lines of their own, paragraphs and the
like are set off by an empty line, list items get their markers and indents, and table cells are aligned in columns.

Scripts are taken as on (noscript is hidden). Visibility comes from attributes (hidden, style) and from the elements' names; rules in style sheets are not read. Elements may
nest to any depth; only layout stops: within NESTED quotations, lists and tables, further ones are neither indented nor aligned, but keep their lines and markers. Columns are
as wide as their widest cell, unless spaces would then be more than PADDING times a table's text: such columns are as wide as a less wide cell. Cells over several columns widen none.

Edge cases: null and empty html give an empty text; unclosed tags, comments and quotes reach to the end, stray end tags are ignored; pages of any length are
rendered whole; every input row gives one output row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

NESTED = 40
PADDING, PADDING_FREE = 16, 4096

# Element names by the role that HTML gives them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title plaintext".split())
DECODED = frozenset("textarea title".split())
HIDDEN = frozenset("area audio base canvas col colgroup datalist embed head iframe link meta noembed noframes noscript object param rp script source style template title track video".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp plaintext listing".split())
SPACED = frozenset("blockquote dir dl fieldset figure h1 h2 h3 h4 h5 h6 hr listing menu ol p plaintext pre table ul xmp".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes the nearest open element of the first set, unless one of the second stands between.
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())), "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())), "optgroup": (frozenset(["option", "optgroup"]), frozenset("select".split())),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset("table tr".split())), "th": (frozenset(["td", "th"]), frozenset("table tr".split())),
    "tbody": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])), "thead": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])), "tfoot": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])), "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
SCOPE = frozenset("html table td th caption template object".split())
BULLETS = ("*", "o", "-")

#: A quote opens a value right after = only; elsewhere it belongs to a name or an unquoted value.
ATTRIBUTES = r"""(?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\r\f>"'][^ \t\n\r\f>]*+|))?+)*+"""
TAG = re.compile(rf"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^ \t\n\r\f/>]*+){ATTRIBUTES}(?:>|\Z)|([a-zA-Z][^ \t\n\r\f/>]*+)({ATTRIBUTES})(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)"?|'([^']*+)'?|([^ \t\n\r\f>"'][^ \t\n\r\f>]*+)|))?+""")
TAG_REST = re.compile(rf"{ATTRIBUTES}(?:>|\Z)")
STYLE = re.compile(r"(?:^|[;{])\s*(display|visibility|content-visibility)\s*:\s*([a-z-]+)[^;]*?(!\s*important)?\s*(?=;|\Z)")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def build(source: str) -> Node:
    """The tree of a page: elements as Node, texts as str."""
    root = Node("html", {})
    open_, at, n = [root], 0, len(source)
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements but the root, by tag
    body = False

    def add(text: str, decode: bool = True) -> None:
        nonlocal body
        if text:
            if not body and len(open_) <= 2 and open_[-1].tag in ("html", "head"):
                if not text.strip(" \t\n\r\f"):
                    return
                into_body()
            put(html.unescape(text) if decode and "&" in text else text)

    def put(child: Node | str) -> None:
        open_[-1].children.append(child)

    def into_body() -> None:
        nonlocal body
        body = True
        cut(1)
        push("body", {})

    def cut(i: int) -> None:
        """Close all open elements from the i-th on."""
        for node in open_[i:]:
            places[node.tag].pop()
        del open_[i:]

    def push(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        open_[-1].children.append(node)
        places[tag].append(len(open_))
        open_.append(node)

    def close(tags: frozenset[str], stop: frozenset[str]) -> bool:
        last = lambda names: max((places[t][-1] for t in names if places.get(t)), default=0)
        i = last(tags)
        if i and i >= last(stop):
            cut(i)
            return True
        return False

    while at < n:
        m = TAG.search(source, at)
        if m is None:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        end, tag = m[1], m[2]
        if end is not None:
            end = end.lower()
            if end == "br":
                put(Node("br", {}))
            elif end == "p":
                if not close(frozenset(["p"]), SCOPE):
                    put(Node("p", {}))
            elif end in HEADINGS:
                close(HEADINGS, SCOPE)
            elif end == "head":
                close(frozenset(["head"]), frozenset())
            elif end not in ("html", "body"):
                close(frozenset([end]), frozenset(["table"]) if end in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption") else SCOPE - {end})
            continue
        if tag is None:
            continue
        tag, attributes = tag.lower(), {}
        if m[3]:
            for a in ATTRIBUTE.finditer(m[3]):
                value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or ""
                attributes.setdefault(a[1].lower(), html.unescape(value) if "&" in value else value)
        if tag in ("html", "body"):
            if tag == "body" and not body:
                into_body()
            (open_[1] if tag == "body" and len(open_) > 1 else root).attributes.update({k: v for k, v in attributes.items()})
            continue
        if tag == "head":
            if not body and len(open_) == 1:
                push("head", attributes)
            continue
        if not body and open_[-1].tag in ("html", "head") and tag not in IN_HEAD:
            into_body()
        if tag in ENDS_PARAGRAPH:
            close(frozenset(["p"]), SCOPE)
        if tag in HEADINGS and open_[-1].tag in HEADINGS:
            cut(len(open_) - 1)
        if tag in IMPLIED_END:
            close(*IMPLIED_END[tag])
            if tag in ("tbody", "thead", "tfoot"):
                close(frozenset(["tr"]), frozenset(["table"])) and close(IMPLIED_END[tag][0], frozenset(["table"]))
            if tag == "tr":
                close(frozenset(["td", "th"]), frozenset(["table"])) and close(*IMPLIED_END["tr"])
            if tag in ("td", "th") and open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push("tr", {})
        if tag in VOID:
            put(Node(tag, attributes))
        elif tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at) if tag != "plaintext" else None
            inner = source[at : stop.start() if stop else n]
            node = Node(tag, attributes)
            node.children = [html.unescape(inner) if tag in DECODED else inner]
            put(node)
            if stop is None:
                break
            at = TAG_REST.match(source, stop.end()).end()
        else:
            push(tag, attributes)
    return root


def hidden(node: Node) -> tuple[bool, bool | None]:
    """Whether the element is not rendered at all, and whether its visibility is set."""
    a = node.attributes
    if node.tag in HIDDEN or (node.tag == "dialog" and "open" not in a):
        return True, None
    if not a:
        return False, None
    if ("hidden" in a and a["hidden"].lower() != "until-found") or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return True, None
    visible = None
    if "style" in a:
        rules = {}
        for name, value, important in STYLE.findall(a["style"].lower()):  # the last one counts, unless an important one came before
            if important or not rules.get(name, ("", ""))[1]:
                rules[name] = (value, important)
        if rules.get("display", ("",))[0] == "none" or rules.get("content-visibility", ("",))[0] == "hidden":
            return True, None
        if "visibility" in rules:
            visible = rules["visibility"][0] not in ("hidden", "collapse")
    return False, visible


class Lines:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = False  # a space, an empty line is due before what comes next
        self.marker = ""

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.line(keep=True)
                self._put(line)
            return
        words = SPACE.sub(" ", text)
        if words == " " or not words:
            self.space |= bool(words)
            return
        if self.parts and (self.space or words[0] == " "):
            self.parts.append(" ")
        self.space = words[-1] == " "
        self._put(words.strip(" "))

    def _put(self, text: str) -> None:
        if not text:
            return
        if not self.parts and self.gap:
            if self.lines:
                self.lines.append("")
            self.gap = False
        if self.marker:
            self.parts.append(self.marker)
            self.marker = ""
        self.parts.append(text)

    def line(self, keep: bool = False) -> None:
        """End the line; with keep an empty line stays."""
        if self.parts or (keep and not self.gap):
            self.lines.append("".join(self.parts).rstrip())
        self.parts, self.space = [], False

    def block(self, lines: list[str], indent: str = "", first: str | None = None) -> None:
        self.line()
        if not lines:
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        for i, line in enumerate(lines):
            lead = first if i == 0 and first is not None else indent
            self.lines.append((lead + line).rstrip() if line or (i == 0 and first) else "")

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


def render(node: Node, out: Lines, visible: bool = True, pre: bool = False, depth: int = 0, level: int = 0) -> None:
    """The element's content; depth: of lists around it, level: of quotations, lists and tables that are laid out on their own.

    Open elements wait on a stack of their own: what is left of their children, how these are shown, whether a line ends after them (1) with a gap (2), and for a list
    beyond NESTED its tag, the next item's number and the step to the one after.
    """
    stack = [(iter(node.children), visible, pre, depth, 0, None)]
    while stack:
        children, visible, pre, depth, after, numbers = stack[-1]
        for child in children:
            if isinstance(child, str):
                if visible:
                    out.text(child, pre)
                continue
            gone, own = hidden(child)
            if gone:
                continue
            seen, tag = visible if own is None else own, child.tag
            if tag == "br":
                out.line(keep=True)
            elif tag == "hr":
                out.line()
                out.gap = True
            elif tag == "table" and level < NESTED:
                out.line()
                out.gap = True
                out.block(table(child, seen, depth, level + 1))
                out.gap = True
            elif tag in ("ul", "ol", "menu", "dir"):
                out.line()
                out.gap |= depth == 0
                if level >= NESTED:
                    stack.append((iter(child.children), seen, False, depth + 1, 1, _numbers(child)))
                    break
                listed(child, out, seen, depth, level + 1)
                out.gap |= depth == 0
            elif tag in ("blockquote", "dd") and level < NESTED:
                out.line()
                out.gap |= tag == "blockquote"
                out.block(_inner(child, seen, pre, depth, level + 1), "    ")
                out.gap |= tag == "blockquote"
            elif tag == "details" and "open" not in child.attributes:
                out.line()
                stack.append((iter([c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1]), seen, pre, depth, 1, None))
                break
            elif tag == "li" and numbers:
                out.line()
                out.marker = _marker(numbers, child, depth - 1)
                stack.append((iter(child.children), seen, False, depth, 1, None))
                break
            elif tag in BLOCKS:
                out.line()
                out.gap |= tag in SPACED
                stack.append((iter(child.children), seen, pre or tag in ("pre", "xmp", "listing", "plaintext"), depth, 2 if tag in SPACED else 1, None))
                break
            elif tag == "input":
                if seen and child.attributes.get("type", "text").lower() in ("button", "submit", "reset", "text", "search", "email", "url", "tel"):
                    out.text(child.attributes.get("value", ""), pre)
            elif tag != "wbr":
                inside = ['"', *child.children, '"'] if tag == "q" else child.children
                stack.append((iter(inside), seen, pre or tag == "textarea", depth, 0, None))
                break
        else:
            stack.pop()
            if after:
                out.line()
                out.gap |= after == 2
                if stack and stack[-1][5]:  # an item without content leaves no marker behind
                    out.marker = ""


def _inner(node: Node, visible: bool, pre: bool, depth: int, level: int) -> list[str]:
    own = Lines()
    render(node, own, visible, pre, depth, level)
    return own.done()


def _numbers(node: Node) -> list:
    """A list's tag, its first item's number, and the step to the next. Reversed lists count down to 1 if they name no start."""
    count, back = _number(node.attributes.get("start")), "reversed" in node.attributes
    if count is None:
        count = sum(isinstance(c, Node) and c.tag == "li" and not hidden(c)[0] for c in node.children) if back else 1
    return [node.tag, count, -1 if back else 1]


def _marker(numbers: list, item: Node, depth: int) -> str:
    """The marker of a list's item. numbers: as of _numbers(), with the number that is next."""
    if numbers[0] != "ol":
        return BULLETS[min(depth, 2)] + " "
    value = _number(item.attributes.get("value"))
    count = numbers[1] if value is None else value
    numbers[1] = count + numbers[2]
    return f"{count}. "


def _number(text: str | None) -> int | None:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(m[1]) if m else None


def listed(node: Node, out: Lines, visible: bool, depth: int, level: int) -> None:
    numbers, rest = _numbers(node), []

    def flush() -> None:
        if rest:
            loose = Node("div", {})
            loose.children = list(rest)
            rest.clear()
            out.block(_inner(loose, visible, False, depth + 1, level), "  ")

    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            rest.append(child)
            continue
        flush()
        gone, own = hidden(child)
        if gone:
            continue
        marker = _marker(numbers, child, depth)
        out.block(_inner(child, visible if own is None else own, False, depth + 1, level), " " * len(marker), marker)
    flush()


def _rows(node: Node, visible: bool, captions: list[tuple[Node, bool]], loose: list) -> Iterator[tuple[Node, bool]]:
    stack = [(iter(node.children), visible)]
    while stack:
        children, visible = stack[-1]
        for child in children:
            if isinstance(child, str):
                loose.append(child)
                continue
            gone, own = hidden(child)
            if gone:
                continue
            seen = visible if own is None else own
            if child.tag == "tr":
                yield child, seen
            elif child.tag in ("thead", "tbody", "tfoot"):
                stack.append((iter(child.children), seen))
                break
            elif child.tag == "caption":
                captions.append((child, seen))
            else:
                loose.append(child)
        else:
            stack.pop()


def _width(sizes: list[int], rows: int, most: int) -> int:
    """The width of a column with cells of such sizes in so many rows: the greatest of the sizes that takes `most` spaces at most."""
    filled = 0  # what the cells hold that are no wider
    for k, size in enumerate(sorted(sizes)):
        if size * (rows - len(sizes) + k) - filled > most:
            return width
        width, filled = size, filled + size
    return width


def table(node: Node, visible: bool, depth: int, level: int) -> list[str]:
    """Captions and stray content first, then the rows with their cells in columns."""
    captions: list[tuple[Node, bool]] = []
    loose: list = []
    grid: list[dict[int, list[str]]] = []
    over: set[tuple[int, int]] = set()  # cells over several columns
    taken: dict[int, int] = {}  # columns that a cell from above still fills, and for how many rows
    for row, seen in _rows(node, visible, captions, loose):
        cells, column, below = {}, 0, {c: k - 1 for c, k in taken.items() if k > 1}
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                loose.append(cell)
                continue
            gone, own = hidden(cell)
            if gone:
                continue
            while column in taken:
                column += 1
            wide, high = (max(1, min(_number(cell.attributes.get(k)) or 1, most)) for k, most in (("colspan", 1000), ("rowspan", 65_534)))
            cells[column] = _inner(cell, seen if own is None else own, False, depth, level)
            if wide > 1:
                over.add((len(grid), column))
            if high > 1:
                below.update({c: high - 1 for c in range(column, column + wide)})
            column += wide
        taken = below
        grid.append(cells)
    stray = Node("div", {})
    stray.children = loose
    out = _inner(stray, visible, False, depth, level)
    for caption, seen in captions:
        out += _inner(caption, seen, False, depth, level)
    sizes: dict[int, list[int]] = defaultdict(list)
    for r, cells in enumerate(grid):
        for c, lines in cells.items():
            sizes[c] += [1 if (r, c) in over else len(x) for x in lines]
    most = PADDING_FREE + PADDING * sum(map(sum, sizes.values()))
    rows = sum(max([len(x) for x in cells.values()], default=0) for cells in grid)
    widths = {c: _width(own, rows, most) for c, own in sizes.items()}
    shown = [c for c in sorted(widths) if widths[c]]
    for cells in grid:
        for i in range(max([len(x) for x in cells.values()], default=0)):
            line = "  ".join((cells[c][i] if c in cells and i < len(cells[c]) else "").ljust(widths[c]) for c in shown)
            out.append(line.rstrip())
    return out


def extract(source: str | None) -> str:
    out = Lines()
    render(build(source or ""), out)
    return "\n".join(out.done())


def extract_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text (the page's visible text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([extract(x) for x in batch.column("text").to_pylist()], pa.string())], ["page_id", "text"])

    return common.documents(df, id_col, html_col).mapInArrow(run, "page_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
