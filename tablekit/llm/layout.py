"""Visible text of web pages with its layout.

A tree builder turns tags into opened and closed elements, with the start and end tags that authors may leave out, and a
renderer follows it: hidden elements are silent, blocks begin lines, paragraphs and headings are set off by blank lines,
lists get markers and indents, and table cells are padded into columns. Both keep only the open elements, so that depth
costs nothing but memory for the path.

Formulas (MathML) and drawings (SVG) are read by the rules of foreign elements: tags may close themselves, tags of HTML's
blocks end them, and in a drawing only ``text`` and ``foreignObject`` show text.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import slices

# Fixed values of the format.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("script style title template noscript iframe noembed noframes datalist audio video canvas object".split()) | frozenset(
    "/annotation /annotation-xml /clippath /defs /desc /filter /lineargradient /marker /mask /metadata /mphantom /pattern /radialgradient /script "
    "/style /symbol /title".split()  # foreign elements have a stroke before their names
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset xmp".split())
BLOCK = SPACED | frozenset(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup hr html legend li "
    "main menu nav option optgroup search section summary textarea tr tbody thead tfoot".split()
)
PRE = frozenset("pre textarea xmp".split())
FORMATTING = frozenset("a abbr b big cite code em font i kbd mark q s small span strike strong sub sup tt u var".split())
#: Elements that a start tag ends, up to the element that bounds the search.
ENDS = {
    **{t: ({"p"}, {"table", "td", "th", "caption", "button"}) for t in BLOCK - set("body html tr tbody thead tfoot caption option optgroup".split())},
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}), "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    **{t: ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
    "caption": ({"caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Elements that end tags of others do not reach through.
WALLS = frozenset("table td th caption".split())
LISTS = frozenset("ul ol menu dir".split())
#: What text an open element shows: any, that of a formula (no blanks between its elements), none (a drawing), that of a drawing.
HTML, FORMULA, DRAWING, LETTERING = range(4)
#: Foreign elements that hold HTML again, by what their parent shows.
HOLDERS = {FORMULA: frozenset("mi mo mn ms mtext".split()), **{k: frozenset("foreignobject desc title".split()) for k in (DRAWING, LETTERING)}}
#: HTML elements whose start tags end foreign elements.
BREAKING = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var".split()
)
#: Foreign elements on lines of their own, and parts of formulas that do not stand side by side.
LINES = frozenset("/text /foreignobject /mtr /mlabeledtr".split())
APART = frozenset("mfrac mroot msubsup munderover mmultiscripts mtr mlabeledtr".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?P<stop>>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANKS = re.compile(r"[ \t\n\f\r]+")
_UNQUOTED_STROKE = re.compile(r"=\s*[^\s\"']*/$")
_ABSENT = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.IGNORECASE)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
#: Widest padding of a table column; longer cells are not cut, but nothing is aligned to them. Lines are padded up to 20 times as much.
WIDEST = 80
#: Columns in which cells are kept free for those that reach down from rows above.
SPANNED = 1000
#: Buttons' own labels.
LABELS = {"submit": "Submit", "reset": "Reset", "button": ""}


def _attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


def _hidden(tag: str, attributes: dict[str, str]) -> bool:
    return (
        tag in SILENT or "hidden" in attributes or bool(_ABSENT.search(attributes.get("style", "")))
        or tag == "dialog" and "open" not in attributes or tag[0] == "/" and attributes.get("display") == "none"
    )


def _visibility(tag: str, attributes: dict[str, str]) -> bool | None:
    """Whether an element says that its content, unless it says otherwise itself, can be seen."""
    said = _VISIBILITY.findall(attributes.get("style", "")) or ([attributes["visibility"]] if tag[0] == "/" and "visibility" in attributes else [])
    return said[-1].lower() not in ("hidden", "collapse") if said else None


def events(page: str):
    """``("open", tag, attributes)``, ``("close", tag, None)`` and ``("text", text, None)``, each open element closed; foreign tags as ``/tag``."""
    path: list[str] = []
    names: list[str] = []
    modes = [HTML]
    count: Counter = Counter()

    def close(to: int):
        while len(path) > to:
            tag = path.pop()
            count[tag] -= 1
            modes.pop()
            yield "close", names.pop(), None
            if modes[-1] == FORMULA and path[-1] in APART:
                yield "text", " ", None

    def shown(text):
        if modes[-1] in (HTML, LETTERING) or modes[-1] == FORMULA and text.strip():
            yield "text", text, None

    def ending(targets, walls):
        """Close the outermost target that no wall shuts off."""
        if unseen := sum(count[t] for t in targets):
            at = None
            for k in range(len(path) - 1, -1, -1):
                if path[k] in targets:
                    at, unseen = k, unseen - 1
                    if not unseen:
                        break
                elif path[k] in walls:
                    break
            if at is not None:
                yield from close(at)

    def opening(tag, attributes):
        path.append(tag)
        count[tag] += 1
        mode = modes[-1]
        names.append(tag if mode == HTML else f"/{tag}")
        if tag in ("svg", "math"):
            mode = DRAWING if tag == "svg" else FORMULA
        elif mode and (tag in HOLDERS[mode] or tag == "annotation-xml" and attributes.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")):
            mode = HTML
        elif mode == DRAWING and tag == "text":
            mode = LETTERING
        modes.append(mode)
        return "open", names[-1], attributes

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            yield from shown(html.unescape(page[at:]))
            break
        if found.start() > at:
            yield from shown(html.unescape(page[at : found.start()]))
        at = found.end()
        if names and (modes[-1] or names[-1][0] == "/") and page.startswith("<![CDATA[", found.start()):
            stop = page.find("]]>", found.start() + 9)
            yield from shown(page[found.start() + 9 : stop if stop >= 0 else len(page)])
            at = stop + 3 if stop >= 0 else len(page)
            continue
        if not found["tag"]:
            continue
        if not found["stop"]:  # what the page's end cuts off is no tag
            yield from shown(html.unescape(page[found.start() :]))
            break
        tag = found["tag"].lower()
        if found["end"]:
            if tag == "br":
                yield "open", "br", {}
                yield "close", "br", None
            elif not count[tag]:
                if tag == "p":
                    yield "open", "p", {}
                    yield "close", "p", None
            elif tag in FORMATTING:
                # A formatting element that ends inside another block ends there only; blocks stay open.
                k = len(path) - 1
                while path[k] != tag and path[k] in FORMATTING:
                    k -= 1
                if path[k] == tag:
                    yield from close(k)
            else:
                walls = {"table"} if tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption") else set() if tag == "table" else WALLS
                k = len(path) - 1
                while k >= 0 and path[k] != tag and path[k] not in walls:
                    k -= 1
                if k >= 0 and path[k] == tag:
                    yield from close(k)
            continue
        attributes = _attributes(found["rest"]) if found["rest"].strip(" /\n\t") else {}
        while modes[-1] and (tag in BREAKING or tag == "font" and attributes.keys() & {"color", "face", "size"}):
            yield from close(len(path) - 1)
        if modes[-1] or tag in ("svg", "math"):
            closes = found["rest"].endswith("/") and not _UNQUOTED_STROKE.search(found["rest"])
            plain = not closes and modes[-1] and tag in ("script", "style")
            yield opening(tag, attributes)
            if closes:
                yield from close(len(path) - 1)
            elif plain:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = stop.start() if stop else len(page)
            continue
        if tag in ("html", "body", "head") and count[tag]:
            continue
        if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") and not count["table"]:
            continue
        if tag in ENDS:
            yield from ending(*ENDS[tag])
            if tag in ("li", "dt", "dd"):
                yield from ending(*ENDS["p"])
        if tag in ("td", "th"):
            for k in range(len(path) - 1, -1, -1):
                if path[k] in ("tr", "table"):
                    break
            if path[k] == "table":
                yield opening("tr", {})
        yield opening(tag, attributes)
        if tag in VOID:
            yield from close(len(path) - 1)
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            inner = page[at : stop.start() if stop else len(page)]
            at = stop.start() if stop else len(page)
            yield "text", html.unescape(inner) if tag in ("textarea", "title") else inner, None
    yield from close(0)


class _Flow:
    """Lines of text with margins, indents and list markers."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.indent, self.marker = "", 0, "", ""

    def put(self, text: str, pre: bool) -> None:
        if pre:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self.line += first
            for x in more:
                self.end(True)
                self.line = x
            return
        text = _BLANKS.sub(" ", text)
        self.line += text[1:] if text[:1] == " " and (not self.line or self.line[-1] == " ") else text

    def end(self, force: bool = False) -> None:
        text = self.line.rstrip(" ")
        if text or force:
            if self.lines:
                self.lines += [""] * self.gap
            self.lines.append((self.marker or self.indent) + text if text else "")
            self.gap = 0
            if text:
                self.marker = ""
        self.line = ""

    def block(self, margin: int) -> None:
        self.end()
        self.gap = max(self.gap, margin)

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


class _Table:
    """Rows of cells: first column, lines, columns that a cell spans."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str], int]]] = []
        self.until: list[int] = []  # by column: the row before which a cell from above ends
        self.next = 0

    def row(self) -> None:
        self.rows.append([])
        self.next = 0

    def cell(self, lines: list[str], across: int, down: int) -> None:
        here, at, until = len(self.rows), self.next, self.until
        while at < len(until) and until[at] >= here:
            at += 1
        self.rows[-1].append((at, lines, across))
        self.next = at + across
        if down > 1 and at < SPANNED:
            stop = min(at + across, SPANNED)
            until += [0] * (stop - len(until))
            until[at:stop] = [here + down - 1] * (stop - at)

    def layout(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for at, lines, across in row:
                if across == 1:
                    widths[at] = max([widths.get(at, 0), *(w for x in lines if (w := _width(x)) <= WIDEST)])
        columns = sorted(widths)
        places = list(itertools.accumulate((widths[c] + 2 for c in columns), initial=0))
        out = []
        for row in self.rows:
            height = max((len(lines) for _, lines, _ in row), default=0)
            found: list[list[tuple[int, str]]] = [[] for _ in range(height)]
            for at, lines, _ in row:
                for k, text in enumerate(lines):
                    found[k].append((at, text))
            for cells in found:
                line, wide, tail = [], 0, ""
                for at, text in cells:
                    place = places[bisect.bisect_left(columns, at)]
                    pad = max(0, place - wide) if place <= 20 * WIDEST else 0
                    if wide and text and not (tail + " " * min(pad, 2)).endswith("  "):
                        pad += 2
                    line += [" " * pad, text]
                    wide += pad + _width(text)
                    tail = (tail + " " * min(pad, 2) + text)[-2:]
                out.append("".join(line).rstrip(" "))
        return out


def _number(text: str | None, default: int, most: int) -> int:
    digits = re.match(r"\s*\d{1,6}", text or "")
    return min(most, max(1, int(digits[0]))) if digits else default


def render(page: str | None) -> str:
    """The visible text of a page."""
    flows, tables, lists = [_Flow()], [], []
    silent, depth, pre = 0, 0, 0
    seen: list[tuple[int, bool]] = []  # depths of elements that say whether they can be seen
    cells: list[tuple] = []
    closed: list[int] = []  # depths of closed details elements
    for kind, tag, attributes in events(page or ""):
        flow = flows[-1]
        if kind == "text":
            if not silent and not (closed and closed[-1] > 0) and (not seen or seen[-1][1]):
                flow.put(tag, pre > 0)
            continue
        if kind == "open":
            depth += 1
            if silent:
                continue
            if closed and closed[-1] > 0:
                if tag == "summary" and depth == closed[-1] + 1:
                    closed[-1] = -closed[-1]  # shown while it is open
                else:
                    continue
            if _hidden(tag, attributes):
                silent = depth
                continue
            if (said := _visibility(tag, attributes)) is not None:
                seen.append((depth, said))
            if tag == "input":
                if (kind := attributes.get("type", "").strip().lower()) in LABELS and (not seen or seen[-1][1]):
                    flow.put(attributes.get("value") or LABELS[kind], False)
            elif tag == "br":
                flow.end(True) if flow.line.strip(" ") else flow.block(1)
            elif tag in ("td", "th"):
                cells.append((_number(attributes.get("colspan"), 1, 1000), _number(attributes.get("rowspan"), 1, 65534), len(lists)))
                flows.append(_Flow())
                if not tables[-1].rows:
                    tables[-1].row()
            elif tag == "tr":
                tables[-1].row()
            elif tag == "li":
                flow.block(0)
                numbered = lists and lists[-1][0] == "ol"
                if numbered and (given := re.match(r"\s*([+-]?\d{1,9})", attributes.get("value", ""))):
                    lists[-1][1] = int(given[1])
                marker = f"{lists[-1][1]}. " if numbered else "- "
                if numbered:
                    lists[-1][1] += 1
                if lists:
                    lists[-1][2].append(flow.indent)
                flow.marker = flow.indent + marker if not flow.marker else flow.marker + marker
                flow.indent += " " * len(marker)
            elif tag in LINES:
                flow.block(0)
            elif tag == "/tspan" and attributes.keys() & {"x", "y", "dy"}:
                flow.put(" ", False)
            elif tag in BLOCK:
                flow.block(1 if tag in SPACED and not (tag in LISTS and lists) else 0)
                if tag == "table":
                    tables.append(_Table())
                elif tag in LISTS:
                    lists.append([tag, _number(attributes.get("start"), 1, 999_999), []])
                elif tag in ("dd", "blockquote"):
                    flow.indent += "  "
                elif tag == "details" and "open" not in attributes:
                    closed.append(depth)
                pre += tag in PRE
            continue
        depth -= 1
        while seen and seen[-1][0] > depth:
            seen.pop()
        if silent:
            silent = 0 if depth < silent else silent
            continue
        if closed:
            at = abs(closed[-1])
            if depth < at:
                closed.pop()
            elif closed[-1] > 0:
                continue
            elif tag == "summary" and depth == at:
                closed[-1] = at
        if tag in ("td", "th"):
            across, down, held = cells.pop()
            del lists[held:]
            done = flows.pop()
            text = done.text()
            tables[-1].cell(text.split("\n") if text else [], across, down)
        elif tag == "table":
            flow.end()
            for line in tables.pop().layout():
                flow.line = line
                flow.end()
            flow.block(1)
        elif tag == "li":
            flow.block(0)
            if flow.marker:
                flow.marker = ""
            if lists and lists[-1][2]:
                flow.indent = lists[-1][2].pop()
            elif not lists:
                flow.indent = flow.indent[:-2]
        elif tag in LINES:
            flow.block(0)
        elif tag in BLOCK and tag not in ("tr", "tbody", "thead", "tfoot"):
            flow.block(1 if tag in SPACED and not (tag in LISTS and len(lists) > 1) else 0)
            if tag in LISTS and lists:
                lists.pop()
            elif tag in ("dd", "blockquote"):
                flow.indent = flow.indent[:-2]
            pre -= tag in PRE
    return flows[0].text()


def extract(pages: DataFrame, *, id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: id and ``text``, the whole page's visible text.

    Null and empty pages have an empty text. Repeated rows give repeated rows. Other columns are not read. Silent are
    scripts, styles, titles, templates, elements with ``hidden`` or an inline style that hides them (style sheets are not read), dialogs and details that aren't
    open (but for their summaries), what stands in for media or scripting, and the parts of drawings and formulas that browsers never
    show (definitions, descriptions, annotations). Text of drawings stands on lines of its own. Pages may be of any length and broken in any
    way; cells are aligned up to 1,600 characters, and cells that reach down count in the first ``SPANNED`` columns.
    """

    def run(batches):
        for batch in slices(batches, "html"):
            texts = [render(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    named = pages.select(F.col(id).alias("id"), F.col(html).cast("string").alias("html"))
    return named.mapInArrow(run, f"id {dict(named.dtypes)['id']}, text string").withColumnRenamed("id", id)
