"""Main text of web pages by wrapper induction.

Pages of one host share templates. Every page is parsed into a tree of block elements and aligned with a few reference pages
of its host that have the same layout (``REFERENCES`` different pages of each layout, least hash first; a layout is the
set of structural tags and their classes) by simple tree matching: nodes match if their labels (tag, class, id) do, children
are matched in order so that the number of matched nodes is highest. Different pages have one vote each: a path with text is
constant and belongs to a template if its text matches with equal text on a ``SHARE`` of the pages that have text there (and
on three, or on all if there are fewer); other nodes are slots. The content region of a layout is the deepest path that holds
most of the slots' text.

Where a layout has ``ENOUGH`` different pages the template decides: the text of a page is what stands in the region and is
not constant. Tags with a meaning of their own (nav, footer, form, an article element ...) only settle what is left: furniture
inside the region goes, and paragraphs, headings and list items of an article element stay even if they recur. Class names
decide nothing there. Pages of rarer layouts have no region; they are read by tags and by words in class and id, without
constant nodes.

Sibling lists of any length are matched exactly. Of as many matched nodes, equal children go together. A table of siblings
takes time in proportion to its cells and memory to one length and the root of the other. A page learns nothing about what
varies from a reference that is nearly equal.

Null or empty html gives an empty text. Pages without a url are a host of their own. Repeated rows are read each. Broken
markup (unclosed, crossed or cut tags) and any depth are read; character references are decoded as browsers do.
Empty tables give empty ones; extra columns are not looked at.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import sized, stored

REFERENCES = 4  # of a layout
ENOUGH = 6  # different pages of a layout, from which on its template decides
LONG_HTML = 200_000  # characters; references are rather taken from shorter pages
SHARE = 0.3
MOST = 2 / 3  # of the slots' text, which the region holds at least
CELLS = 40_000  # of a table of siblings that is worked out cell by cell; larger ones row by row, with equal results
SEEN = 64  # rows of gains of a sibling list that are kept
MOST_SHAPES = 20_000  # entries of forms and of pairs of forms that are kept for the pages of a layout
MOST_SHARED = 8_000_000  # characters of references that may be sent to all tasks; more are joined through a shuffle
SALTS = 16  # copies of the references where they are joined, so that no task reads a whole host
VOTE = "path long, parent long, node long, pages int, matched int, size long, below long, chain array<long>"
STRUCTURE = "main|article|section|aside|header|footer|nav|table|form"

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"""|</?[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.DOTALL,
)
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
FURNITURE = frozenset(
    "head nav header footer aside form button select option fieldset dialog menu svg canvas object audio video math".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tbody thead div section article main body blockquote td th form".split())
WORDS = re.compile(r"[a-z]+")
# words in class or id that mark furniture
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice "
    "alert popup modal overlay sidebar nav navbar navigation menu breadcrumb breadcrumbs header footer comment comments "
    "respond reply replies disqus share sharing social related recommended newsletter subscribe signup login search widget "
    "masthead toolbar skip pagination pager copyright legal".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


class Block:
    """An element that starts a block of text; inline elements belong to the block around them."""

    __slots__ = ("tag", "label", "path", "parent", "children", "runs", "out", "article", "depth", "form", "whole")

    def __init__(self, tag: str, label: str, parent: Block | None, out: bool, article: bool) -> None:
        self.tag, self.label, self.parent, self.children, self.runs = tag, label, parent, [], []
        self.out = out or bool(parent and parent.out)
        self.article = article or bool(parent and parent.article)
        self.depth = parent.depth + 1 if parent else 0
        self.path = hash_of(f"{parent.path if parent else 0}>{label}")
        if parent:
            parent.children.append(self)

    def text(self) -> str:
        return self.runs[0][1] if len(self.runs) == 1 else "\n".join([t for _, t in self.runs])


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode(errors="replace")) >> 1


def parse(page: str, words: bool = True) -> tuple[list[Block], list[tuple[Block, str]]]:
    """All blocks, the root first, and their runs of text in page order. Furniture is told by tags, and by ``words``."""
    root = Block("", "", None, False, False)
    blocks, runs, at, position = [root], [], root, 0
    inline: list[tuple[str, bool]] = []
    pending: list[str] = []
    hidden = 0  # open inline elements that are furniture

    def flush() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                at.runs.append((len(runs), text))
                runs.append((at, text))

    while position < len(page):
        match = TOKEN.match(page, position)
        position = match.end()
        text = match["text"]
        if text is not None:
            if not hidden:
                pending.append(unescape(text))
            continue
        if match["tag"] is None:
            continue
        tag = match["tag"].lower()
        if match["end"]:
            if tag in INLINE:
                if tag in [t for t, _ in inline]:
                    while True:
                        name, out = inline.pop()
                        hidden -= out
                        if name == tag:
                            break
                continue
            node = at
            while node.parent and node.tag != tag:
                node = node.parent
            if node.parent:
                flush()
                at, inline, hidden = node.parent, [], 0
            continue
        named = {k.lower(): v.strip("\"'") for k, v in NAMED.findall(match["more"])} if match["more"] else {}
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.IGNORECASE).search(page, position)
            close = page.find(">", end.end() - 1) if end else -1
            position = close + 1 if close >= 0 else len(page)
            continue
        if tag == "br":
            pending.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        out = marked(named, words)
        if tag in INLINE:
            if not match["more"].endswith("/"):
                inline.append((tag, out))
                hidden += out
            continue
        flush()
        inline, hidden = [], 0
        around = at  # a paragraph ends where another block starts
        while around.parent and around.tag != "p" and around.tag not in HOLDS:
            around = around.parent
        if around.tag == "p":
            at = around.parent
        while tag in CLOSES and at.tag in CLOSES[tag]:
            at = at.parent
        article = tag in ("article", "main") or named.get("role") == "main" or "articlebody" in named.get("itemprop", "").lower()
        label = " ".join([tag, *sorted(set(WORDS.findall((named.get("class", "") + " " + named.get("id", "")).lower())))])
        furniture = out or (tag in FURNITURE and not (tag == "header" and at.article))
        at = Block(tag, label, at, furniture, article and not out)
        blocks.append(at)
        if match["more"].endswith("/"):
            at = at.parent
    flush()
    return blocks, runs


def marked(named: dict[str, str], by_words: bool) -> bool:
    if not named:
        return False
    if "hidden" in named or named.get("role", "").lower() in ROLES:
        return True
    if not by_words:
        return False
    words = WORDS.findall((named.get("class", "") + " " + named.get("id", "")).lower())
    return not MARKS.isdisjoint(words)


class Shapes:
    """Numbers of the forms of blocks (label and the numbers of the children's forms) and of wholes (forms with all texts), which
    are equal for equal blocks. References are numbered at once, and pages as they come, so that what two forms match is
    worked out once for all pages. A whole that no reference has is -1. What pages add is dropped beyond ``MOST_SHAPES``."""

    def __init__(self, references: list[Block]) -> None:
        self.references = references
        self.clear()

    def clear(self) -> None:
        self.forms: dict[tuple, int] = {}
        self.listed: list[tuple] = []
        self.sizes: list[int] = []  # nodes of a form
        self.known: dict[tuple[int, int], int] = {}  # matched nodes of two forms
        self.wholes: dict[tuple, int] = {}
        self.added = 0
        for root in self.references:
            self._number(root, True)
        self.added = 0

    def number(self, root: Block) -> None:
        if self.added + len(self.known) > MOST_SHAPES:
            self.clear()
        self._number(root, False)

    def _number(self, root: Block, learn: bool) -> None:
        forms, wholes = self.forms, self.wholes
        order = [root]
        for node in order:
            order.extend(node.children)
        for node in reversed(order):
            below = node.children
            form = (node.label, *[c.form for c in below])
            node.form = forms.get(form, -1)
            if node.form < 0:
                node.form = forms[form] = len(forms)
                self.listed.append(form)
                self.sizes.append(1 + sum(self.sizes[f] for f in form[1:]))
                self.added += len(form)
            whole = (node.label, node.text() if node.runs else "", *[c.whole for c in below])
            node.whole = wholes.setdefault(whole, len(wholes)) if learn else wholes.get(whole, -1)


def equal_ends(xs, ys) -> tuple[int, int]:
    """How many numbers two lists have in common at the start, and at the end of what is left."""
    most, start, end = min(len(xs), len(ys)), 0, 0
    while start < most and xs[start] == ys[start]:
        start += 1
    while end < most - start and xs[-1 - end] == ys[-1 - end]:
        end += 1
    return start, end


def next_row(above, gain):
    """A row of the table of two sibling lists: the most that can be gained up to each place."""
    if isinstance(above, np.ndarray):
        row = np.zeros_like(above)
        np.maximum(above[1:], above[:-1] + gain, out=row[1:])
        return np.maximum.accumulate(row, out=row)
    row = [0]
    for j, g in enumerate(gain):
        row.append(max(above[j + 1], row[j], above[j] + g))
    return row


def alignment(a: Block, b: Block, shapes: Shapes | None = None) -> list[tuple[Block, Block]]:
    """Matched nodes of two trees by simple tree matching; where as many nodes match in several ways, children that are equal
    with all that is below them go together. ``shapes`` has numbered both trees, b as a reference.

    Equal blocks at the ends of two sibling lists go together without a table: no other partner gains more."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # trees may be deep
    if shapes is None:
        shapes = Shapes([b])
        shapes.number(a)
    forms, sizes, known = shapes.listed, shapes.sizes, shapes.known

    def first_row(xs, ys):
        """Long lists are worked out as arrays, which gives the same."""
        return np.zeros(len(ys) + 1, np.int64) if len(xs) * len(ys) > CELLS else [0] * (len(ys) + 1)

    def gains(xs, ys, whole_xs=None, whole_ys=None):
        """A function that gives what x at a place gains with each y: matched nodes, and less than one for equal ones."""
        unlike, seen = set(ys), {}
        arrays = isinstance(first_row(xs, ys), np.ndarray)
        equal_to = None if whole_ys is None else np.array(whole_ys) if arrays else whole_ys

        def of(i: int):
            x = xs[i]
            if x not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                found = {y: nodes(x, y) << 32 for y in unlike}
                row = [found[y] for y in ys]
                seen[x] = np.array(row, np.int64) if arrays else row
            if equal_to is None:
                return seen[x]
            w = whole_xs[i]
            return seen[x] + (equal_to == w) if arrays else [g + (w == v) for g, v in zip(seen[x], equal_to, strict=True)]

        return of

    def nodes(x: int, y: int) -> int:
        """How many nodes of two forms match."""
        if x == y:
            return sizes[x]
        left, right = forms[x], forms[y]
        if left[0] != right[0]:
            return 0
        if len(left) == 1 or len(right) == 1:
            return 1
        if (x, y) not in known:
            start, end = equal_ends(left[1:], right[1:])
            xs, ys = left[1 + start : len(left) - end], right[1 + start : len(right) - end]
            equal = sum(sizes[f] for f in left[1 : 1 + start]) + sum(sizes[f] for f in left[len(left) - end :])
            if xs and ys:
                row, gain = first_row(xs, ys), gains(xs, ys)
                for i in range(len(xs)):
                    row = next_row(row, gain(i))
                equal += int(row[-1]) >> 32
            known[x, y] = 1 + equal
        return known[x, y]

    def matched(xs: list[Block], ys: list[Block]) -> list[tuple[Block, Block]]:
        """Pairs of children. Of a long table some rows are kept, and those between are worked out again."""
        start, end = equal_ends([x.whole for x in xs], [y.whole for y in ys])
        ends = [*zip(xs[:start], ys[:start], strict=True), *zip(xs[len(xs) - end :], ys[len(ys) - end :], strict=True)]
        xs, ys = xs[start : len(xs) - end], ys[start : len(ys) - end]
        if not xs or not ys:
            return ends
        fx, fy, wx, wy = [x.form for x in xs], [y.form for y in ys], [x.whole for x in xs], [y.whole for y in ys]
        if len({*fx, *fy}) == 1 and set(wx).isdisjoint(wy):  # every two gain the same: the table leads along the last ones
            return [*ends, *zip(reversed(xs), reversed(ys))]  # noqa: B905
        gain = gains(fx, fy, wx, wy)
        tops = [first_row(xs, ys)]
        size = len(xs)
        if isinstance(tops[0], np.ndarray):
            size, row = isqrt(len(xs)) + 1, tops[0]
            for i in range(len(xs)):
                row = next_row(row, gain(i))
                if (i + 1) % size == 0:
                    tops.append(row)
        pairs, j = [], len(ys)
        for start in reversed(range(0, len(xs), size)):
            gained = [gain(i) for i in range(start, min(start + size, len(xs)))]
            rows = [tops[start // size]]
            for g in gained:
                rows.append(next_row(rows[-1], g))
            i = len(gained)
            while i and j:
                g = gained[i - 1][j - 1]
                if g and rows[i][j] == rows[i - 1][j - 1] + g:
                    pairs.append((xs[start + i - 1], ys[j - 1]))
                    i, j = i - 1, j - 1
                elif rows[i][j] == rows[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return ends + pairs

    pairs, todo = [], [(a, b)] if a.label == b.label else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if x.children and y.children:
            todo.extend(zip(x.children, y.children, strict=True) if x.whole == y.whole else matched(x.children, y.children))
    return pairs


def votes(page: str, references: list[tuple[str, Block]], shapes: Shapes) -> list[tuple]:
    """What a page says of its host's template, whose references ``shapes`` has numbered, in rows of VOTE: for each path (no node) its parent, whether it has text that
    was compared, and how much text it has itself and below; for each node (path and text) that matched, its text and the
    paths around it."""
    blocks, runs = parse(page, words=False)
    size = sum(len(t) for _, t in runs)
    matched: set[int] = set()
    compared = False
    shapes.number(blocks[0])
    for html, other in references:
        if html == page:
            continue
        equal = [x for x, y in alignment(blocks[0], other, shapes) if x.runs and x.text() == y.text()]
        if sum(len(x.text()) for x in equal) > 0.7 * size:
            continue  # a copy shows nothing
        compared = True
        matched.update(id(x) for x in equal)
    paths: dict[int, list[int]] = {}
    nodes: dict[int, list] = {}
    below: dict[int, int] = {}
    for block in reversed(blocks):  # children before parents
        own = len(block.text()) if block.runs and not block.out else 0
        path = paths.setdefault(block.path, [block.parent.path if block.parent else 0, 0, 0, 0])
        under = below.pop(id(block), 0) + own
        if block.parent:
            below[id(block.parent)] = below.get(id(block.parent), 0) + under
        path[2] += own
        path[3] += under
        if block.runs:
            path[1] = int(compared)
            if id(block) in matched:
                chain, around = [], block
                while around:
                    chain.append(around.path)
                    around = around.parent
                node = nodes.setdefault(constant(block), [block.path, 0, chain])
                node[1] += own
    of_paths = [(path, parent, None, compared, 0, own, under, None) for path, (parent, compared, own, under) in paths.items()]
    return of_paths + [(path, 0, node, 0, 1, own, 0, chain) for node, (path, own, chain) in nodes.items()]


def is_constant(matched, pages):
    """For numbers and for columns."""
    return (matched > 0) & (matched >= SHARE * pages) & ((matched >= 3) | (matched >= pages))


def induce(pages: list[str]) -> tuple[list[int], int]:
    """Hashes of the template's constant nodes, and the path of the content region (0: none found), from different pages of
    one layout in memory."""
    different = sorted(set(pages))
    references = [(page, parse(page, words=False)[0][0]) for page in different]
    shapes = Shapes([tree for _, tree in references])
    voted, hits, own, below = Counter(), Counter(), Counter(), Counter()
    nodes: dict[int, tuple] = {}
    sizes: Counter[int] = Counter()
    parents: dict[int, int] = {}
    for page in different:
        for path, parent, node, compared, hit, size, under, chain in votes(page, references, shapes):
            if node is None:
                parents[path] = parent
                voted[path] += compared
                own[path] += size
                below[path] += under
            else:
                nodes[node] = (path, chain)
                hits[node] += hit
                sizes[node] += size
    constants = [n for n, (path, _) in nodes.items() if is_constant(hits[n], voted[path])]
    for n in constants:
        own[nodes[n][0]] -= sizes[n]
        below.subtract({path: sizes[n] for path in set(nodes[n][1])})
    inner = {parents[p] for p in own if own[p] > 0}  # never narrower than what holds the slots
    whole = max(below.values(), default=0)
    region = min((p for p in below if below[p] >= MOST * whole and p in inner), key=lambda p: (below[p], p), default=0)
    return sorted(constants), region if whole else 0


def constant(block: Block) -> int:
    return hash_of(f"{block.path}\n{block.text()}")


def extract(page: str, constants: frozenset[int], regions: tuple[int, ...] = ()) -> str:
    """The text of a page: what is in a region of its host's templates, if it has one of them."""
    if regions:
        blocks, runs = parse(page, words=False)
        inside: dict[int, int] = {}  # blocks in a region, and which one
        size: Counter[int] = Counter()
        for block in blocks:
            of = inside.get(id(block.parent), 0) if block.parent else 0
            if block.path in regions:
                of = of or block.path
            if of:
                inside[id(block)] = of
                size[of] += len(block.text()) if block.runs and not block.out else 0
        if size:
            chosen = min(size, key=lambda p: (-size[p], p))
            kept = {
                id(b) for b in blocks
                if b.runs and not b.out and inside.get(id(b)) == chosen
                and ((b.article and b.tag in PROSE) or constant(b) not in constants)
            }
            return "\n".join(t for b, t in runs if id(b) in kept)
    blocks, runs = parse(page)
    explicit = any(b.article and not b.out and b.runs for b in blocks)
    kept = set()
    for block in blocks:
        if block.runs and not block.out and (block.article or not explicit):
            if (explicit and block.tag in PROSE) or constant(block) not in constants:
                kept.add(id(block))
    return "\n".join(t for b, t in runs if id(b) in kept)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def layout(html: Column) -> Column:
    """A number for the set of structural tags and of the classes of the page's larger elements."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?i)<({STRUCTURE})\b"), 1)
    classes = F.regexp_extract_all(html, F.lit(rf"""(?i)<(?:div|{STRUCTURE})\b[^>]*?\bclass\s*=\s*["']?([a-z]+)"""), 1)
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, F.lower))), F.array_sort(F.array_distinct(classes)))


def templates(pages: DataFrame) -> DataFrame:
    """__host, constants, regions: the constant nodes of every host, and the content regions of its layouts."""
    spark = pages.sparkSession
    html = pages["html"].cast("string")
    rows = pages.where("html is not null").select(host(pages["url"]).alias("__host"), F.xxhash64(html).alias("__h"), html.alias("__html"))
    slim = rows.select("__host", layout(F.col("__html")).alias("__layout"), "__h", (F.length("__html") > LONG_HTML).alias("__long"))
    slim = stored(slim.distinct(), "different")
    rank = F.expr("row_number() over (partition by __host, __layout order by __long, __h)")
    chosen = sized(slim.withColumn("__n", rank).where(F.col("__n") <= REFERENCES).select("__host", "__layout", "__h"))
    chosen = rows.join(chosen, ["__host", "__h"]).groupBy("__host", "__layout", "__h").agg(F.first("__html").alias("__html"))
    chosen = chosen.groupBy("__host", "__layout")
    chosen = stored(chosen.agg(F.sort_array(F.collect_list("__html")).alias("__refs")), "references")  # REFERENCES for each
    length = chosen.agg(F.sum(F.expr("aggregate(__refs, 0L, (s, x) -> s + length(x))"))).first()[0] or 0
    small = length <= MOST_SHARED
    shared = spark.sparkContext.broadcast({(r["__host"], r["__layout"]): r["__refs"] for r in chosen.collect()} if small else {})
    # One of equal pages, found before the shuffle.
    different = rows.groupBy("__host", "__h").agg(F.first("__html").alias("__html"))
    different = different.join(slim.select("__host", "__h", "__layout").hint("shuffle_hash"), ["__host", "__h"])
    if small:
        asked = different.select("__host", "__layout", "__html")
    else:
        salted = chosen.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        asked = different.withColumn("__salt", F.pmod("__h", F.lit(SALTS)).cast("int")).join(salted, ["__host", "__layout", "__salt"])
        asked = asked.select("__host", "__layout", "__html", "__refs")
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    fields = [c.split(" ", 1) for c in VOTE.split(", ")]
    names, types = [name for name, _ in fields], [kinds[k] for _, k in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[list[tuple[str, Block]], Shapes]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found, ends = [], [0]
                keys = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                for i, (key, page) in enumerate(zip(keys, part.column(2).to_pylist(), strict=True)):
                    if key not in known:
                        if len(known) >= 64:
                            known.clear()
                        references = shared.value[key] if small else part.column(3)[i].as_py()
                        trees = [(html, parse(html, words=False)[0][0]) for html in references]
                        known[key] = trees, Shapes([tree for _, tree in trees])
                    found.extend(votes(page, *known[key]))
                    ends.append(len(found))
                columns = zip(*found, strict=True) if found else [()] * len(names)
                rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)
                voted = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), voted], names=["__host", "__layout", "votes"])

    structs = ", ".join(f"{name}: {k}" for name, k in fields)
    voted = asked.mapInArrow(run, f"__host string, __layout long, votes array<struct<{structs}>>")
    voted = voted.select("__host", "__layout", F.inline("votes")).groupBy("__host", "__layout", "path", "node")
    sums = [F.sum(c).alias(c) for c in ("pages", "matched", "size", "below")]
    voted = stored(voted.agg(F.max("parent").alias("parent"), F.max("chain").alias("chain"), *sums), "votes")

    # Constant nodes of a host. Text that never matched is in no row, so no path gathers its texts in a task.
    paths, nodes = voted.where("node is null"), voted.where("node is not null")
    of_path = paths.groupBy("__host", "path").agg(F.sum("pages").alias("pages"))
    of_node = nodes.groupBy("__host", "path", "node").agg(F.sum("matched").alias("matched"))
    fixed = of_node.join(of_path, ["__host", "path"]).where(is_constant(F.col("matched"), F.col("pages")))
    fixed = stored(fixed.select("__host", "path", "node"), "constants")

    # The text of slots at and below each path of a layout: all text less the constants'.
    held = nodes.join(fixed, ["__host", "path", "node"], "left_semi")
    own = held.groupBy("__host", "__layout", "path").agg(F.sum("size").alias("own"))
    under = held.select("__host", "__layout", F.explode(F.array_distinct("chain")).alias("path"), "size")
    under = under.groupBy("__host", "__layout", "path").agg(F.sum("size").alias("under"))
    key = ["__host", "__layout", "path"]
    mass = paths.join(own, key, "left").join(under, key, "left").select(
        *key, "parent", (F.col("size") - F.coalesce("own", F.lit(0))).alias("slot"), (F.col("below") - F.coalesce("under", F.lit(0))).alias("mass")
    )
    mass = stored(mass, "mass")
    whole = mass.groupBy("__host", "__layout").agg(F.max("mass").alias("whole"))
    many = slim.groupBy("__host", "__layout").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ENOUGH).select("__host", "__layout")
    inner = mass.where("slot > 0").select("__host", "__layout", F.col("parent").alias("path")).distinct()
    region = mass.join(inner, key).join(whole, ["__host", "__layout"]).where((F.col("whole") > 0) & (F.col("mass") >= MOST * F.col("whole")))
    region = region.groupBy("__host", "__layout").agg(F.min(F.struct("mass", "path"))["path"].alias("region")).join(many, ["__host", "__layout"])
    regions = region.groupBy("__host").agg(F.array_sort(F.collect_set("region")).alias("regions"))
    constants = fixed.groupBy("__host").agg(F.array_sort(F.collect_set("node")).alias("constants"))
    return constants.join(regions, "__host", "full")


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with text, the main text of each page."""
    found = sized(templates(pages), F.coalesce(F.size("constants"), F.lit(0)) + F.coalesce(F.size("regions"), F.lit(0)) + 1)
    named = pages.select(*[pages[c] for c in keep], pages["html"].cast("string").alias("__html"), host(pages["url"]).alias("__host"))
    joined = named.join(found, "__host", "left").select(*keep, "__html", "constants", "regions")
    schema = ", ".join([*[f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep], "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[list[int] | None, frozenset[int]] = (None, frozenset())
        for batch in batches:
            texts = []
            for page, constants, regions in zip(*(batch.column(len(keep) + i).to_pylist() for i in range(3)), strict=True):
                if constants != last[0]:
                    last = (constants, frozenset(constants or ()))
                texts.append(extract(page, last[1], tuple(regions or ())) if page else "")
            own = batch.select(range(len(keep)))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string())], names=[*keep, "text"])

    return joined.mapInArrow(run, schema)
