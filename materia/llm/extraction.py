"""Main text of web pages, by wrappers inferred from the pages of each host.

A page is read as a stream of block tags and text slots (#). Streams of one
host are aligned into a union-free expression over the same tokens: elements
that both have are aligned inside, what only one has becomes optional, what
repeats becomes a repeated element or a repeated group, and texts become slots.
The expression is the host's wrapper, its slots are its fields. Reading a page
along the wrapper gives each of its texts a field; a field, not a page, is
judged to be content or not, and the text of a page is what lies in content
fields. Evidence on a field: the tags and names it stands in, the share of its
characters in links, and whether the host's pages all say the same there (of
equal pages only one counts).

Alignment is a tree of merges of at most ``MERGE`` expressions each, so that one
large host is no single task's work. An element with more than ``WIDE`` kinds of
content in a row is generalised to a repeated group of optional elements, which
takes any page.

Defined results: a null or empty page has the empty text; a null url is a host
of its own; repeated rows come out repeated; ties between alignments go to the
earlier element; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from materia.llm.common import add_from_text, shared_table

#: Expressions that one task aligns at once.
MERGE = 64
#: Elements in a row that are kept apart in an expression.
WIDE = 40
#: Most bytes of all hosts' fields that are broadcast; their size is measured.
BROADCAST_BYTES = 8_000_000

# Tag names by what they do here.
_RAW = "script|style|template|noscript|textarea|iframe|svg|title|math"
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER = frozenset("nav footer aside form menu dialog button select option head search fieldset".split())
_CLOSES_P = _BLOCKS - frozenset("body html head".split())
_BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|banners?|breadcrumbs?|comments?|consent|cookies?|discussion|disqus|footer|gdpr|header|login|masthead|"
    r"menus?|modal|nav|navbar|navigation|newsletter|notices?|notifications?|pagination|popup|promos?|promoted|related|replies|responses?|share|sharing|"
    r"sidebars?|skip|social|sponsor(?:ed|s)?|subscribe|toolbar|topbar|widgets?)(?:$|[\s_-])",
    re.IGNORECASE,
)
_MAIN_NAME = re.compile(
    r"(?:^|[\s_-])(?:article|article-body|articlebody|content|entry|entry-content|main|main-content|post|post-body|post-content|story)(?:$|\s)", re.IGNORECASE
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_UNSAFE = re.compile(r"[^\w.-]")

class _Node:
    __slots__ = ("boiler", "label", "main", "name")

    def __init__(self, name: str, label: str, boiler: bool, main: bool) -> None:
        self.name, self.label, self.boiler, self.main = name, label, boiler, main


def _kind(name: str, attributes: str, inside_main: bool) -> tuple[str, bool, bool]:
    """Label of an element (name, first class, ! or * for what its names suggest), whether it may be boilerplate, whether a main region."""
    found = {k.lower(): next((x for x in v if x), "") for k, *v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    role = found.get("role", "").lower()
    boiler = name in _BOILER or "hidden" in found and "aria" not in attributes.lower() or found.get("aria-hidden", "").lower() == "true"
    boiler = boiler or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form")
    boiler = boiler or name not in ("article", "main", "body", "html") and bool(_BOILER_NAME.search(names))
    if name == "header" and not boiler:
        boiler = not inside_main
    main = not boiler and (name in ("article", "main") or role in ("main", "article") or name in ("div", "section", "td") and bool(_MAIN_NAME.search(names)))
    first = _UNSAFE.sub("_", next(iter(found.get("class", "").split()), "").lower())
    return name + (f".{first}" if first else "") + ("!" if boiler else "*" if main else ""), boiler, main


def parse(page: str | None) -> tuple[list[str], list[tuple[str, int]]]:
    """Stream of block tags, text slots (#) and ends (/), and for each slot its text and the characters of it in links."""
    page = page or ""
    stream: list[str] = []
    blocks: list[tuple[str, int]] = []
    stack: list[_Node] = []
    words: list[str] = []
    links = [0, 0]  # open a tags, characters in them

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(words)).strip()
        words.clear()
        if text:
            blocks.append((text, links[1]))
            stream.append("#")
        links[1] = 0

    def close(to: int) -> None:
        flush()
        while len(stack) > to:
            stack.pop()
            stream.append("/")

    def text(part: str) -> None:
        if part:
            words.append(entities.unescape(part))
            if links[0]:
                links[1] += len(part.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        name, closing = m[3].lower(), bool(m[2])
        if name == "a":
            links[0] = max(0, links[0] + (-1 if closing else 1))
        if name == "br":
            words.append("\n")
        if name not in _BLOCKS:
            continue
        if closing:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if place is not None:
                close(place)
            else:
                flush()
            continue
        flush()
        if name in ("hr",) or m[4].endswith("/") and name in _VOID:
            continue
        if stack and name in _CLOSES_P and stack[-1].name == "p":
            close(len(stack) - 1)
        for same in ("li", "td", "th", "tr", "dd", "dt"):
            if name == same and stack and stack[-1].name == same:
                close(len(stack) - 1)
        label, boiler, main = _kind(name, m[4], any(n.main for n in stack))
        if name in ("article", "main"):  # an unclosed notice before it doesn't hold it
            place = next((i for i, n in enumerate(stack) if n.boiler and n.name not in ("form",)), None)
            if place is not None and not any(n.main for n in stack[:place]):
                close(place)
        stack.append(_Node(name, label, boiler, main))
        stream.append(label)
    text(page[at:])
    close(0)
    return stream, blocks


def _deep() -> None:
    """Elements may be nested deeper than functions usually are."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


class Item:
    """A part of an expression: an element (its label), a text slot ("#") or a group ("("), which may repeat or be absent."""

    __slots__ = ("items", "label", "optional", "repeats")

    def __init__(self, label: str, items: list[Item] | None = None, repeats: bool = False, optional: bool = False) -> None:
        self.label, self.items, self.repeats, self.optional = label, items or [], repeats, optional

    def sign(self) -> str:
        return "(" + " ".join(x.sign() for x in self.items) + ")" if self.label == "(" else self.label


def write(items: list[Item]) -> str:
    """Tokens of an expression: ``label`` opens an element and ``/`` ends it, ``(`` and ``)`` hold a group; + repeats, ? is optional."""
    out: list[str] = []

    def put(row: list[Item]) -> None:
        for x in row:
            out.append(x.label + "+" * x.repeats + "?" * x.optional)
            if x.label != "#":
                put(x.items)
                out.append(")" if x.label == "(" else "/")

    put(items)
    return " ".join(out)


def read(expression: str) -> list[Item]:
    rows: list[list[Item]] = [[]]
    for token in expression.split():
        if token in ("/", ")"):
            if len(rows) > 1:
                rows.pop()
            continue
        bare = token.rstrip("+?")
        item = Item(bare, [], "+" in token[len(bare) :], "?" in token[len(bare) :])
        rows[-1].append(item)
        if bare != "#":
            rows.append(item.items)
    return rows[0]


def _group_places(signs: list[str], group: list[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of whole copies of ``group``."""
    at, k = 0, len(group)
    while at + k <= len(signs):
        end = at
        while signs[end : end + k] == group:
            end += k
        if end > at:
            yield at, end
        at = max(end, at + 1)


def _joined(parts: list[list[Item]]) -> list[Item]:
    """Rows of equal signs aligned place by place."""
    first = parts[0]
    for row in parts[1:]:
        first = [_merged(a, b) for a, b in zip(first, row, strict=True)]
    return first


def _grouped(items: list[Item], group: list[str]) -> list[Item]:
    """``items`` with each run of copies of ``group`` as one repeated group."""
    signs, k, out, done = [x.sign() for x in items], len(group), [], 0
    for at, end in _group_places(signs, group):
        out += items[done:at]
        out.append(Item("(", _joined([items[i : i + k] for i in range(at, end, k)]), True))
        done = end
    return out + items[done:]


def fold(items: list[Item]) -> list[Item]:
    """A row with its repeats found: neighbours of one label, then groups that follow themselves."""
    out: list[Item] = []
    for x in items:
        if out and out[-1].sign() == x.sign():
            both = _merged(out[-1], x)
            both.repeats, both.optional = True, out[-1].optional and x.optional
            out[-1] = both
        else:
            out.append(x)
    if len(out) > WIDE:
        return _any_of(out)
    at = 0
    while at < len(out):
        signs = [x.sign() for x in out]
        size = next((k for k in range(2, (len(out) - at) // 2 + 1) if signs[at : at + k] == signs[at + k : at + 2 * k]), 0)
        if size:
            out = out[:at] + _grouped(out[at:], signs[at : at + size])
        at += 1
    return out


def _any_of(items: list[Item]) -> list[Item]:
    """A repeated group of all that the row holds, each once and optional."""
    kinds: dict[str, Item] = {}

    def put(row: list[Item]) -> None:
        for x in row:
            if x.label == "(":
                put(x.items)
            else:
                known = kinds.get(x.label)
                kinds[x.label] = _merged(known, x) if known else Item(x.label, x.items, True, True)
                kinds[x.label].repeats = kinds[x.label].optional = True

    put(items)
    return [Item("(", list(kinds.values()), True)]


def _merged(a: Item, b: Item) -> Item:
    return Item(a.label, merge(a.items, b.items), a.repeats or b.repeats, a.optional or b.optional)


def merge(a: list[Item], b: list[Item]) -> list[Item]:
    """The least general row that takes what ``a`` and what ``b`` take: equal signs are aligned, all else is optional."""
    for x in [x for x in a if x.label == "("]:
        b = _grouped(b, [y.sign() for y in x.items])
    for x in [x for x in b if x.label == "("]:
        a = _grouped(a, [y.sign() for y in x.items])
    left, right = [x.sign() for x in a], [x.sign() for x in b]
    head = 0
    while head < min(len(a), len(b)) and left[head] == right[head]:
        head += 1
    # longest common part of what is left, from the end
    n, m = len(a) - head, len(b) - head
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[head + i] == right[head + j] else max(best[i + 1][j], best[i][j + 1])
    out = [_merged(x, y) for x, y in zip(a[:head], b[:head], strict=True)]
    absent = lambda x: Item(x.label, x.items, x.repeats, True)
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and left[head + i] == right[head + j]:
            out.append(_merged(a[head + i], b[head + j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(absent(a[head + i]))
            i += 1
        else:
            out.append(absent(b[head + j]))
            j += 1
    return fold(out)


def expression_of(stream: list[str]) -> str:
    """A page's own expression: its stream with all repeats found."""
    _deep()
    rows: list[list[Item]] = [[]]
    opened: list[Item] = []
    for token in stream:
        if token == "/":
            row = rows.pop()
            item = opened.pop()
            item.items = fold(row)
        else:
            item = Item(token)
            rows[-1].append(item)
            if token != "#":
                opened.append(item)
                rows.append([])
    return write(fold(rows[0]))


def wrapper_of(expressions: list[str]) -> str:
    """One expression for all, aligned longest first, then in order."""
    _deep()
    found: list[Item] | None = None
    for text in sorted(set(expressions), key=lambda s: (-len(s), s)):
        found = read(text) if found is None else merge(found, read(text))
    return write(found or [])


class Wrapper:
    """Reads streams along an expression; steps are found once and remembered."""

    def __init__(self, expression: str) -> None:
        _deep()
        self.rows: list[list[tuple[str, int, bool, tuple[int, int] | None]]] = []  # label, row inside or field, repeats, group
        self.paths: list[str] = []
        self.steps: dict[tuple[int, int, str], tuple[int, int, int] | None] = {}
        self.places: list[tuple[str, ...]] = []  # the path of each row
        self.alike: dict[tuple[str, ...], list[int]] = {}  # rows of each path
        self._row(read(expression), ())

    def _row(self, items: list[Item], path: tuple[str, ...]) -> int:
        number = len(self.rows)
        self.rows.append([])
        self.places.append(path)
        self.alike.setdefault(path, []).append(number)
        row: list[tuple[str, int, bool, tuple[int, int] | None]] = []

        def put(part: list[Item], group: tuple[int, int] | None) -> None:
            for x in part:
                if x.label == "(":
                    size = _leaves(x.items)
                    put(x.items, (len(row), len(row) + size))
                elif x.label == "#":
                    self.paths.append("/".join(path))
                    row.append((x.label, len(self.paths) - 1, x.repeats, group))
                else:
                    at = len(row)
                    row.append((x.label, -1, x.repeats, group))
                    row[at] = (x.label, self._row(x.items, (*path, x.label)), x.repeats, group)

        put(items, None)
        self.rows[number] = row
        return number

    def _step(self, number: int, at: int, label: str) -> tuple[int, int, int] | None:
        """(row, place after, row inside or field) of the next ``label``: ahead in the group, again in the group, ahead,
        anywhere in the row; or in another row of the same path, if this one was taken for it too early."""
        row = self.rows[number]
        group = (row[at][3] if at < len(row) else None) or (row[at - 1][3] if at else None)
        order = [*range(at, len(row))]
        if group:
            order = [*range(at, group[1]), *range(group[0], min(at, group[1])), *range(group[1], len(row))]
        for other in [number, *self.alike[self.places[number]]]:
            row = self.rows[other]
            for k in [*(order if other == number else []), *range(len(row))]:
                if row[k][0] == label:
                    return other, k if row[k][2] else k + 1, row[k][1]
        return None

    def fields(self, stream: list[str]) -> list[int]:
        """The field of each slot of a stream; -1 where the expression has none."""
        out: list[int] = []
        places = [[0, 0]]  # row, place in it; row -1: not in the expression
        for token in stream:
            if token == "/":
                if len(places) > 1:
                    places.pop()
                continue
            row, at = places[-1]
            key = (row, at, token)
            if key not in self.steps:
                self.steps[key] = self._step(*key) if row >= 0 else None
            step = self.steps[key]
            if step:
                places[-1][:] = step[:2]
            if token == "#":
                out.append(step[2] if step else -1)
            else:
                places.append([step[2] if step else -1, 0])
        return out


def _leaves(items: list[Item]) -> int:
    return sum(_leaves(x.items) if x.label == "(" else 1 for x in items)


def infer(parsed: DataFrame) -> DataFrame:
    """(host, wrapper) from the distinct expressions of the pages of each host."""

    def run(rows: pa.Table) -> pa.Table:
        return pa.table({"host": rows.column("host").slice(0, 1), "wrapper": pa.array([wrapper_of(rows.column("wrapper").to_pylist())], pa.string())})

    made = shared_table(parsed.select("host", F.col("expression").alias("wrapper")).distinct(), "expressions")
    parts = -(-max(1, made.count()) // MERGE)
    while True:
        group = F.pmod(F.xxhash64("wrapper"), F.lit(parts))
        made = made.withColumn("part", group).groupBy("host", "part").applyInArrow(run, "host string, wrapper string")
        if parts == 1:
            return made
        parts = -(-parts // MERGE)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _fields(streams: pa.Array, wrappers: pa.Array) -> pa.Array:
    known: dict[str, Wrapper] = {}
    out = []
    for stream, wrapper in zip(streams.to_pylist(), wrappers.to_pylist(), strict=True):
        if wrapper not in known:
            known[wrapper] = Wrapper(wrapper or "")
        out.append(known[wrapper].fields(stream.split()))
    return pa.array(out, pa.list_(pa.int32()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _paths(wrappers: pa.Array) -> pa.Array:
    return pa.array([Wrapper(w or "").paths for w in wrappers.to_pylist()], pa.list_(pa.string()))


def content_fields(parsed: DataFrame, wrappers: DataFrame, least_pages: int = 3) -> DataFrame:
    """(host, wrapper, main, other): numbers of the fields that hold content, in main regions and elsewhere.

    ``parsed`` has host, fields (of its texts) and marks (hash, length, characters in links of each text). By its
    path a field is boilerplate, main or neither. A field of links has half its characters in them; a field of one
    text has the same one on half the different pages, of ``least_pages`` at least. Boilerplate is out; a main field
    is out if it is one of links and of one text; any other, if it is either.
    """
    pages = parsed.select("host", "fields", "marks", F.xxhash64("marks").alias("page"))
    texts = pages.select("host", "page", F.explode(F.arrays_zip("fields", "marks")).alias("t"))
    texts = texts.select("host", "page", F.col("t.fields").alias("field"), "t.marks.*").distinct()
    texts = texts.groupBy("host", "field", "mark").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("linked").alias("linked"))
    seen = texts.groupBy("host", "field").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum("size").alias("size"), F.sum("linked").alias("linked"))
    named = wrappers.select("host", F.posexplode(_paths("wrapper")).alias("field", "path"))
    links = F.col("linked") * 2 >= F.col("size")
    same = (F.col("n") >= least_pages) & (F.col("top") > 1) & (F.col("top") * 2 >= F.col("n"))
    boiler, main = F.col("path").contains("!"), F.col("path").contains("*")
    judged = named.join(seen, ["host", "field"]).filter(~boiler & ~F.when(main, links & same).otherwise(links | same))
    kept = judged.groupBy("host").agg(F.collect_set(F.when(main, F.col("field"))).alias("main"), F.collect_set(F.when(~main, F.col("field"))).alias("other"))
    return wrappers.join(kept, "host", "left")


def parse_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, host, stream, expression, and blocks (text, characters in links) of each page, written once."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("linked", pa.int64())]))

    def make():
        def run(texts):
            found = [parse(t) for t in texts]
            blocks = [[{"text": t, "linked": n} for t, n in b] for _, b in found]
            return [pa.array([" ".join(s) for s, _ in found], pa.string()), pa.array([expression_of(s) for s, _ in found], pa.string()), pa.array(blocks, kind)]

        return run

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = add_from_text(rows, "html", make, "stream string, expression string, blocks array<struct<text: string, linked: bigint>>").drop("html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return shared_table(parsed.withColumn("host", host), "parsed")


def _with_wrappers(parsed: DataFrame, wrappers: DataFrame, limit: int) -> DataFrame:
    """Pages joined to what is known of their host: broadcast while all hosts together are at most ``limit`` bytes."""
    sizes = [F.coalesce(F.length(c), F.lit(0)) if t == "string" else 4 * F.greatest(F.size(c), F.lit(0)) for c, t in wrappers.dtypes]
    size = wrappers.agg(F.sum(sum(sizes, F.lit(64)))).first()[0] or 0
    return parsed.join(F.broadcast(wrappers) if size <= limit else wrappers, "host", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text (blocks in page order, one line each), wrapper of the host."""
    parsed = parse_pages(pages, id_col, url_col, html_col)
    return read_along(parsed, shared_table(infer(parsed), "wrappers"), broadcast_bytes)


def read_along(parsed: DataFrame, wrappers: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, wrapper of parsed pages, by the wrappers (host, wrapper) alone."""
    fields = _fields("stream", "wrapper").alias("fields")
    marks = F.transform("blocks", lambda b: F.struct(F.xxhash64(b.text).alias("mark"), F.length(b.text).alias("size"), b.linked.alias("linked")))
    marked = _with_wrappers(parsed, wrappers, broadcast_bytes).select("host", fields, marks.alias("marks"))
    known = shared_table(content_fields(marked, wrappers), "fields")
    read = _with_wrappers(parsed, known, broadcast_bytes).select("page_id", "url", "blocks", "wrapper", "main", "other", fields)
    within = lambda kept: F.filter(F.arrays_zip("fields", "blocks"), lambda x: F.array_contains(F.coalesce(kept, F.array().cast("array<int>")), x.fields))
    main, other = within("main"), within("other")
    text = F.array_join(F.transform(F.when(F.size(main) > 0, main).otherwise(other), lambda x: x.blocks.text), "\n")
    return read.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"), "wrapper")
