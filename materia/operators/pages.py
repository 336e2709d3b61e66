"""Web pages to titles, main content, events (headings and texts in order), sections and records."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from materia.functions import text as X
from materia.sources.shared import small_batches

# Tags without content of the page, hints of a content container, headings that end it.
NOISE = frozenset("script style noscript svg header footer nav form button iframe".split())
HINTS = ("content", "article", "detail", "post", "entry", "document")
STOP_HEADINGS = (
    "so sanh", "su khac biet", "paracetamol va ibuprofen", "tai lieu tham khao", "bai viet lien quan", "san pham lien quan", "cau hoi thuong gap", "giai dap cac thac mac",
)
IGNORED_BEFORE = ("duoc si lam sang", "uoc tinh:", "ngay dang:", "cap nhat:", "neu phat hien noi dung khong chinh xac")
SIGNALS = ("ten chung quoc te", "ma atc", "chi dinh", "chong chi dinh", "than trong", "lieu luong va cach dung", "tuong tac thuoc", "tac dung khong mong muon")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TEXT = ("p", "li")
_HEADINGS = ("h2", "h3", "h4")
_CLOSES_P = frozenset("article blockquote details div dl h1 h2 h3 h4 h5 h6 main ol p section table ul".split())
_EVENT = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])
PARSED = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("main_text", T.StringType()), T.StructField("events", T.ArrayType(_EVENT)), T.StructField("table_rows", T.IntegerType()),
])


class _Tree(HTMLParser):
    """Elements as [name, hint, children]; what noise tags hold is dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", "", []]
        self.open = [self.root]
        self.noise: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.noise or tag in NOISE:
            if tag not in _VOID:
                self.noise.append(tag)
            return
        if tag in _CLOSES_P:  # a paragraph ends here, with what inline tags it left open
            at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == "p" or self.open[i][0] in _CLOSES_P), 0)
            if at and self.open[at][0] in ("p", *(_HEADINGS if tag in _HEADINGS else ())):
                del self.open[at:]
        if tag in ("li", "td", "th", "tr") and self.open[-1][0] == tag:
            self.open.pop()
        known = dict(attrs)
        node = [tag, f"{known.get('id') or ''} {known.get('class') or ''}".lower(), []]
        self.open[-1][2].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if self.noise:
            if tag in self.noise:
                del self.noise[len(self.noise) - 1 - self.noise[::-1].index(tag) :]
            return
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not self.noise:
            self.open[-1][2].append(data)


def _text(node: list | str) -> str:
    if isinstance(node, str):
        return node
    return " ".join(_text(c) for c in node[2])


def _clean(s: str) -> str:
    return " ".join(s.split())


def _all(node: list) -> list[list]:
    out = []
    for c in node[2]:
        if not isinstance(c, str):
            out += [c, *_all(c)]
    return out


def _rows(table: list) -> list[str]:
    """Rows a | b | c; a cell's own text is read without the tables nested in it."""

    def own(cell: list) -> str:
        return _clean(" ".join(c if isinstance(c, str) else own(c) for c in cell[2] if isinstance(c, str) or c[0] not in ("table", "tr", "td", "th")))

    def cells(row: list) -> list[list]:
        return [x for c in row[2] if not isinstance(c, str) and c[0] != "tr" for x in ([c] if c[0] in ("td", "th") else []) + cells(c)]

    return [line for r in _all(table) if r[0] == "tr" and (line := " | ".join(t for c in cells(r) if (t := own(c))))]


def _events(node: list, out: list[tuple[str, str]]) -> int:
    """Headings and texts below ``node``, none read twice; the number of table rows among them."""
    rows, words = 0, []

    def flush() -> None:
        if value := _clean(" ".join(words)):
            out.append(("text", value))
        words.clear()

    for child in node[2]:
        if isinstance(child, str):
            if node[0] in _TEXT:
                words.append(child)
        elif child[0] in _HEADINGS:
            flush()
            out.append(("heading", _clean(_text(child))))
        elif child[0] == "table":
            flush()
            found = _rows(child)
            rows += len(found)
            out.extend(("text", r) for r in found)
        elif child[0] in _CLOSES_P or child[0] == "li" or any(x[0] in (*_HEADINGS, *_TEXT, "table", "ul", "ol") for x in _all(child)):
            flush()
            rows += _events(child, out)
        elif node[0] in _TEXT:
            words.append(_text(child))
    flush()
    return rows


def parse_page(html: str | None) -> dict:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = _all(tree.root)
    title = next((t for tag in ("h1", "title") for n in nodes if n[0] == tag and (t := _clean(_text(n)))), None)
    tiers = (
        [n for n in nodes if n[0] == "article"], [n for n in nodes if n[0] == "main"],
        [n for n in nodes if n[0] == "div" and any(h in n[1] for h in HINTS)], [n for n in nodes if n[0] == "body"],
    )
    for tier in tiers:
        sized = [(len(t), -i, t, n) for i, n in enumerate(tier) if len(t := _clean(_text(n))) >= 100]
        if sized:
            _, _, text, node = max(sized, key=lambda x: x[:2])
            events: list[tuple[str, str]] = []
            rows = _events(node, events)
            return {"title": title, "main_text": text, "events": [{"pos": i, "kind": k, "text": t} for i, (k, t) in enumerate(events)], "table_rows": rows}
    return {"title": title, "main_text": None, "events": [], "table_rows": 0}


@F.pandas_udf(PARSED)
def parse_py(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(h) for h in html], columns=["title", "main_text", "events", "table_rows"])


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, main_text, events, table_rows). A worker holds a small batch of pages and what is made of them at a time."""
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", parse_py("html").alias("p")).select("page_id", "url", "p.*")


def events(parsed_pages: DataFrame) -> DataFrame:
    return parsed_pages.select("page_id", F.inline("events"))


def section_lines(rows: DataFrame) -> DataFrame:
    """Text events with the key of the last heading before them, up to the first stop heading.

    A text equal to the one before it under the same key goes; before the first
    heading so do the lines every page has.
    """
    so_far = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    folded = X.fold(F.col("text"))
    has = lambda phrases: F.coalesce(folded.rlike("|".join(phrases)), F.lit(False))
    heading = F.col("kind") == "heading"
    rows = rows.withColumns({
        "key": F.last(F.when(heading, X.heading_key(F.col("text"))), ignorenulls=True).over(so_far),
        "stopped": F.max(heading & has(STOP_HEADINGS)).over(so_far),
    })
    rows = rows.filter("not stopped and kind = 'text'").filter(F.col("key").isNotNull() | ~has(IGNORED_BEFORE))
    rows = rows.withColumn("key", F.coalesce("key", F.lit("mo_ta_chung")))
    before = F.lag("text").over(Window.partitionBy("page_id", "key").orderBy("pos"))
    return rows.withColumn("again", F.coalesce(before == F.col("text"), F.lit(False))).filter("not again").select("page_id", "key", "pos", "text")


def sections(rows: DataFrame) -> DataFrame:
    """One row per page and key, lines in order."""
    lines = section_lines(rows).groupBy("page_id", "key").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    return lines.select("page_id", F.col("key").alias("section"), F.array_join(F.transform("l", lambda x: x.text), "\n").alias("text"))


def records(pages: DataFrame) -> DataFrame:
    """Every page with its sections, and the first reason why it isn't a record, if any."""
    p = parsed(pages)
    made = sections(events(p)).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "text"))).alias("sections"))
    joined = p.drop("events").join(made, "page_id", "left")
    folded = X.fold(F.col("main_text"))
    signals = sum((F.coalesce(F.contains(folded, F.lit(s)), F.lit(False)).cast("int") for s in SIGNALS), F.lit(0))
    reason = (
        F.when(F.col("main_text").isNull(), "parse_error").when(F.coalesce("title", F.lit("")) == "", "missing_title").when(F.length("main_text") <= 500, "content_too_short")
        .when(signals < 2, "not_enough_medical_signals").when(F.coalesce(F.size("sections"), F.lit(0)) < 2, "too_few_sections")
    )
    return joined.select("page_id", "url", "title", X.updated_at(F.col("main_text")).alias("updated_at"), "sections", "table_rows", signals.alias("signals"), reason.alias("reason"))
