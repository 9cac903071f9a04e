"""Jobs over tables of raw documents: feeds, pages, and tables in pages."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall.functions.text import comma_int, parse_rupees, reservation, without_footnotes, without_reservation

EXCERPT_CHARS, LEAST_PARAGRAPH = 2500, 60


#: Fixed value: the namespace of media elements in feeds.
MEDIA = "http://search.yahoo.com/mrss/"


def _name(e: ET.Element) -> tuple[str, str]:
    """The namespace and the name of an element."""
    space, _, name = e.tag.rpartition("}") if isinstance(e.tag, str) else ("", "", "")
    return space[1:], name


def _first(e: ET.Element, name: str, space: str | None = None) -> ET.Element | None:
    """The first child of a name; outside the media namespace unless one is given."""
    return next((c for c in e if _name(c)[1] == name and (_name(c)[0] == space if space else _name(c)[0] != MEDIA)), None)


def _text(e: ET.Element, name: str) -> str:
    c = _first(e, name)
    return "" if c is None else (c.text or "").strip()


def _image(e: ET.Element) -> str | None:
    for c in (_first(e, "content", MEDIA), _first(e, "thumbnail", MEDIA), _first(e, "enclosure")):
        url, kind = ("", "") if c is None else ((c.get("url") or "").strip(), c.get("type") or "")
        if url.startswith("http") and (not kind or kind.startswith("image/")):
            return url
    return None


def _entries(xml: str | None) -> Iterator[tuple[str, str, str | None, str | None]]:
    """title, url, published, image of the entries of one feed; a text that isn't XML has none."""
    try:
        root = ET.fromstring((xml or "").strip())
    except (ET.ParseError, ValueError):
        return
    items = [e for e in root.iter() if _name(e) == ("", "item")]
    for e in items or [e for e in root.iter() if _name(e)[1] == "entry"]:
        if items:
            guid = _text(e, "guid")
            url, when = _text(e, "link") or (guid if guid.startswith("http") else ""), _text(e, "pubDate")
        else:
            own = next((c for c in e if _name(c)[1] == "link" and c.get("rel") in (None, "alternate")), None)
            url, when = "" if own is None else (own.get("href") or "").strip(), _text(e, "published") or _text(e, "updated")
        yield " ".join(unescape(_text(e, "title")).split()), url, when or None, _image(e)


def _feeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, k, *entry) for i, xml in zip(pdf["feed_id"], pdf["xml"], strict=True) for k, entry in enumerate(_entries(xml)) if entry[0] and entry[1]]
        yield pd.DataFrame(rows, columns=["feed_id", "place", "title", "url", "published", "image"])


def feed_items(feeds: DataFrame) -> DataFrame:
    """feed_id, place, title, url, published, image of each entry of feeds (feed_id, xml): RSS items or, if there
    are none, Atom entries. Titles lose markup escapes and extra blanks; without a link an http guid takes its place, an
    Atom entry has its first alternate link; published comes before updated; an image is the first of media content,
    thumbnail and enclosure with an http address and an image type or none. Entries without title or url, and feeds
    that are null or no well-formed XML, give no rows, and don't touch the other feeds."""
    return feeds.select("feed_id", "xml").mapInPandas(_feeds, "feed_id long, place int, title string, url string, published string, image string")


class _Page(HTMLParser):
    """Collects paragraphs inside article, main, and the page, and the meta tags of previews."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = {"article": 0, "main": 0}
        self.found: dict[str, list[str]] = {"article": [], "main": [], "page": []}
        self.text: list[str] | None = None
        self.skip = 0
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in self.inside:
            self.inside[tag] += 1
        elif tag == "meta":
            a = dict(attrs)
            key = a.get("property") or a.get("name")
            if key in ("og:description", "og:image") and a.get("content"):
                self.meta.setdefault(key, " ".join(a["content"].split()))
        elif tag == "p":
            self.close_paragraph()
            self.text = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "p":
            self.close_paragraph()
        elif tag in self.inside:
            self.close_paragraph()
            self.inside[tag] = max(0, self.inside[tag] - 1)

    def handle_data(self, data):
        if self.text is not None and not self.skip:
            self.text.append(data)

    def close_paragraph(self):
        if self.text is None:
            return
        text, self.text = " ".join("".join(self.text).split()), None
        if text:
            self.found["page"].append(text)
            for where, n in self.inside.items():
                if n:
                    self.found[where].append(text)


def _paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for page_id, html in zip(pdf["page_id"], pdf["html"], strict=True):
            page = _Page()
            page.feed(html or "")
            page.close_paragraph()
            body = page.found["article"] or page.found["main"] or page.found["page"]
            rows.append((page_id, page.meta.get("og:description"), page.meta.get("og:image"), body))
        yield pd.DataFrame(rows, columns=["page_id", "description", "image", "paragraphs"])


def page_excerpts(pages: DataFrame) -> DataFrame:
    """page_id, excerpt, image: the preview description and the long paragraphs of the article, else of the main part,
    else of the page; each once, in order, cut to EXCERPT_CHARS. A null page has an empty excerpt."""
    parsed = pages.select("page_id", "html").mapInPandas(_paragraphs, "page_id long, description string, image string, paragraphs array<string>")
    long = F.filter("paragraphs", lambda p: F.length(p) > LEAST_PARAGRAPH)
    parts = F.array_distinct(F.array_compact(F.concat(F.array("description"), long)))
    return parsed.select("page_id", F.substring(F.array_join(parts, "\n"), 1, EXCERPT_CHARS).alias("excerpt"), "image")


def _span(value: str | None) -> int:
    """How many rows or columns a cell takes; one, if it doesn't say a number of at least one."""
    try:
        return max(1, int(value or 1))
    except ValueError:
        return 1


class _Tables(HTMLParser):
    """Cells of all tables with their spans, row by row; nested tables are tables of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.stack: list[int] = []
        self.cells: list[list | None] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.stack.append(len(self.tables) - 1)
            self.cells.append(None)
        elif self.stack and tag == "tr":
            self.tables[self.stack[-1]].append([])
            self.cells[-1] = None
        elif self.stack and tag in ("td", "th"):
            a = dict(attrs)
            rows = self.tables[self.stack[-1]]
            if not rows:
                rows.append([])
            self.cells[-1] = [[], _span(a.get("rowspan")), _span(a.get("colspan"))]
            rows[-1].append(self.cells[-1])

    def handle_endtag(self, tag):
        if self.stack and tag == "table":
            self.stack.pop()
            self.cells.pop()
        elif self.stack and tag in ("td", "th", "tr"):
            self.cells[-1] = None

    def handle_data(self, data):
        if self.cells and self.cells[-1] is not None:
            self.cells[-1][0].append(data)


def _cut(runs: list[list], start: int, end: int) -> list[list]:
    """Runs (from, to, text, rows left) without what lies between start and end."""
    out = []
    for a, b, *rest in runs:
        out += [[x, y, *rest] for x, y in ((a, min(b, start)), (max(a, end), b)) if x < y]
    return sorted(out, key=lambda r: r[0])


def dense(rows: list[list[list]]) -> list[list[tuple[int, int, str]]]:
    """The grid of a table, a row for each of its rows: runs (from column, to column, text). Spans repeat their text, as
    far as there are rows; columns that only a later span reaches over are empty.

    A span is one run however many columns it has, so no page makes more than its cells times its rows."""
    out: list[list[tuple[int, int, str]]] = []
    pending: list[list] = []
    for cells in rows:
        line: list[tuple[int, int, str]] = []
        left, col = list(pending), 0

        def passed(col: int, left: list[list], line: list[tuple[int, int, str]]) -> int:
            """Takes the runs from above that stand at col, and returns the first column without one."""
            nonlocal pending
            while (run := next((r for r in left if r[0] <= col < r[1]), None)) is not None:
                line.append((col, run[1], run[2]))
                pending = _cut(pending, col, run[1])
                if run[3] > 1:
                    pending = sorted([*pending, [col, run[1], run[2], run[3] - 1]], key=lambda r: r[0])
                col = run[1]
            return col

        for parts, down, across in cells:
            col = passed(col, left, line)
            text = " ".join("".join(parts).split())
            line.append((col, col + across, text))
            if down > 1:
                pending = sorted([*_cut(pending, col, col + across), [col, col + across, text, down - 1]], key=lambda r: r[0])
                left = _cut(left, col, col + across)
            col += across
        while (later := next((r for r in left if r[1] > col), None)) is not None:
            if later[0] > col:
                line.append((col, later[0], ""))
                col = later[0]
            col = passed(col, left, line)
        out.append(line)
    return out


#: Columns of a table that is laid out; a span can ask for any number of them.
GRID_COLUMNS = 16_384


def _grids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for page_id, html in zip(pdf["page_id"], pdf["html"], strict=True):
            parser = _Tables()
            parser.feed(html or "")
            for t, table in enumerate(parser.tables):
                grid = dense(table)
                width = max((run[1] for line in grid for run in line), default=0)
                if width > GRID_COLUMNS:
                    rows.append((page_id, t, None, 0, width, None))
                else:
                    rows += [(page_id, t, r, *run) for r, line in enumerate(grid) for run in line]
        frame = pd.DataFrame(rows, columns=["page_id", "tbl", "row", "first", "last", "text"])
        yield frame.astype({"row": "Int32"})


RUNS = "page_id long, tbl int, row int, first long, last long, text string"


def too_wide(pages: DataFrame) -> DataFrame:
    """page_id, tbl, columns of the tables that table_grid() leaves out, since they have more than GRID_COLUMNS columns."""
    return pages.select("page_id", "html").mapInPandas(_grids, RUNS).filter("row is null").select("page_id", "tbl", F.col("last").alias("columns"))


def table_grid(pages: DataFrame) -> DataFrame:
    """page_id, tbl, row, col, text: every cell of every table of the pages, spans resolved. A null page has none.

    A table of more than GRID_COLUMNS columns, which only a mistaken span makes, has none either: too_wide() reports it,
    and the page's other tables stay. Up to here a span is one run, whatever its width."""
    runs = pages.select("page_id", "html").mapInPandas(_grids, RUNS).filter("row is not null")
    return runs.select("page_id", "tbl", "row", F.explode(F.sequence("first", F.col("last") - 1)).alias("col"), "text").withColumn("col", F.col("col").cast("int"))


def table_select(grid: DataFrame, ids: DataFrame, columns: int = 6, least_share: float = 0.8, least_rows: int = 1) -> DataFrame:
    """page_id, tbl, col, covered: the table of each page whose column (one of the first) has the most of the known ids.

    Only the first row of an id counts, and so many of those rows have to hold a number of 1000 or more."""
    from pyspark.sql.window import Window

    number = F.regexp_replace("text", "[, ]", "").try_cast("bigint")
    big = grid.withColumn("n", number).groupBy("page_id", "tbl", "row").agg(F.max("n").alias("most"))
    found = grid.filter(F.col("col") < columns).join(ids, F.col("text") == F.col("id")).select("page_id", "tbl", "row", "col", "id")
    first = found.groupBy("page_id", "tbl", "col", "id").agg(F.min("row").alias("row")).join(big, ["page_id", "tbl", "row"])
    scored = first.groupBy("page_id", "tbl", "col").agg(F.count("*").alias("covered"), F.avg(F.when(F.col("most") >= 1000, 1.0).otherwise(0.0)).alias("share"))
    order = Window.partitionBy("page_id").orderBy(F.desc("covered"), "tbl", "col")
    fit = scored.filter((F.col("share") >= least_share) & (F.col("covered") >= least_rows))
    return fit.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("page_id", "tbl", "col", "covered")


def positional(cells: Column, number: Column) -> Column:
    """name, party, votes of a results row, by their distance from the first of its first four cells that holds the row's number.

    The row is: number, place, name, colour, party, votes. Where the colour's cell is missing, what follows stands one
    cell earlier. Null without the number, under seven cells from it on, without votes, or without a name."""
    at = F.array_position(F.transform(F.slice(cells, 1, 4), lambda c: F.coalesce(comma_int(c) == number, F.lit(False))), True).cast("int")
    cell = lambda k: F.try_element_at(cells, at + k)
    whole = comma_int(cell(5)).isNotNull()
    name, party, votes = without_footnotes(cell(2)), without_footnotes(F.when(whole, cell(4)).otherwise(cell(3))), F.when(whole, comma_int(cell(5))).otherwise(comma_int(cell(4)))
    there = (at > 0) & (F.size(cells) >= at + 6) & votes.isNotNull() & (name != "")
    return F.when(there, F.struct(name.alias("name"), party.alias("party"), votes.alias("votes")))


def listing_rows(pages: DataFrame) -> DataFrame:
    """candidate_id, name, seat, party, cases, education, assets, liabilities of the rows of listings (page_id, html).

    A row counts if it links to a candidate and has eight cells; cases that are no number are 0, money is what stands
    after "Rs". Of several rows of a page with one candidate the last one counts."""
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td\b[^>]*>(.*?)(?=</?t[dr]\b|$)"), F.lit(1)), _plain)
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b.*?(?=</?tr\b|</table|$)"), F.lit(0))).alias("place", "tr"))
    rows = each.select("page_id", "place", F.regexp_extract("tr", r"(?i)href=[^>]*candidate_id=(\d+)", 1).try_cast("bigint").alias("candidate_id"), cells.alias("c")).filter("candidate_id is not null and size(c) >= 8")
    last = rows.groupBy("page_id", "candidate_id").agg(F.max_by("c", "place").alias("c"))
    at = lambda k: F.element_at("c", k + 1)
    return last.select(
        "candidate_id", at(1).alias("name"), at(2).alias("seat"), at(3).alias("party"), F.when(at(4).rlike(r"^\d+$"), F.coalesce(at(4).try_cast("bigint"), F.lit(0))).otherwise(0).alias("cases"),
        at(5).alias("education"), parse_rupees(at(6)).alias("assets"), parse_rupees(at(7)).alias("liabilities"),
    )


def _plain(html: Column) -> Column:
    """The text of a piece of markup: without tags, five escapes and hard blanks resolved, blanks collapsed."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, mark in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(mark))
    return F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))


def attribute_rows(attributes: DataFrame, region: str) -> DataFrame:
    """number, name, reserved, district of the attribute rows (state, number, name, district) of a state, in any case:
    the reservation stands apart from the name."""
    rows = attributes.filter(F.upper(F.trim("state")) == region.upper())
    return rows.select("number", without_reservation("name").alias("name"), reservation("name").alias("reserved"), F.initcap(F.trim("district")).alias("district"))


def series_points(payloads: DataFrame, values: list[str], only: str | None = None) -> DataFrame:
    """district, year and the values of each row of landed series payloads (year, json: a list of rows under "data"); only the
    rows of that caste id, if one is given, since others are parts of it. Payloads without data give none."""
    row = "struct<districtName:string,casteId:string," + ",".join(f"{v}:bigint" for v in values) + ">"
    each = payloads.select("year", F.explode(F.from_json("json", f"data array<{row}>")["data"]).alias("r"))
    kept = each if only is None else each.filter(F.col("r.casteId") == only)
    return kept.select(F.col("r.districtName").alias("district"), "year", *(F.col(f"r.{v}").alias(v) for v in values))


def well_formed(cells: Column, width: int, key: Column, first: int, last: int) -> Column:
    """Whether a row has as many cells as its header, none with a stray pipe, and an id in its range."""
    ok = (F.size(cells) == width) & ~F.exists(cells, lambda c: F.contains(c, F.lit("|"))) & F.trim(key).try_cast("int").between(first, last)
    return F.coalesce(ok, F.lit(False))


def largest_votes(cells: Column, least: int = 10_000) -> Column:
    """The largest number of a row's cells behind the second, from `least` on: an alliance's votes; null without one."""
    votes = F.filter(F.transform(F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(0))), comma_int), lambda v: v >= least)
    return F.array_max(votes)


def anchored(cells: Column, value: Column) -> Column:
    """The two text cells before the first cell that holds a number, nearest first; null without it."""
    plain = F.transform(cells, lambda c: F.regexp_replace(c, "[, ]", ""))
    at = F.array_position(plain, value.cast("string"))
    words = F.filter(F.slice(cells, 1, F.greatest(at.cast("int") - 1, F.lit(0))), lambda c: c.rlike(r"\p{L}"))
    return F.when(at > 0, F.slice(F.reverse(words), 1, 2))


def column_calibration(grid: DataFrame, known: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """party, col: the first column that holds the known names (party, row_id, name) of a party: three present, 80 % right."""
    cells = grid.select(F.col("row_id"), F.posexplode("cells").alias("col", "text"))
    tried = known.join(cells, "row_id").groupBy("party", "col").agg(F.count("*").alias("n"), F.avg(F.when(F.col("text") == F.col("name"), 1.0).otherwise(0.0)).alias("right"))
    return tried.filter((F.col("n") >= least) & (F.col("right") >= share)).groupBy("party").agg(F.min("col").alias("col"))


def portfolio_split(cells: DataFrame) -> DataFrame:
    """person_id, department, subjects of ministers' cells (person_id, position, names: link titles, text).

    With links each title is a department; a text that only says the position again stays one entry; any other is
    split at commas. Subjects of one department named twice are put together, each once, in order."""
    split = F.transform(F.split("text", ","), lambda t: F.trim(t))
    echo = F.lower(F.trim("text")) == F.lower(F.trim("position"))
    names = F.when(F.size("names") > 0, F.col("names")).when(echo, F.array("text")).otherwise(split)
    each = cells.select("person_id", F.posexplode(names).alias("place", "department"), "text").filter("department <> ''")
    placed = each.groupBy("person_id", "department").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("s"))
    return placed.select("person_id", "department", F.array_join(F.array_distinct("s.text"), "; ").alias("subjects"))


def bindings_collapse(bindings: DataFrame) -> DataFrame:
    """item, label, districts, ordinals: one record for each item of query bindings (item, place, label, dist, ord), the last label."""
    return bindings.groupBy("item").agg(F.max_by("label", "place").alias("label"), F.array_join(F.array_sort(F.collect_set("dist")), ",").alias("districts"), F.array_join(F.transform(F.array_sort(F.collect_set("ord")), lambda o: o.cast("string")), ",").alias("ordinals"))


def registry_load(spark, path: str, unique: str, schema: str) -> DataFrame:
    """Rows of a JSON registry (an array of objects in one file) of a schema, with n, how often the unique key stands there."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.join(rows.groupBy(unique).agg(F.count("*").alias("n")), unique)
