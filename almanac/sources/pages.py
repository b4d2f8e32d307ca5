"""Rows, links and hidden content out of a table of stored web pages (``page_id``, ``url``, ``html``).

All of it is Spark's own regular expressions per page; a page never leaves its row.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, Observation, functions as F

from almanac.functions.scalars import number
from almanac.operators.joins import matching_rows

_TAGS = r"(?s)<[^>]*>"

# Character references by name, and the largest spans that browsers allow.
_REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…",
               "copy": "©", "middot": "·", "amp": "&"}
MOST_COLUMNS_SPANNED, MOST_ROWS_SPANNED = 1000, 65534


def element_content(html: Column, tag: str, element_id: str) -> Column:
    """The content of the first element of that tag and id; null if there is none."""
    pattern = rf"(?is)<{tag}\s[^>]*id=[\"']?{re.escape(element_id)}[\"'\s>](.*?)</{tag}>"
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.concat(F.lit("<"), F.element_at(found, 1)))


def page_comments(pages: DataFrame) -> DataFrame:
    """Replace each page by the joined content of its comments, ready to be scanned again."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))
    return pages.withColumn("html", F.array_join(found, ""))


def plain_text(content: Column) -> Column:
    """The text of markup: no tags, character references by name and by number replaced, outer blanks trimmed."""
    bare = F.regexp_replace(content, _TAGS, "")
    bare = F.when(F.contains(bare, F.lit("&#")), _numbered(bare)).otherwise(bare)
    named = bare
    for name, sign in _REFERENCES.items():  # the ampersand last, so that nothing is read twice
        named = F.replace(named, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.when(F.contains(bare, F.lit("&")), named).otherwise(bare))


def _numbered(text: Column) -> Column:
    """``&#233;`` and ``&#xe9;`` as their characters; numbers of no character become U+FFFD."""

    def shown(part: Column) -> Column:
        whole = F.regexp_extract(part, r"^&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 0)
        digits = F.regexp_replace(whole, "[&#xX;]", "")
        code = F.when(F.lower(whole).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        # A sign that starts another reference must not be read again.
        sign = F.when(sign == "&", F.lit("&amp;")).otherwise(sign)
        return F.when(F.length(whole) > 0, F.concat(sign, F.substring(part, F.length(whole) + 1, F.length(part)))).otherwise(part)

    return F.array_join(F.transform(F.split(text, "(?=&#)", -1), shown), "")


def _elements(html: Column, tag: str) -> Column:
    """The elements of a tag, left to right, as ``attrs`` and ``body``; ``tag`` may list alternatives.

    An element ends at its end tag or, without one, where the next of its kind starts; a void one (``<td/>``) has no body.
    """
    starts = F.split(html, rf"(?i)<(?:{tag})(?=[\s/>])", -1)

    def element(piece: Column) -> Column:
        attrs = F.substring_index(piece, ">", 1)
        inside = F.substring(piece, F.length(attrs) + 2, F.length(piece))
        body = F.when(F.endswith(attrs, F.lit("/")), F.lit("")).otherwise(
            F.get(F.split(inside, rf"(?i)</(?:{tag})\s*>", 2), F.lit(0))
        )
        return F.struct(attrs.alias("attrs"), body.alias("body"))

    return F.transform(F.filter(starts, lambda piece, at: at > 0), element)


def _span(attrs: Column, name: str, most: int) -> Column:
    found = F.regexp_extract(attrs, rf"(?i)\b{name}\s*=\s*[\"']?\s*([0-9]{{1,9}})", 1)
    return F.when(found == "", 1).otherwise(F.least(F.greatest(found.cast("int"), F.lit(1)), F.lit(most)))


_CELLS = "array<struct<text:string,rows:int>>"
_CARRY = "array<struct<text:string,left:int>>"


def _spread(rows: Column) -> Column:
    """Rows of cells (``text``, ``rows``) as rows of texts, each cell that spans several rows repeated in those below.

    A cell takes the next place in its row that no cell from above covers.
    """

    def place(state: Column, row: Column) -> Column:
        carry = state["carry"]
        places = F.sequence(F.lit(0), F.size(carry) + F.size(row))
        covered = F.transform(places, lambda c: F.coalesce(F.get(carry, c)["left"] > 0, F.lit(False)))
        free = F.filter(places, lambda c: ~F.get(covered, c))
        width = F.greatest(
            F.when(F.size(row) > 0, F.get(free, F.size(row) - 1) + 1).otherwise(F.lit(0)),
            F.coalesce(F.array_max(F.filter(places, lambda c: F.get(covered, c))) + 1, F.lit(0)),
        )
        cells = F.transform(F.slice(places, F.lit(1), width), lambda c: F.when(
            F.get(covered, c), F.struct(F.get(carry, c)["text"].alias("text"), (F.get(carry, c)["left"] - 1).alias("left"))
        ).otherwise(F.struct(
            F.coalesce(F.get(row, F.array_position(free, c).cast("int") - 1)["text"], F.lit("")).alias("text"),
            F.coalesce(F.get(row, F.array_position(free, c).cast("int") - 1)["rows"] - 1, F.lit(0)).alias("left"),
        ))).cast(_CARRY)
        return F.element_at(F.transform(F.array(cells), lambda x: F.struct(
            x.alias("carry"), F.concat(state["rows"], F.array(F.transform(x, lambda c: c["text"]))).alias("rows")
        )), 1)

    start = F.struct(F.array().cast(_CARRY).alias("carry"), F.array().cast("array<array<string>>").alias("rows"))
    several = F.exists(rows, lambda row: F.exists(row, lambda cell: cell["rows"] > 1))
    plain = F.transform(rows, lambda row: F.transform(row, lambda cell: cell["text"]))
    return F.when(several, F.aggregate(rows, start, place, lambda x: x["rows"])).otherwise(plain)


def page_tables(
    pages: DataFrame, row_tag: str = "tr", cell_tag: str = "td|th", table_tag: str | None = "table"
) -> DataFrame:
    """One row per table: ``page_id``, ``table_no`` (from 0), ``table_id``, ``rows`` and ``links``, one array per row of its texts and links.

    Cells that span columns are repeated in them, cells that span rows in the rows below. ``table_id`` is the id attribute,
    null without one. With ``cell_tag`` equal to ``row_tag`` each row is its only cell; without a ``table_tag`` the page is one
    table. Comments hold no tables (see ``page_comments``), and a table inside another is a table of its own. Pages without
    a table, or without html, have no row. The page is split once, at the tables; its parts never meet the html again.
    """
    whole = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    found = F.array(F.struct(F.lit("").alias("attrs"), whole.alias("body"))) if table_tag is None else _elements(whole, table_tag)

    def cells(row: Column) -> Column:
        inside = F.array(row) if cell_tag == row_tag else _elements(row["body"], cell_tag)
        return F.flatten(F.transform(inside, lambda cell: F.array_repeat(
            F.struct(plain_text(cell["body"]).alias("text"), _span(cell["attrs"], "rowspan", MOST_ROWS_SPANNED).alias("rows")),
            _span(cell["attrs"], "colspan", MOST_COLUMNS_SPANNED),
        ))).cast(_CELLS)

    # An outer generator: for an inner one Spark would put a filter on a second copy of the whole extraction.
    tables = pages.select("page_id", F.posexplode_outer(found).alias("table_no", "_table")).where("_table.body is not null")
    named = F.regexp_extract("_table.attrs", r"""(?i)\bid\s*=\s*["']?([^"'\s>]*)""", 1)
    split = tables.select("page_id", "table_no", F.nullif(named, F.lit("")).alias("table_id"),
                          _elements(F.col("_table.body"), row_tag).alias("_rows"))
    return split.select(
        "page_id", "table_no", "table_id", _spread(F.transform("_rows", cells)).alias("rows"),
        F.transform("_rows", lambda row: _links(row["body"])).alias("links"),
    )


def page_rows(
    pages: DataFrame, row_tag: str = "tr", cell_tag: str = "td|th", table_tag: str | None = "table"
) -> DataFrame:
    """One row per table cell: ``page_id``, ``table_no``, ``row_no``, ``cell_no`` (all from 0) and its ``text``."""
    tables = page_tables(pages, row_tag, cell_tag, table_tag)
    rows = tables.select("page_id", "table_no", F.posexplode_outer("rows").alias("row_no", "cells")).where("row_no is not null")
    return rows.select("page_id", "table_no", "row_no", F.posexplode_outer("cells").alias("cell_no", "text")).where("cell_no is not null")


def _links(html: Column) -> Column:
    whole = F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(0))
    return F.transform(whole, lambda a: F.regexp_replace(a, r"""(?i)^href\s*=\s*["']?|["']$""", ""))


def page_links(pages: DataFrame, prefix: str = "") -> DataFrame:
    """Link targets that start with ``prefix``: ``page_id``, ``link_no`` among all links, ``link``.

    The attribute may be in any case, its value in either kind of quotes or in none.
    """
    return pages.select("page_id", F.posexplode(_links(F.col("html"))).alias("link_no", "link")).where(F.col("link").startswith(prefix))


def clean_name(text: Column) -> Column:
    """Header text in snake case: lower case, one underscore for every run of other characters."""
    snake = F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "_")
    return F.regexp_replace(snake, r"^_+|_+$", "")


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns to snake case; a repeated name gets the first of ``_2``, ``_3`` and so on that is free."""
    plain = [re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") or "x" for c in df.columns]
    taken, names = set(plain), []
    for at, name in enumerate(plain):
        if name in plain[:at]:
            name = next(f"{name}_{n}" for n in itertools.count(2) if f"{name}_{n}" not in taken)
            taken.add(name)
        names.append(name)
    return df.toDF(*names)


def promote_header(tables: DataFrame, header_row: int = 0) -> DataFrame:
    """Name every cell after the cell above it in row ``header_row`` of its table; the rows above are dropped.

    Takes ``page_tables``; returns ``page_id``, ``table_no``, ``row_no``, ``cells``, an array of ``name`` and ``text``, and ``links``,
    without the header rows. Names are those of ``clean_names``: ``x`` for nothing, and the first of ``_2``, ``_3`` and so on that is
    free for a repeated one. Nothing is shuffled: a table is one row.
    """
    plain = F.transform(F.get("rows", F.lit(header_row)), lambda text: F.coalesce(F.nullif(clean_name(text), F.lit("")), F.lit("x")))

    def add(taken: Column, name: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(2), F.size("_plain") + 1), lambda n: F.concat_ws("_", name, n))
        free = F.filter(numbered, lambda other: ~F.array_contains(F.col("_plain"), other) & ~F.array_contains(taken, other))
        return F.concat(taken, F.array(F.when(F.array_contains(taken, name), F.get(free, F.lit(0))).otherwise(name)))

    named = tables.where(F.size("rows") > header_row + 1).select("page_id", "table_no", "rows", "links", plain.alias("_plain")).select(
        "page_id", "table_no", F.arrays_zip(F.col("rows").alias("texts"), F.col("links").alias("links")).alias("_rows"),
        F.aggregate("_plain", F.array().cast("array<string>"), add).alias("_names"),
    )
    rows = named.select("page_id", "table_no", "_names", F.posexplode_outer("_rows").alias("row_no", "_row")).select(
        "page_id", "table_no", "_names", "row_no", F.col("_row.texts").alias("_texts"), F.col("_row.links").alias("links")
    )
    width = F.least(F.size("_names"), F.size("_texts"))
    pairs = F.zip_with(
        F.slice("_names", 1, width), F.slice("_texts", 1, width),
        lambda name, text: F.struct(name.alias("name"), text.alias("text")),
    )
    return rows.where(F.col("row_no") > header_row).select("page_id", "table_no", "row_no", pairs.alias("cells"), "links")


def wide_rows(named: DataFrame, columns: list[str], link_prefix: str | None = None) -> DataFrame:
    """Turn the named cells of each row into the listed columns; a name the table lacks gives null.

    With a ``link_prefix`` the column ``link`` is the first link of the row that starts with it.
    """

    def value(column: str) -> Column:
        return F.try_element_at(F.filter("cells", lambda c: c["name"] == column), F.lit(1))["text"].alias(column)

    out = ["page_id", "table_no", "row_no", *[value(c) for c in columns]]
    if link_prefix is not None:
        out.append(F.get(F.filter("links", lambda link: link.startswith(link_prefix)), F.lit(0)).alias("link"))
    return named.select(*out)


def numeric_cells(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Cast the listed text columns to numbers; text that is no number becomes null."""
    return wide.withColumns({c: number(F.col(c)) for c in columns})


def page_frontier(
    entities: DataFrame, entity: str, first: str, last: str, floor: int, template: str, stored: DataFrame | None = None
) -> DataFrame:
    """Work list of pages: every period of every entity, none before ``floor``, with its address.

    ``template`` is a format text for the entity and the period, such as ``/teams/%s/%d.html``. With ``stored``, a
    table with a ``url``, the list holds only addresses that stand in it: they are taken apart and meet the spans of
    their entities, so that the work grows with the stored pages and not with the length of the spans.
    """
    start = F.greatest(F.col(first).cast("int"), F.lit(floor))
    end = F.col(last).cast("int")
    if stored is not None:
        spans = entities.where(start <= end).select(
            entity, start.alias("_start"), end.alias("_end"), F.format_string("%s", F.col(entity).cast("string")).alias("_name")
        )
        found = spans.join(_addresses(stored, template, floor), "_name").where(F.col("period").between(F.col("_start"), F.col("_end")))
        return found.select(entity, F.col("period").cast("int").alias("period"), "url")
    periods = F.explode(F.sequence(start, end))
    return (
        entities.where(start <= end)
        .select(entity, periods.alias("period"))
        .withColumn("url", F.format_string(template, F.col(entity).cast("string"), F.col("period")))
    )


def _addresses(stored: DataFrame, template: str, floor: int) -> DataFrame:
    """The distinct addresses that ``template`` gives for a name and a period not below 0: ``_name``, ``period``, ``url``."""
    parts = re.fullmatch(r"(?s)([^%]*)%s([^%]*[^%0-9][^%]*)%d([^%]*)", template)
    if not parts or floor < 0:
        raise ValueError("only a name, a text that is not all digits and a period from 0 on can be told apart again")
    before, between, after = (re.escape(part) for part in parts.groups())
    pattern = rf"(?s)\A{before}(.*){between}(0|[1-9][0-9]{{0,9}}){after}\z"
    return stored.where(F.col("url").rlike(pattern)).select("url").distinct().select(
        F.regexp_extract("url", pattern, 1).alias("_name"), F.regexp_extract("url", pattern, 2).cast("long").alias("period"), "url"
    )


def fetch_stored(frontier: DataFrame, pages: DataFrame, counted: Observation | None = None) -> DataFrame:
    """The stored pages of a work list; addresses with no stored page are skipped.

    ``counted`` takes the numbers ``asked`` (rows of the work list, one for each stored page of its address) and ``skipped``
    from the pass that first computes the result.
    """
    if counted is None:
        return frontier.join(pages, "url")
    found = frontier.join(pages.withColumn("_stored", F.lit(True)), "url", "left").observe(
        counted, F.count("*").alias("asked"), F.count_if(F.col("_stored").isNull()).alias("skipped")
    )
    return found.where("_stored").drop("_stored")


def count_unstored(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """One row with the number of work items that have no stored page."""
    return matching_rows(frontier, pages, ["url"], "left_anti").agg(F.count("*").alias("skipped"))
