"""Queries on stored web pages."""

from __future__ import annotations

from pyspark.sql import Observation, functions as F

from almanac.functions.scalars import link_id
from almanac.operators.keys import numeric_rows
from almanac.operators.settle import settle
from almanac.plans.catalog.registry import query
from almanac.plans.careers import backfill
from almanac.sources.pages import (
    fetch_stored, page_comments, page_frontier, page_links, page_rows, page_tables, promote_header,
)

_LINKS = r"""
    SELECT page_id, unnest(range(len(l)))::INT AS link_no, unnest(l) AS link
    FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)
"""


@query(f"SELECT * FROM ({_LINKS}) WHERE starts_with(link, '/t')")
def links_of_pages(t):
    return page_links(t.pages, "/t")


@query(fr"""
    SELECT page_id, link_no, substr(regexp_replace(link, '(?s)\..*$', ''), 2) AS id
    FROM ({_LINKS}) WHERE starts_with(link, '/')
""")
def ids_in_links(t):
    return page_links(t.pages, "/").select("page_id", "link_no", link_id(F.col("link"), 1).alias("id"))


@query(r"""
    SELECT page_id, url, array_to_string(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1), '') AS html FROM pages
""")
def comments_of_pages(t):
    return page_comments(t.pages)


# Elements that stand for tables, rows and cells: the pages have no table element.
_TAGS = ("nav|article", "ul|p", "li|b")


def _sql_elements(column: str, tag: str) -> str:
    """Element bodies of a tag as a list."""
    return rf"""list_transform(regexp_split_to_array({column}, '(?i)<(?:{tag})(?:[\s/][^>]*)?>')[2:],
                lambda e: regexp_replace(e, '(?is)</(?:{tag})\s*>.*$', ''))"""


def _sql_text(column: str) -> str:
    out = rf"regexp_replace({column}, '(?s)<[^>]*>', '', 'g')"
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{sign}')"
    return f"trim({out}, ' ')"


_SQL_ROWS = rf"""
    SELECT page_id, table_no, unnest(range(len(rows)))::INT AS row_no, unnest(rows) AS row FROM (
        SELECT page_id, unnest(range(len(tables)))::INT AS table_no, {_sql_elements("unnest(tables)", _TAGS[1])} AS rows
        FROM (SELECT page_id, {_sql_elements("regexp_replace(html, '(?s)<!--.*?-->', '', 'g')", _TAGS[0])} AS tables FROM pages))
"""
_SQL_CELLS = rf"""
    SELECT page_id, table_no, row_no, unnest(range(len(cells)))::INT AS cell_no, {_sql_text("unnest(cells)")} AS text
    FROM (SELECT page_id, table_no, row_no, {_sql_elements("row", _TAGS[2])} AS cells FROM ({_SQL_ROWS}))
"""


def _tables(pages):
    return page_tables(pages, _TAGS[1], _TAGS[2], _TAGS[0])


@query(_SQL_CELLS)
def rows_of_pages(t):
    return page_rows(t.pages, _TAGS[1], _TAGS[2], _TAGS[0])


@query(f"""
    SELECT page_id, tables.table_no, count(row_no) AS n_rows
    FROM (SELECT page_id, unnest([0, 1])::INT AS table_no FROM pages) tables LEFT JOIN ({_SQL_ROWS}) USING (page_id, table_no) GROUP BY ALL
""")
def tables_of_pages(t):
    return _tables(t.pages).select("page_id", "table_no", F.size("rows").cast("long").alias("n_rows"))


@query(rf"""
    WITH cells AS ({_SQL_CELLS}),
    header AS (
        SELECT page_id, table_no, list(coalesce(nullif(regexp_replace(regexp_replace(lower(trim(text, ' ')), '[^a-z0-9]+', '_', 'g'),
               '^_+|_+$', '', 'g'), ''), 'x') ORDER BY cell_no) AS plain
        FROM cells WHERE row_no = 0 GROUP BY ALL),
    named AS (
        SELECT page_id, table_no, list_reduce(list_transform(plain, lambda n: [n]), lambda taken, n: list_concat(taken, [
            CASE WHEN NOT list_contains(taken, n[1]) THEN n[1] ELSE n[1] || '_' || list_filter(range(2, len(plain) + 2), lambda k:
                NOT list_contains(plain, n[1] || '_' || k) AND NOT list_contains(taken, n[1] || '_' || k))[1] END])) AS names
        FROM header)
    SELECT page_id, table_no, row_no, names[cell_no + 1] AS name, text
    FROM cells JOIN named USING (page_id, table_no) WHERE row_no > 0 AND cell_no < len(names)
""")
def named_cells_of_pages(t):
    return promote_header(_tables(t.pages)).select("page_id", "table_no", "row_no", F.inline("cells"))


@query("""
    SELECT page_id, url, length(html)::INT AS chars, 2 * (SELECT count(*) FROM pages) AS asked, (SELECT count(*) FROM pages) AS skipped FROM pages
""")
def stored_pages_counted(t):
    """Every page and one address beside it that is not stored; the pass that joins them counts what it skips."""
    work = t.pages.select("page_id", F.explode(F.array("url", F.concat("url", F.lit("/more")))).alias("url"))
    counted = Observation()
    found = settle(fetch_stored(work, t.pages.select("url", F.length("html").alias("chars")), counted))
    return found.select("page_id", "url", "chars", *[F.lit(counted.get[c]).alias(c) for c in ("asked", "skipped")])


@query("""
    WITH texts AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'Qty' ELSE l_quantity::VARCHAR END AS text, l_quantity FROM lineitem)
    SELECT l_orderkey, l_linenumber, text, (SELECT count(*) FROM texts) AS asked,
           (SELECT count(*) FROM texts WHERE text = 'Qty' OR l_quantity <= 4) AS skipped
    FROM texts WHERE text <> 'Qty' AND l_quantity > 4
""")
def numeric_rows_counted(t):
    text = F.when(F.col("l_linenumber") % 3 == 0, "Qty").otherwise(F.col("l_quantity").cast("string"))
    counted = Observation()
    kept = settle(numeric_rows(t.lineitem.select("l_orderkey", "l_linenumber", text.alias("text")), "text", 4, counted=counted))
    return kept.select("*", *[F.lit(counted.get[c]).alias(c) for c in ("asked", "skipped")])


@query("""
    SELECT n_name, p::INT AS period, '/nations/' || n_name || '/' || p || '.html' AS url
    FROM (SELECT n_name, unnest(range(greatest(1980 + n_nationkey, 1990), 2001)) AS p FROM nation)
""")
def frontier_of_pages(t):
    nations = t.nation.withColumn("first", 1980 + F.col("n_nationkey")).withColumn("last", F.lit(2000))
    return page_frontier(nations, "n_name", "first", "last", 1990, "/nations/%s/%d.html")


# Pages are the periods of a site: all before the last slash of the address.
_SITE, _PERIOD = "^(.*)/[0-9]{1,9}$", "/([0-9]{1,9})$"


@query(f"""
    SELECT page_id, CASE WHEN regexp_matches(url, '{_SITE}') THEN regexp_extract(url, '{_SITE}', 1) ELSE url END AS site,
           nullif(regexp_extract(url, '{_PERIOD}', 1), '')::INT AS period, count(row_no)::BIGINT AS n_rows
    FROM pages LEFT JOIN ({_SQL_ROWS}) USING (page_id) GROUP BY ALL
""")
def backfilled_entities(t):
    """Rows per page: fetched from the stored pages for sites with an odd number of numbered pages, known for all others."""
    numbered = F.col("url").rlike(_SITE)
    pages = t.pages.select(
        "page_id", "html", "url", F.when(numbered, F.regexp_extract("url", _SITE, 1)).otherwise(F.col("url")).alias("site"),
        F.when(numbered, F.regexp_extract("url", _PERIOD, 1)).cast("int").alias("period"),
    )

    def counts(found):
        n_rows = page_tables(found, _TAGS[1], _TAGS[2], _TAGS[0]).groupBy("page_id").agg(F.sum(F.size("rows")).alias("n_rows"))
        return found.select("page_id", "site", "period").join(n_rows, "page_id", "left").select(
            "page_id", "site", "period", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows")
        )

    master = settle(pages.groupBy("site").agg(
        F.min("period").alias("first"), F.max("period").alias("last"), F.count("period").alias("n")
    ))
    facts = settle(counts(pages.join(master.where("n % 2 = 0").select("site"), "site", "left_semi")))

    def fetch(missing):
        work = page_frontier(missing, "site", "first", "last", 0, "%s/%d", pages).select("url")
        return counts(fetch_stored(work, pages))

    return backfill(master.select("site", "first", "last"), facts, "site", fetch)
