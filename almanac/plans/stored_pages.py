"""The tables of the football analysis out of stored pages: drafts, standings, college seasons, professional value.

Every function takes pages (``page_id``, ``url``, ``html``) and reads the one table it knows by its id. Pages without that table
give no rows. Ids of players and schools come from the links of a row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions.aggregates import strict_sum
from almanac.functions.scalars import link_id, number
from almanac.operators.keys import first_n, rule_filter
from almanac.sources.pages import numeric_cells, page_comments, page_tables, promote_header, wide_rows

# Table ids, columns and link prefixes of the pages, and the last draft that lists some players without an age.
PLAYER, COLLEGE_PLAYER, SCHOOL = "/players/", "/cfb/players/", "/cfb/schools/"
PASSING_COLUMNS = ["g", "cmp", "att", "yds", "td", "int"]
RUSHING_COLUMNS = ["g", "att", "yds", "td", "rec", "yds_2", "td_2"]
LAST_DRAFT_BY_AGE = 2011
VALUE_SEASONS = 4


def season_in(url: Column) -> Column:
    """The last number of four digits in an address."""
    return F.regexp_extract(url, r"(?s)^.*(?<![0-9])([0-9]{4})(?![0-9])", 1).try_cast("int")


def chosen_table(
    pages: DataFrame, table_id: str, columns: list[str], numbers: list[str], link_prefix: str | None = None,
    header_row: int = 0, in_comments: bool = False,
) -> DataFrame:
    """The rows of one table of every page, as the listed columns, with ``page_id``, ``url``, ``row_no`` and ``link``.

    The columns in ``numbers`` become numbers, null where a cell holds none. Some pages keep the table in a comment; with ``in_comments`` it is
    looked for in all of them.
    """
    source = page_comments(pages) if in_comments else pages
    tables = page_tables(source).where(F.col("table_id") == table_id)
    wide = numeric_cells(wide_rows(promote_header(tables, header_row), columns, link_prefix), numbers)
    return wide.drop("table_no").join(pages.select("page_id", "url"), "page_id")


def draft_lists(pages: DataFrame) -> DataFrame:
    """Picks of all seasons: ``season``, ``rnd``, ``pick``, ``player``, ``pos``, ``age`` and ``player_id``; repeated headers go.

    Up to ``LAST_DRAFT_BY_AGE`` only players with an age have an id, so others are left out there.
    """
    rows = chosen_table(pages, "drafts", ["rnd", "pick", "player", "pos", "age"], ["rnd", "pick", "age"], PLAYER, header_row=1)
    rows = rows.withColumn("season", season_in(F.col("url"))).where("rnd > 0")
    rows = rule_filter(rows, F.col("season") <= LAST_DRAFT_BY_AGE, F.col("age") > 0, F.lit(True))
    # The prefix, one letter and a slash stand before the id.
    return rows.select("season", "rnd", "pick", "player", "pos", "age", link_id(F.col("link"), len(PLAYER) + 2).alias("player_id"))


def standings(pages: DataFrame) -> DataFrame:
    """Standings of all seasons: ``school_name``, ``off``, ``def``, ``srs``, ``sos`` and ``season``; repeated headers go."""
    columns = ["w", "off", "def", "srs", "sos"]
    rows = chosen_table(pages, "standings", columns, columns, SCHOOL, header_row=1).where("w is not null and link is not null")
    name = F.substring_index(F.substring(F.col("link"), len(SCHOOL) + 1, 1000), "/", 1)
    return rows.select(name.alias("school_name"), "off", "def", "srs", "sos", season_in(F.col("url")).alias("season"))


def _college_seasons(pages: DataFrame, table_id: str, columns: list[str]) -> DataFrame:
    rows = chosen_table(pages, table_id, columns, columns, COLLEGE_PLAYER, header_row=1, in_comments=True)
    school = F.regexp_extract("url", r"([^/]+)/[0-9]{4}(?:\.[a-z]+)?$", 1)
    return rows.where("link is not null").select(
        link_id(F.col("link"), len(COLLEGE_PLAYER)).alias("player_id"), school.alias("school"),
        season_in(F.col("url")).alias("season"), *columns,
    )


def passing_tables(pages: DataFrame) -> DataFrame:
    """Passing of every player per school and season, from pages whose address ends in school and season."""
    return _college_seasons(pages, "passing", PASSING_COLUMNS)


def rushing_tables(pages: DataFrame) -> DataFrame:
    """Rushing and receiving of every player per school and season."""
    return _college_seasons(pages, "rushing_and_receiving", RUSHING_COLUMNS)


def _player_in(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/]+?)(?:\.[a-z]+)?$", 1)


def first_season_values(pages: DataFrame, seasons: int = VALUE_SEASONS, table_id: str = "rushing_and_receiving") -> DataFrame:
    """Value, games and starts of every player over the first seasons of their page, per position.

    A cell that holds no number makes the sum missing. The address ends in the player's id.
    """
    numbers = ["av", "g", "gs"]
    rows = chosen_table(pages, table_id, ["pos", *numbers], numbers, header_row=1)
    first = first_n(rows.withColumn("player_id", _player_in(F.col("url"))), ["page_id"], [F.col("row_no")], seasons)
    return first.groupBy("player_id", "pos").agg(*[strict_sum(F.col(c)).alias(c) for c in numbers])


def passer_values(pages: DataFrame) -> DataFrame:
    """Value of every passer and season: ``pos``, ``year``, ``age``, ``av``, ``player_id``, ``g`` and ``gs``; rows without an age are totals."""
    rows = chosen_table(pages, "passing", ["pos", "year", "age", "av", "g", "gs"], ["av", "g", "gs"])
    return rows.where(number(F.col("age")).isNotNull()).select(
        "pos", "year", "age", "av", _player_in(F.col("url")).alias("player_id"), "g", "gs"
    )
