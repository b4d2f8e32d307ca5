"""Tables of the analysis out of made-up pages."""

import pytest

from almanac.plans import draft, stored_pages as sp
from almanac.sources.pages import page_frontier


def table(name, *rows, over=True):
    top = "<tr><th colspan=3></th><th colspan=2>Group</th></tr>" if over else ""
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" if not c.startswith("=") else f"<th>{c[1:]}</th>" for c in row) + "</tr>" for row in rows)
    return f'<div><table class="a" id="{name}">{top}{body}</table></div>'


def link(to, text):
    return f'<a href="{to}">{text}</a>'


@pytest.fixture(scope="module")
def pages(spark):
    drafts = lambda *rows: table("drafts", ["=Rnd", "=Pick", "=Player", "=Pos", "=Age"], *rows)
    html = {
        "https://a/years/2011/draft.htm": drafts(
            ["1", "1", link("/players/N/NewtCa00.htm", "Cam &amp; Co"), "QB", "22"], ["=Rnd", "=Pick", "=Player", "=Pos", "=Age"],
            ["2", "33", "No Age", "RB", ""]),
        "https://a/years/2012/draft.htm": table("other", ["9"]) + drafts(
            ["1", "1", link("/teams/x", "x") + link("/players/L/LuckAn00.htm", "Luck"), "QB", ""]),
        "https://b/cfb/years/2001-standings.html": table(
            "standings", ["=Rk", "=School", "=W", "=Off", "=Def", "=SRS", "=SOS"],
            ["1", link("/cfb/schools/miami-fl/2001.html", "Miami"), "12", "42.6", "9.8", "26.1", "7"],
            ["=Rk", "=School", "=W", "=Off", "=Def", "=SRS", "=SOS"],
            ["2", link("/cfb/schools/texas/2001.html", "Texas"), "11", "39", "", "19.5", "3.1"]),
        "https://b/cfb/schools/texas/2001.html": "<p>x</p><!--" + table(
            "passing", ["=Player", "=G", "=Cmp", "=Att", "=Yds", "=TD", "=Int"],
            [link("/cfb/players/chris-simms-1.html", "Simms"), "12", "214", "362", "2603", "22", "11"]) + "--><!-- " + table(
            "rushing_and_receiving", ["=Player", "=G", "=Att", "=Yds", "=TD", "=Rec", "=Yds", "=TD"],
            [link("/cfb/players/ced-benson-1.html", "Benson"), "12", "223", "1053", "12", "17", "203", "1"]) + "-->",
        "https://a/players/B/BensCe00.htm": table(
            "rushing_and_receiving", ["=Year", "=Pos", "=G", "=GS", "=AV"], *[
                [str(2005 + i), "RB", str(10 + i), "5", str(i) if i != 6 else ""] for i in range(7)]),
        "https://a/players/G/GapsXx00.htm": table(
            "rushing_and_receiving", ["=Year", "=Pos", "=G", "=GS", "=AV"], ["2005", "RB", "3", "1", ""], ["2006", "RB", "4", "1", "2"]),
        "https://a/players/L/LuckAn00.htm": table(
            "passing", ["=Year", "=Age", "=Pos", "=G", "=GS", "=AV"], ["2012*", "23", "QB", "16", "16", "15"],
            ["Career", "", "", "16", "16", "15"], over=False),
        "https://a/empty": None,
    }
    rows = [(i, url, text) for i, (url, text) in enumerate(html.items())]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_draft_lists(pages):
    got = sorted(map(tuple, sp.draft_lists(pages).collect()))
    assert got == [(2011, 1.0, 1.0, "Cam & Co", "QB", 22.0, "NewtCa00"), (2012, 1.0, 1.0, "xLuck", "QB", None, "LuckAn00")]


def test_standings_feed_the_analysis(pages):
    rows = sp.standings(pages)
    assert sorted(map(tuple, rows.collect())) == [("miami-fl", 42.6, 9.8, 26.1, 7.0, 2001), ("texas", 39.0, None, 19.5, 3.1, 2001)]
    plus = {r.school_name: r.off_plus for r in draft.indexed_standings(rows).collect()}
    assert plus["texas"] == pytest.approx(100 * 39 / 40.8)


def test_college_seasons_in_comments(pages):
    passing, rushing = sp.passing_tables(pages), sp.rushing_tables(pages)
    assert [tuple(r) for r in passing.collect()] == [("chris-simms-1", "texas", 2001, 12.0, 214.0, 362.0, 2603.0, 22.0, 11.0)]
    assert [tuple(r) for r in rushing.collect()] == [("ced-benson-1", "texas", 2001, 12.0, 223.0, 1053.0, 12.0, 17.0, 203.0, 1.0)]
    season = draft.passing_seasons(passing, draft.indexed_standings(sp.standings(pages))).collect()
    assert [(r.player_id, r.school_name, r.yards_plus) for r in season] == [("chris-simms-1", "texas", 0.0)]


def test_values_of_players(pages):
    got = {r.player_id: (r.pos, r.av, r.g, r.gs) for r in sp.first_season_values(pages).collect()}
    assert got == {"BensCe00": ("RB", 0.0 + 1 + 2 + 3, 46.0, 20.0), "GapsXx00": ("RB", None, 7.0, 2.0)}
    assert [tuple(r) for r in sp.passer_values(pages).collect()] == [("QB", "2012*", "23", 15.0, "LuckAn00", 16.0, 16.0)]


def test_pages_without_the_tables(spark, pages):
    nothing = pages.where("url = 'https://a/empty'")
    for read in (sp.draft_lists, sp.standings, sp.passing_tables, sp.rushing_tables, sp.first_season_values, sp.passer_values):
        assert read(nothing).count() == 0


def test_frontier_of_stored_addresses(spark):
    """The addresses that the whole work list shares with the stored pages, once for each entity, however long its span."""
    teams = spark.createDataFrame(
        [("a", 3, 5), ("a/b", 0, 12), ("a", 4, 4), ("x.y", None, 2), (None, 1, 3), ("e", 9, 1), ("", 0, 2)],
        "team string, first int, last int",
    )
    names = ["a", "a/b", "x.y", "xzy", "null", "e", "", "a\n"]
    urls = [f"/t/{n}/{p}{end}" for n in names for p in ("0", "1", "2", "4", "05", "12", "-1", "99999999999") for end in (".htm", ".htm\n", "xhtm")]
    stored = spark.createDataFrame([(u,) for u in [*urls, *urls[:40]]] + [(None,)], "url string")
    whole = page_frontier(teams, "team", "first", "last", 1, "/t/%s/%d.htm")
    want = sorted(map(str, whole.join(stored.distinct(), "url").select("team", "period", "url").collect()))
    got = page_frontier(teams, "team", "first", "last", 1, "/t/%s/%d.htm", stored)
    assert got.dtypes == whole.dtypes
    assert len(want) > 8 and sorted(map(str, got.collect())) == want
    # A span of a thousand million periods is no work list in memory.
    teams = spark.createDataFrame([("a", 0, 999_999_999)], "team string, first int, last int")
    found = page_frontier(teams, "team", "first", "last", 0, "/t/%s/%d.htm", stored)
    assert sorted(r.period for r in found.collect()) == [0, 1, 2, 4, 12]
    for template, floor in (("%s%d", 0), ("%s1%d", 0), ("%s-%d", -1)):
        with pytest.raises(ValueError):
            page_frontier(teams, "team", "first", "last", floor, template, stored)
