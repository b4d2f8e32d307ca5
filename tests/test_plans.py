import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from almanac.operators.keys import numeric_rows
from almanac.operators.summary import chosen_breaks, histogram_chosen
from almanac.plans.careers import adjusted_stats, backfill, cohort_projection, player_table
from almanac.plans.reports import prediction_rankings, ranking_report
from almanac.sources.files import read_checked_csv, read_json_records, read_snapshot, read_stats_csv, write_stats_csv
from almanac.sources.pages import (
    clean_names, count_unstored, element_content, fetch_stored, numeric_cells, page_comments, page_frontier,
    page_links, page_rows, page_tables, promote_header, wide_rows,
)


def test_projection_of_unfinished_cohorts(spark):
    start = {"a": 2000, "b": 2001, "c": 2002, "open2": 2008, "open1": 2009, "late": 2005, "none": 2000,
             "gap": 2000, "twice": 2000}
    cohorts = spark.createDataFrame([*start.items(), ("twice", 2001)], "id string, d int")
    values = {"a": [1, 2, 3], "b": [2, 1, 5], "c": [4, 4, 9], "open2": [3, 4], "open1": [6], "late": [1, 1, 1],
              "twice": [1, 1, 1]}
    facts = [(k, start[k] + i, float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    facts += [("gap", 2000, 1.0), ("gap", 2001, None), ("a", 2007, 50.0), ("unknown", 2000, 9.0)]
    out = cohort_projection(
        spark.createDataFrame(facts, "id string, y int, v double"), cohorts, "id", "y", "v", "d",
        horizon=3, as_of=2009, train_until=2003, leave_out=("twice",),
    )
    got = {(r.id, r.d): r.v for r in out.collect()}
    one = np.polyfit([1, 2, 4], [5, 6, 13], 1)
    two = np.polyfit([3, 3, 8], [3, 5, 9], 1)
    assert got[("a", 2000)] == 6 and got[("c", 2002)] == 17
    assert got[("open1", 2009)] == pytest.approx(6 + np.polyval(one, 6))
    assert got[("open2", 2008)] == pytest.approx(7 + np.polyval(two, 7))
    for key in [("late", 2005), ("none", 2000), ("gap", 2000), ("twice", 2000), ("twice", 2001)]:
        assert got[key] is None
    assert len(got) == 10


def test_projection_by_start(spark):
    """Two starts of one entity, facts after the horizon only, a repeated row of the cohorts."""
    cohorts = [("two", 2000), ("two", 2002), ("after", 2000), ("a", 2000), ("a", 2000), ("b", 2001)]
    facts = [("two", 2000, 1.0), ("two", 2002, 2.0), ("two", 2003, 4.0), ("after", 2008, 5.0), ("a", 2001, 3.0), ("b", 2001, 0.5)]
    out = cohort_projection(
        spark.createDataFrame(facts, "id string, y int, v double"), spark.createDataFrame(cohorts, "id string, d int"),
        "id", "y", "v", "d", horizon=3, as_of=2009, train_until=2003,
    )
    assert out.columns == ["id", "d", "v"]
    assert sorted((r.id, r.d, r.v) for r in out.collect() if r.v is not None) == [
        ("a", 2000, 3.0), ("a", 2000, 3.0), ("b", 2001, 0.5), ("two", 2000, 3.0), ("two", 2002, 7.0)]
    assert out.count() == 6


def test_adjusted_player_table(spark):
    passing = spark.createDataFrame(
        [("p", "x", 2000, 40.0, 10.0), ("q", "y", 2000, 20.0, 10.0)], "player string, school string, season int, yds double, att double"
    )
    standings = spark.createDataFrame([("x", 2000, 5.0), ("y", 2000, None)], "school string, season int, srs double")
    first = adjusted_stats(passing, standings, "season", ["season", "school"], {"plus": ("yds", "att")}, {"idx": ("yds", "att")})
    rushing = spark.createDataFrame([("q", "y", 2000, None, 3.0)], "player string, school string, season int, srs double, rush double")
    rows = player_table(first, rushing, ["season", "school", "player", "srs"]).orderBy("player").collect()
    assert [(r.player, r.plus, r.srs, r.rush) for r in rows] == [("p", 10.0, 5.0, None), ("q", -10.0, None, 3.0)]
    assert rows[0].idx == pytest.approx(400 / 3)


def test_report_of_perfect_and_reversed_rankings(spark):
    df = spark.createDataFrame([(1, i, float(i), float(i), i) for i in range(8)], "g int, id int, p double, o double, b int")
    row = ranking_report(prediction_rankings(df, ["g"], "p", "o", "b", "id"), ["g"]).first()
    assert (row.n, row.our_tau, row.baseline_tau) == (8, pytest.approx(1), pytest.approx(-1))
    assert row.our_p_value == pytest.approx(2 / 40320)


PAGE = """
<html><body><a href="/about">about</a><table id="other"><tr><td>9</td></tr></table>
<!-- <div><table class="s" id="passing">
<tr><th>Player</th><th>Yds</th><th>Yds</th><th>Pct %</th></tr>
<tr><td><a href="/cfb/players/joe-doe-1.html">Joe</a></td><td>100</td><td>7</td><td>.5</td></tr>
<tr><th>Player</th><th>Yds</th><th>Yds</th><th>Pct %</th></tr>
<tr><td><a href="/cfb/players/al-poe-2.html">Al</a></td><td></td><td>8</td><td>x</td></tr>
</table></div> -->
<p>text</p><!-- tail --></body></html>
"""


def test_table_inside_a_comment(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", "<p>no table</p>")], "page_id int, url string, html string")
    hidden = page_comments(pages)
    table = hidden.withColumn("html", element_content(F.col("html"), "table", "passing"))
    chosen = page_tables(hidden).where("table_id = 'passing'")
    wide = wide_rows(promote_header(chosen), ["player", "yds", "yds_2", "pct"])
    rows = numeric_cells(wide.where("player != 'Player'"), ["yds", "yds_2", "pct"]).orderBy("row_no").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 1, "Joe", 100.0, 7.0, 0.5), (1, 0, 3, "Al", None, 8.0, None)]
    links = page_links(table, "/cfb/players/").orderBy("link_no").collect()
    assert [r.link for r in links] == ["/cfb/players/joe-doe-1.html", "/cfb/players/al-poe-2.html"]
    assert page_links(pages, "/about").count() == 1


SPANS = """<table id='a' class=x><thead><tr><th>A</th><th>a</th><th>a 2</th></tr></thead>
<tr><td>x&amp;y &#233;&#x26;lt; &#xD800;</td><td/><td colspan=2>2</td></tr>
<TR><td rowspan="2">r</td><td>1</td><td rowspan=3>q</td></tr><tr><td>s<td>t</tr><tr><td>u</tr></TABLE>
<!-- <table><tr><td>no</td></tr></table> --><table ID=second><tr><td>1</td></tr></table><tr><td>stray</td></tr>"""


def test_spans_void_cells_and_references(spark):
    pages = [(1, SPANS), (2, None), (3, "none"), (4, "<table></table>"), (5, "<table><tr></tr><tr><td colspan=999999>w</td></tr>")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {(r.page_id, r.table_no): (r.table_id, r.rows) for r in page_tables(df).collect()}
    assert got[1, 0] == ("a", [["A", "a", "a 2"], ["x&y é&lt; \ufffd", "", "2", "2"], ["r", "1", "q"], ["r", "s", "q", "t"], ["u", "", "q"]])
    assert got[1, 1] == ("second", [["1"]]) and got[4, 0] == (None, []) and got[5, 0] == (None, [[], ["w"] * 1000])
    assert set(got) == {(1, 0), (1, 1), (4, 0), (5, 0)}
    names = promote_header(page_tables(df)).where("page_id = 1").select("row_no", F.inline("cells")).collect()
    assert sorted({r.name for r in names}) == ["a", "a_2", "a_3"]
    plan = page_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!--") == 1  # the html is scanned once
    long = spark.createDataFrame([(1, "<table>" + "<tr><td rowspan=2>é🙂</td><td>" + "b" * 50 + "</td></tr><tr><td>c</td></tr>" * 3000)], "page_id long, html string")
    assert page_rows(long).count() > 3000


def test_counted_skips(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    pages = spark.createDataFrame([("a", "x"), ("a", "y")], "url string, html string")
    counted = Observation()
    assert fetch_stored(work, pages, counted).count() == 2
    assert counted.get == {"asked": 4, "skipped": 2}
    rows = spark.createDataFrame([("3",), ("Yds",), (None,), ("9",)], "t string")
    counted = Observation()
    assert [r.t for r in numeric_rows(rows, "t", 3, counted=counted).collect()] == ["9"]
    assert counted.get == {"asked": 4, "skipped": 3}


def test_rejected_lines(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,v\na, 1.5\nb\nc,x\nd,NA\ne,1,2\n")
    good, bad = read_checked_csv(spark, str(tmp_path / "p.csv"), "id string, v double")
    assert sorted((r.id, r.v) for r in good.collect()) == [("a", 1.5), ("d", None)]
    assert sorted(r.line for r in bad.collect()) == ["b", "c,x", "e,1,2"]


def test_chosen_breaks(spark):
    assert chosen_breaks(0.0, 100.0, 100) == (10.0, 0, 10)
    assert chosen_breaks(-3.2, 7.9, 20) == (2.0, -2, 4)
    assert chosen_breaks(5.0, 5.0, 3) == (1.0, 5, 6)
    df = spark.createDataFrame([(v,) for v in (0.0, 2.0, 2.1, 4.0, 9.9, None, float("nan"))], "x double")
    assert sorted(map(tuple, histogram_chosen(df, "x").collect())) == [(1, 0.0, 2.0, 2), (2, 2.0, 4.0, 2), (5, 8.0, 10.0, 1)]
    assert histogram_chosen(df.limit(0), "x").count() == 0


def test_frontier_fetch_and_backfill(spark):
    schools = spark.createDataFrame([("x", 1958, 1961), ("y", 1990, 1991), ("z", 1950, 1955)], "school string, f int, t int")
    work = page_frontier(schools, "school", "f", "t", 1960, "/schools/%s/%d.html")
    assert sorted(r.url for r in work.collect()) == [
        "/schools/x/1960.html", "/schools/x/1961.html", "/schools/y/1990.html", "/schools/y/1991.html"
    ]
    pages = spark.createDataFrame([(7, "/schools/y/1990.html", "<table><tr><td>3</td></tr></table>")], "page_id int, url string, html string")
    assert count_unstored(work, pages).first().skipped == 3
    facts = spark.createDataFrame([("x", "1")], "school string, value string")

    def fetch(missing):
        found = fetch_stored(page_frontier(missing, "school", "f", "t", 1960, "/schools/%s/%d.html"), pages)
        return found.join(page_rows(found.select("page_id", "html")), "page_id").select("school", F.col("text").alias("value"))

    assert sorted(tuple(r) for r in backfill(schools, facts, "school", fetch).collect()) == [("x", "1"), ("y", "3")]


def test_files(spark, tmp_path):
    schema = "id string, v double, n int"
    (tmp_path / "padded.csv").write_text("id,v,n\n a,  1.5, 3\nb,NA,NA\n")
    df = read_stats_csv(spark, str(tmp_path / "padded.csv"), schema)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("a", 1.5, 3), ("b", None, None)]
    write_stats_csv(df, str(tmp_path / "out.csv"))
    assert sorted(read_snapshot(spark, str(tmp_path / "out.csv"), schema).collect()) == sorted(df.collect())
    df.write.parquet(str(tmp_path / "out"))
    assert read_snapshot(spark, str(tmp_path / "out"), schema).count() == 2
    (tmp_path / "p.json").write_text('{"draft_year": 2001, "height": "6-2", "extra": 1}\n{"draft_year": 2002}\n')
    rows = read_json_records(spark, str(tmp_path / "p.json"), "draft_year double, height string").collect()
    assert sorted((r.draft_year, r.height) for r in rows) == [(2001.0, "6-2"), (2002.0, None)]


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Yds/Att", "yds att", " X1 "])
    assert clean_names(df).columns == ["yds_att", "yds_att_2", "x1"]


def test_names_and_links_in_other_spellings(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["A", "a ", "a 2"])
    assert clean_names(df).columns == ["a", "a_3", "a_2"]
    html = """<a href="/a">1</a> <a HREF='/b'>2</a> <a href=/c>3</a> <a Href = "/d">4</a>"""
    links = page_links(spark.createDataFrame([(1, html)], "page_id long, html string"), "/")
    assert sorted((r.link_no, r.link) for r in links.collect()) == [(0, "/a"), (1, "/b"), (2, "/c"), (3, "/d")]
