"""Tables in page comments, including untidy HTML."""

import pytest
from pyspark.sql import functions as F

from matchlake.sources import pages


def tables(spark, html):
    return pages.page_tables(spark.createDataFrame([(1, html)], "page_id int, html string"))


def wide(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.row_no, []).append((r.col_no, r.header, r.value))
    return [[(h, v) for _, h, v in sorted(cells, key=lambda x: x[0])] for _, cells in sorted(out.items())]


@pytest.mark.parametrize(
    "raw,want",
    [("A &amp; B", "A & B"), ("&#233;t&#xE9;", "été"), ("&eacute;", "é"), ("&bogus;", "&bogus;"), ("a&b", "a&b"),
     ("&amp;lt;", "&lt;"), ("&#128512;", "\U0001F600"), (" x ", "x"), ("&apos;", "'"), ("", ""),
     ("&#1114112;", "\ufffd"), ("a&#99999999999;b", "a\ufffdb"), ("&#xD800;", "\ufffd"), ("&#150;&#x80;", "\u2013\u20ac"), ("&#0;", "\ufffd"), ("&#x1F600;", "\U0001F600")],
)
def test_entities(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(pages.plain_text(F.col("x"))).first()[0] == want


def test_player_rule(spark):
    html = (
        "<!--<table><thead><tr><th>Top</th></tr><tr><th>Player</th><th>Squad</th><th>Gls</th></tr></thead><tbody>"
        "<tr><th>x <a href='#'> Ann </a> y</th><td>S</td><td>1</td></tr><tr class='big thead'><th>Player</th></tr><tr></tr>"
        "<tr><th>Bob</th></tr></tbody></table>-->"
    )
    assert wide(pages.align_player_rows(tables(spark, html))) == [
        [("Player", "Ann"), ("Squad", "S"), ("Gls", "1")], [("Player", "Bob"), ("Squad", ""), ("Gls", "")],
    ]


def test_player_rule_keeps_surplus_cells(spark):
    html = "<!--<table><thead><tr><th>Player</th></tr></thead><tbody><tr><td>Ann</td><td>7</td></tr></tbody></table>-->"
    assert wide(pages.align_player_rows(tables(spark, html))) == [[("Player", "Ann"), (None, "7")]]


def test_team_rule(spark):
    html = (
        "<!-- <TABLE><THEAD><TR><TH>a</TH><TH>b</TH></TR></THEAD><TBODY><TR><TD> <b>p</b> <i> q </i> </TD><TD>1<TD>2"
        "<TR><TD> </TD><TD></TD></TR><TR><TD>z</TD></TR></TBODY></TABLE> -->"
    )
    assert wide(pages.align_team_rows(tables(spark, html))) == [[("a", "pq"), ("b", "1")], [("a", "z"), ("b", None)]]


def test_team_rule_without_head(spark):
    html = "<!--<table><tbody><tr><td>h1</td><td>h2</td></tr><tr><td>1</td><td>2</td></tr></tbody></table>-->"
    assert wide(pages.align_team_rows(tables(spark, html))) == [[("h1", "h1"), ("h2", "h2")], [("h1", "1"), ("h2", "2")]]
    assert pages.align_team_rows(tables(spark, "<!--<table><thead><tr><th>h</th></tr></thead></table>-->")).count() == 0


def test_player_header_decides_before_squad(spark):
    head = lambda *names: "<table><thead><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr></thead></table>"
    html = f"<!--{head('Player', 'Squad')}--><p><!--{head('Squad', 'x')}{head('Squad')}--><!--{head('z')}-->"
    got = {r.table_type: r.table_no for r in pages.classify_tables(tables(spark, html)).collect()}
    assert got == {"Player": 0, "Squad": 1}


def test_slug(spark):
    html = "<!--<table id='stats 1/x'></table><table class='a  b'></table><table></table>-->"
    assert [r.slug for r in pages.with_slug(tables(spark, html)).orderBy("table_no").collect()] == ["stats_1_x", "a_b", "table3"]


def test_only_comments_with_tables(spark):
    df = spark.createDataFrame([(1, "<!-- ad --><!--<table>--><!---->")], "page_id int, html string")
    assert [r.comment for r in pages.extract_comments(df).orderBy("comment_no").collect()] == [" ad ", "<table>", ""]
    assert pages.extract_comments(df, only_tables=True).count() == 1


def cells(df):
    return sorted((r.table_no, r.row_no, r.col_no, r.value, r.is_header) for r in pages.extract_table_cells(df).collect())


def test_nested_unclosed_and_quoted_markup(spark):
    html = (
        "<!--<table data-x='1 > 0'><tr><th title=\"a>b\">h<td>x<table><tr><td>in</table>y<td>z"
        "<tr><td>2</td></tr></table></table><table><tr><td>open<!-- x -->"
    )
    assert cells(tables(spark, html)) == [
        (0, 0, 0, "h", 1), (0, 0, 1, "xy", 0), (0, 0, 2, "z", 0), (0, 1, 0, "2", 0),
        (1, 0, 0, "in", 0), (2, 0, 0, "open", 0),
    ]


def test_tables_over_comments_and_stray_ends(spark):
    html = "<!--</table><table><tr><td>a &lt; b</td><td>1 < 2</td></tr>--><p><!--<TABLE><TR><TH>A<TD>B</TABLE>-->"
    assert cells(tables(spark, html)) == [(0, 0, 0, "a < b", 0), (0, 0, 1, "1 < 2", 0), (1, 0, 0, "A", 1), (1, 0, 1, "B", 0)]


def test_head_rows_and_anchor_with_quoted_close(spark):
    html = (
        "<!--<table><thead><tr><th>Player<th>Gls</thead><tbody><tr><th><a href='/x>y'>Ann</a> z<td>3"
        "<tr class='thead'><th>Player</th></tr><tr><td>Bob</table>-->"
    )
    assert wide(pages.align_player_rows(tables(spark, html))) == [
        [("Player", "Ann"), ("Gls", "3")], [("Player", "Bob"), ("Gls", "")],
    ]


def test_pages_without_tables(spark):
    df = spark.createDataFrame([(1, "<!-- no --><p>x</p>"), (2, None), (3, "<!--<table>-->")], "page_id int, html string")
    got = [(r.page_id, r.table_no, r.table) for r in pages.page_tables(df).collect()]
    assert got == [(3, 0, "<table><tbody></tbody></table>")]


def test_tokens_are_read_once(spark):
    """One token stream serves cells, rows and tables: the page text is cut once and joined with nothing."""
    from matchlake.sources import pages

    html = "<!--<table id='t'><thead><tr><th>P</th></tr></thead><tbody><tr class='x'><td>1<td>2</table>-->"
    tables = pages.page_tables(spark.createDataFrame([(1, html), (None, html)], "page_id long, html string"))
    plan = tables._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("== Initial Plan ==")[0].count("posexplode(regexp_extract_all") <= 1
    got = {r["page_id"]: r["table"] for r in tables.collect()}
    assert got[1] == "<table id=\"t\"><thead><tr><th>P</th></tr></thead><tbody><tr class=\"x\"><td>1</td><td>2</td></tr></tbody></table>"
    assert got[None] == "<table id=\"t\"><thead></thead><tbody></tbody></table>"
