"""Tables of untidy pages, read as a stream of tag tokens with a running depth.

A comment's markup is cut into tokens: comments, tags (a quoted attribute
value may hold ``>``), text, and a lone ``<``. Tokens become rows, dealt by
page once; every later step is a window or a group whose key starts with the
page, so no other exchange follows.

* Table depth is the running sum of ``<table>`` (+1) and ``</table>`` (-1),
  held at zero (``S - min(0, running min of S)``), so that a stray
  ``</table>`` is ignored; a table left open ends with its comment.
* A token belongs to the innermost open table: the last table opened at its
  depth. Tables are numbered from 0 in the order of their start tags over all
  comments of a page, nested ones included, each with its own rows only.
* Rows are the ``<tr>`` tags of a table; a cell (``<td>``, ``<th>``) runs until
  its end tag, the next cell or row, a head or body tag, or the end of its
  table, as HTML parsers close them. Cells before the first ``<tr>`` are left out.
* A row is in the head if the last head/body tag of its table before it is an
  open ``<thead>``.

Each table is written back as tidy markup -- ``<table id class>``, optional
``<thead>``, ``<tbody>``, ``<tr class>``, ``<th>``/``<td>`` with explicit ends --
in which every other tag keeps only its name and nested tables are left out.
The cell, row and header rules then read plain, well-formed, flat tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMMENT = r"(?s)<!--(.*?)-->"
# A comment, a tag (quoted values may hold '>'; the last one may run to the end), text, or a lone '<'.
_TOKEN = r"""<!--[\s\S]*?-->|<[A-Za-z/!?](?:[^>"']|"[^"]*"|'[^']*')*>?|[^<]+|<"""
_NAME = r"^</?([A-Za-z][A-Za-z0-9]*)"


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag, quoted either way or bare; '' if absent."""
    pattern = r"(?is)^<[a-z][a-z0-9]*\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\s" + name + r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat_ws("", *[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.translate(value, '"<>', "'()")


def tokens(pages: DataFrame) -> DataFrame:
    """(page_id, comment_no, pos, token) of the comments of a page that mention a table; dealt by page."""
    comments = F.regexp_extract_all("html", F.lit(_COMMENT), 1)
    tabled = pages.select("page_id", comments.alias("comments")).where(F.exists("comments", lambda c: c.rlike("(?i)<table")))
    per = tabled.repartition("page_id").select("page_id", F.posexplode("comments").alias("comment_no", "comment"))
    per = per.where(F.col("comment").rlike("(?i)<table"))
    return per.select("page_id", "comment_no", F.posexplode(F.regexp_extract_all("comment", F.lit(_TOKEN), 0)).alias("pos", "token"))


def placed(toks: DataFrame) -> DataFrame:
    """Tokens inside tables: page_id, table_no, pos, token, name, end (bool), level, opened (the number of a table start, else null)."""
    name = F.lower(F.regexp_extract("token", _NAME, 1))
    end = F.col("token").startswith("</")
    x = toks.select("page_id", "comment_no", "pos", "token", name.alias("name"), end.alias("end"))
    is_table = F.col("name") == "table"
    delta = F.when(is_table & ~F.col("end"), 1).when(is_table & F.col("end"), -1).otherwise(0)
    flow = Window.partitionBy("page_id", "comment_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("total", F.sum(delta).over(flow))
    x = x.withColumn("depth", F.col("total") - F.least(F.lit(0), F.min("total").over(flow)))
    before = F.lag("depth", 1, 0).over(Window.partitionBy("page_id", "comment_no").orderBy("pos"))
    level = F.when(is_table & F.col("end"), F.when(before > 0, F.col("depth") + 1).otherwise(0)).otherwise(F.col("depth"))
    starts = Window.partitionBy("page_id").orderBy("comment_no", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(is_table & ~F.col("end"), F.sum((is_table & ~F.col("end")).cast("int")).over(starts) - 1)
    x = x.select("*", level.alias("level"), opened.alias("opened"))
    same = Window.partitionBy("page_id", "comment_no", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.where(F.col("level") > 0).withColumn("table_no", F.last("opened", ignorenulls=True).over(same))
    return x.select("page_id", "table_no", "comment_no", "pos", "token", "name", "end", "level", "opened")


def _inner(token: Column, name: Column, end: Column) -> Column:
    """A content token as written back: text as it is, a tag by its name only, comments dropped."""
    return (
        F.when(token.startswith("<!"), F.lit(""))
        .when(name != "", F.concat(F.lit("<"), F.when(end, "/").otherwise(""), name, F.lit(">")))
        .when(token == "<", F.lit("&lt;"))
        .otherwise(token)
    )


def _joined(pieces: str) -> Column:
    """Texts ``h`` of (place, h) pieces, in order of their places."""
    return F.array_join(F.transform(F.array_sort(F.col(pieces)), lambda s: s["h"]), "")


def tidy_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, table): every table of the page's comments as tidy, flat markup."""
    x = placed(tokens(pages))
    start = ~F.col("end")
    cell_tag = F.col("name").isin("td", "th")
    section = F.col("name").isin("thead", "tbody", "tfoot")
    own_end = (F.col("name") == "table") & F.col("end")
    in_table = Window.partitionBy("page_id", "table_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row_start = (F.col("name") == "tr") & start
    closes = (cell_tag & F.col("end")) | (F.col("name") == "tr") | section | own_end
    event = F.when(cell_tag & start, 1).when(closes, 0)
    head_now = F.when(section & start, F.col("name") == "thead").when(section & F.col("end"), F.lit(False))
    x = x.select(
        "*",
        F.sum(row_start.cast("int")).over(in_table).alias("rn"),
        F.last(event, ignorenulls=True).over(in_table).alias("open"),
        F.coalesce(F.last(head_now, ignorenulls=True).over(in_table), F.lit(False)).alias("in_head"),
        (cell_tag & start).alias("cell_start"),
    )
    in_row = Window.partitionBy("page_id", "table_no", "rn").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("col", F.sum(F.col("cell_start").cast("int")).over(in_row) - 1)
    # cells: their own tag and the tokens while they are open. What rows and tables need travels along, so that the
    # tokens are read once; all others go before they are grouped.
    in_cell = (F.col("rn") > 0) & (F.col("open") == 1) & (F.col("col") >= 0)
    is_start = (F.col("name") == "table") & start & F.col("opened").isNotNull()
    x = x.where(in_cell | row_start | is_start | ((F.col("name") == "thead") & start))
    piece = F.when(~F.col("cell_start"), _inner(F.col("token"), F.col("name"), F.col("end")))
    along = ["is_row", "row_head", "class", "tag", "has_head"]
    cells = x.groupBy("page_id", "table_no", "rn", "col").agg(
        F.max(F.when(in_cell & F.col("cell_start"), F.col("name"))).alias("cell"),
        F.collect_list(F.when(in_cell, F.struct("pos", piece.alias("h")))).alias("inside"),
        F.max(F.when(row_start, True)).alias("is_row"),
        F.max(F.when(row_start, F.col("in_head"))).alias("row_head"),
        F.max(F.when(row_start, _attribute(F.col("token"), "class"))).alias("class"),
        F.max(F.when(is_start, F.col("token"))).alias("tag"),
        F.max(((F.col("name") == "thead") & start).cast("int")).alias("has_head"),
    )
    cell_html = F.concat(F.lit("<"), F.col("cell"), F.lit(">"), _joined("inside"), F.lit("</"), F.col("cell"), F.lit(">"))
    rows = cells.groupBy("page_id", "table_no", "rn").agg(
        F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("col", cell_html.alias("h")))).alias("cells"),
        *[F.max(name).alias(name) for name in along],
    )
    row_html = F.concat(
        F.when(F.col("class") != "", F.concat(F.lit('<tr class="'), F.col("class"), F.lit('">'))).otherwise(F.lit("<tr>")),
        _joined("cells"),
        F.lit("</tr>"),
    )
    # Tables of pages without an id have no rows.
    known = F.col("is_row") & F.col("page_id").isNotNull()
    joined = rows.groupBy("page_id", "table_no").agg(
        F.array_sort(
            F.collect_list(F.when(known, F.struct("rn", F.col("row_head").alias("in_head"), row_html.alias("h"))))
        ).alias("rows"),
        F.max("tag").alias("tag"),
        F.max("has_head").alias("has_head"),
    )
    rows_of = lambda head: F.array_join(
        F.transform(F.filter(F.coalesce("rows", F.array()), lambda r: r["in_head"] == head), lambda r: r["h"]), ""
    )
    table_id, table_class = _attribute(F.col("tag"), "id"), _attribute(F.col("tag"), "class")
    opening = F.concat(
        F.lit("<table"),
        F.when(table_id != "", F.concat(F.lit(' id="'), table_id, F.lit('"'))).otherwise(F.lit("")),
        F.when(table_class != "", F.concat(F.lit(' class="'), table_class, F.lit('"'))).otherwise(F.lit("")),
        F.lit(">"),
    )
    head = F.when(F.col("has_head") == 1, F.concat(F.lit("<thead>"), rows_of(True), F.lit("</thead>"))).otherwise(F.lit(""))
    table = F.concat(opening, head, F.lit("<tbody>"), rows_of(False), F.lit("</tbody></table>"))
    return joined.select("page_id", F.col("table_no").cast("int").alias("table_no"), table.alias("table"))
