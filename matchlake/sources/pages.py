"""Stat tables hidden in HTML comments of raw pages.

Everything up to the cell level stays inside the row of its page (array functions on
the page text), so extraction is a narrow job without a shuffle, whatever the number of
tables per page.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.sources import markup

_COMMENT = r"(?s)<!--(.*?)-->"
_TABLE = r"(?is)(<table\b.*?</table\s*>)"
_HEAD = r"(?is)<thead\b[^>]*>(.*?)</thead\s*>"
_BODY = r"(?is)<tbody\b[^>]*>(.*?)</tbody\s*>"
# A row or cell ends at its closing tag or, when that is left out, at the next one.
_ROW = r"(?is)(<tr\b[^>]*>.*?)(?=</tr\s*>|<tr\b|\z)"
_CELL = r"(?is)(<t[hd]\b[^>]*>.*?)(?=</t[hd]\s*>|<t[hd]\b|\z)"
_HEAD_CELL = r"(?is)(<th\b[^>]*>.*?)(?=</th\s*>|<t[hd]\b|\z)"
_ANCHOR = r"(?is)<a\b[^>]*>(.*?)</a\s*>"
_HEAD_ROW = r"(?is)^<tr\b[^>]*?\sclass\s*=\s*[\"'](?:[^\"']*\s)?thead(?:\s[^\"']*)?[\"']"
_TAG = r"(?s)<[^>]*>"
_ENTITY = r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);"
_EDGES = r"(?U)^\s+|\s+$"
# White space next to a tag or at either end of the text.
_EDGES_OF_NODE = r"(?U)(?:^|(?<=>))\s+|\s+(?=<|$)"


# name=character pairs of the standard entities, as one constant map.
_NAMED = "\n".join(f"{name}={chr(code)}" for name, code in {**name2codepoint, "apos": 39}.items())


# Characters of the numbers 128 to 159, for those that the Windows code page has.
_WINDOWS = "\n".join(
    f"{n}={bytes([n]).decode('cp1252')}" for n in range(128, 160) if bytes([n]).decode("cp1252", "ignore")
)


def _entity(name: Column) -> Column:
    """The character an entity name stands for; null when unknown."""
    known = F.str_to_map(F.lit(_NAMED), F.lit("\n"), F.lit("="))
    long_ = F.length(name) > 10
    digits = F.when(long_, "FFFFFFFFF").when(name.rlike("^#[xX]"), F.substring(name, 3, 9))
    digits = digits.otherwise(F.conv(F.substring(name, 2, 10), 10, 16))
    code = F.conv(digits, 16, 10).cast("decimal(20,0)")
    # Numbers that are no character become U+FFFD, as browsers do; 128 to 159 stand for Windows characters.
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & (F.length(digits) <= 8)
    bytes_ = F.unhex(F.lpad(F.when(valid, digits).otherwise("FFFD"), 8, "0"))
    old = F.try_element_at(F.str_to_map(F.lit(_WINDOWS), F.lit("\n"), F.lit("=")), F.when(valid, code.cast("int").cast("string")))
    numeric = F.coalesce(old, F.decode(bytes_, "UTF-32"))
    return F.when(name.startswith("#"), numeric).otherwise(F.try_element_at(known, name))


def decode_entities(text: Column) -> Column:
    """Named and numeric character references replaced by their characters."""

    def decoded(piece: Column) -> Column:
        char = _entity(F.regexp_extract(piece, "^" + _ENTITY, 1))
        return F.coalesce(F.concat(char, F.regexp_replace(piece, "^" + _ENTITY, "")), piece)

    pieces = F.transform(F.split(text, f"(?={_ENTITY})"), decoded)
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def plain_text(html: Column) -> Column:
    """Tags dropped, entities decoded, outer white space removed."""
    return strip(decode_entities(F.regexp_replace(html, _TAG, "")))


def joined_text(html: Column) -> Column:
    """Like :func:`plain_text`, with every text node stripped before joining."""
    nodes = F.split(F.regexp_replace(html, _EDGES_OF_NODE, ""), _TAG)
    return decode_entities(F.array_join(nodes, ""))


def link_html(cell: Column) -> Column:
    """Inside of the first link of a cell, else the cell."""
    return F.when(cell.rlike(_ANCHOR), F.regexp_extract(cell, _ANCHOR, 1)).otherwise(cell)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of the first tag in ``tag``; empty text if absent."""
    pattern = r"(?is)^<[a-z]+\b[^>]*?\s" + name + r"\s*=\s*([\"'])(.*?)\1"
    return F.regexp_extract(tag, pattern, 2)


def extract_comments(pages: DataFrame, only_tables: bool = False) -> DataFrame:
    """(page_id, comment_no, comment) for every HTML comment."""
    found = F.regexp_extract_all("html", F.lit(_COMMENT), 1)
    rows = pages.select("page_id", F.posexplode(found).alias("comment_no", "comment"))
    return rows.filter(F.col("comment").contains("<table")) if only_tables else rows


def page_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, table): tables of all comments of a page, numbered from 0, nested ones too,
    each written back as tidy flat markup from a stream of tag tokens (see :mod:`matchlake.sources.markup`)."""
    return markup.tidy_tables(pages)


def _rows(part: Column) -> Column:
    return F.regexp_extract_all(part, F.lit(_ROW), 1)


def _cells(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(_CELL), 1)


def extract_table_cells(tables: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, col_no, value, is_header) for every cell."""
    rows = tables.select("page_id", "table_no", F.posexplode(_rows(F.col("table"))).alias("row_no", "row"))
    cells = rows.select("page_id", "table_no", "row_no", F.posexplode(_cells(F.col("row"))).alias("col_no", "cell"))
    is_header = F.col("cell").rlike("(?i)^<th").cast("int")
    return cells.select(
        "page_id", "table_no", "row_no", "col_no", plain_text(F.col("cell")).alias("value"), is_header.alias("is_header")
    )


def table_headers(tables: DataFrame) -> DataFrame:
    """Adds ``headers``, all header texts of the table head in order."""
    head = F.regexp_extract("table", _HEAD, 1)
    cells = F.regexp_extract_all(head, F.lit(_HEAD_CELL), 1)
    return tables.withColumn("headers", F.transform(cells, plain_text))


def _by_cell(rows: DataFrame) -> DataFrame:
    """(head, cells) arrays of a row to one row per position, still as raw HTML."""
    return rows.select(
        "page_id", "table_no", "row_no", "head", F.posexplode("cells").alias("col_no", "cell")
    ).withColumn("head", F.get("head", F.col("col_no")))


def align_player_rows(tables: DataFrame) -> DataFrame:
    """Body cells under the last head row; repeated head rows skipped, short rows padded with ''."""
    last_head = F.element_at(_rows(F.regexp_extract("table", _HEAD, 1)), -1)
    rows = tables.select(
        "page_id",
        "table_no",
        F.regexp_extract_all(last_head, F.lit(_HEAD_CELL), 1).alias("head"),
        F.filter(
            _rows(F.regexp_extract("table", _BODY, 1)), lambda row: ~row.rlike(_HEAD_ROW) & row.rlike(r"(?i)<t[hd]\b")
        ).alias("body"),
    ).select("page_id", "table_no", "head", F.posexplode("body").alias("row_no", "row"))
    rows = rows.select("page_id", "table_no", "row_no", "head", _cells(F.col("row")).alias("cells"))
    missing = F.greatest(F.size("head") - F.size("cells"), F.lit(0))
    cells = _by_cell(rows.withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), missing))))
    return cells.select(
        "page_id", "table_no", "row_no", "col_no",
        plain_text(F.col("head")).alias("header"),
        plain_text(link_html(F.col("cell"))).alias("value"),
    )


def align_team_rows(tables: DataFrame) -> DataFrame:
    """Body cells under all head cells (or the first body row); blank rows dropped,
    headers and rows cut to the shorter of headers and first row."""
    has_head = F.col("table").rlike(r"(?i)<thead\b")
    parts = tables.select(
        "page_id",
        "table_no",
        has_head.alias("has_head"),
        F.regexp_extract_all(F.regexp_extract("table", _HEAD, 1), F.lit(_HEAD_CELL), 1).alias("head"),
        _rows(F.regexp_extract("table", _BODY, 1)).alias("body"),
    )
    filled = F.filter("body", lambda row: strip(F.regexp_replace(F.array_join(_cells(row), ""), _TAG, "")) != "")
    parts = parts.select(
        "page_id",
        "table_no",
        F.when(F.col("has_head"), F.col("head")).otherwise(_cells(F.get("body", F.lit(0)))).alias("head"),
        filled.alias("body"),
    ).filter((F.size("body") > 0) & F.col("head").isNotNull())
    first = F.size(_cells(F.get("body", F.lit(0))))
    rows = parts.withColumn("width", F.least(F.size("head"), first)).select(
        "page_id", "table_no", "head", "width", F.posexplode("body").alias("row_no", "row")
    )
    rows = rows.select("page_id", "table_no", "row_no", "head", "width", _cells(F.col("row")).alias("cells"))
    padded = F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.col("width")))
    cells = _by_cell(rows.withColumn("cells", F.slice(padded, F.lit(1), F.col("width"))))
    return cells.select(
        "page_id", "table_no", "row_no", "col_no",
        joined_text(F.col("head")).alias("header"),
        joined_text(F.col("cell")).alias("value"),
    )


def classify_tables(tables: DataFrame) -> DataFrame:
    """(page_id, table_type, table_no): first Player table and first Squad table of a page.

    Player tables list a squad too, so a Player header decides first.
    """
    kinds = table_headers(tables).select(
        "page_id",
        "table_no",
        F.when(F.array_contains("headers", "Player"), "Player")
        .when(F.array_contains("headers", "Squad"), "Squad")
        .alias("table_type"),
    )
    known = kinds.filter(F.col("table_type").isNotNull())
    return known.groupBy("page_id", "table_type").agg(F.min("table_no").alias("table_no"))


def table_slug(table_id: Column, classes: Column, ordinal: Column) -> Column:
    """File-name part of a table: its id, else its classes, else table<ordinal>; 30 characters."""
    joined = F.array_join(F.split(F.trim(classes), r"\s+"), "_")
    name = F.coalesce(
        F.nullif(table_id, F.lit("")), F.nullif(joined, F.lit("")), F.concat(F.lit("table"), ordinal.cast("string"))
    )
    return F.substring(F.regexp_replace(name, r"(?U)[^\w\-]", "_"), 1, 30)


def with_slug(tables: DataFrame) -> DataFrame:
    table = F.col("table")
    return tables.withColumn(
        "slug", table_slug(_attribute(table, "id"), _attribute(table, "class"), F.col("table_no") + 1)
    )
