"""Lines repeated across documents, returned as run-length bitmaps of the lines to keep.

Line keys are hashed to 128 bits, range-partitioned by hash and sorted by
document and position. A window streams over each sorted range and marks where
a hash first occurs in a document. A common line is spread over ``SPREAD``
ranges, whose counts are summed, so that no task holds a whole hot line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import BLANKS, ascii_lower

# A line found everywhere is dealt over so many sort ranges.
SPREAD = 64


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """One row per line: document, text hash, position and 128-bit key hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text).alias("body"),
        F.posexplode(F.split(ascii_lower(text), "\n")).alias("pos", "line"),
    )
    keyed = lines.select("doc", "body", "pos", _key(F.col("line")).alias("key"))
    keyed = keyed.where(F.char_length("key") >= min_chars)
    return keyed.select("doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def first_occurrences(lines: DataFrame) -> DataFrame:
    """Per key: the number of documents with it, and its first document and position.

    Rows of one document are equal in ``doc`` and ``body``; rows equal in both
    are copies of one row and count once.
    """
    dealt = lines.withColumn("spread", F.pmod(F.xxhash64("doc", "body"), F.lit(SPREAD)))
    ranged = dealt.repartitionByRange("h1", "h2", "spread")
    order = Window.partitionBy("h1", "h2", "spread").orderBy("doc", "body", "pos")
    same = F.lag("doc").over(order).eqNullSafe(F.col("doc")) & F.lag("body").over(order).eqNullSafe(F.col("body"))
    starts = ranged.select("h1", "h2", "doc", "body", "pos", same.alias("again")).where(~F.col("again"))
    first = F.min(F.struct("doc", "body", "pos")).alias("first")
    return starts.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), first)


def drops(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    keep: str = "none",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Positions to drop per document (``doc``, ``body``, sorted array ``positions``).

    Lines whose key stands in at least ``min_docs`` documents go: all of them
    (``keep="none"``), or all but the first by document and position
    (``keep="first"``).
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep}")
    lines = _lines(docs, min_chars, id_col, text_col)
    common = first_occurrences(lines).where(F.col("n_docs") >= min_docs)
    hits = lines.join(common, ["h1", "h2"])
    if keep == "first":
        hits = hits.where(~F.struct("doc", "body", "pos").eqNullSafe(F.col("first")))
    return hits.groupBy("doc", "body").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def _runs(positions: Column, n_lines: Column) -> Column:
    """Kept stretches as (start, length), from the sorted dropped positions."""
    edges = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform(positions, lambda p: p + 1)).alias("start"),
        F.concat(positions, F.array(n_lines)).alias("end"),
    )
    runs = F.transform(edges, lambda e: F.struct(e["start"].alias("start"), (e["end"] - e["start"]).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def keep_bitmaps(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    keep: str = "none",
    id_col: str = "doc_id",
    text_col: str = "text",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Per row of ``docs``: id, text, the ``extra`` columns, ``n_lines``, ``n_dropped`` and ``keep_runs``, a run-length bitmap.

    Texts are split at ``\\n``; a null or empty text is one empty line. A key is
    the line stripped of white space at both ends, A-Z lower-cased; keys under
    ``min_chars`` code points never count. Rows with a null id are documents of
    their own text; rows equal in id and text count as one document; other
    columns are ignored, whatever their names.
    """
    found = drops(docs, min_docs, min_chars, keep, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.select(id_col, text_col, *extra, F.xxhash64(text).alias("_body"))
    found = found.select(F.col("doc").alias("_doc"), F.col("body").alias("_of"), "positions")
    match = left[id_col].eqNullSafe(found["_doc"]) & (left["_body"] == found["_of"])
    joined = left.join(found, match, "left")
    # The count of \n as a length difference, which reads the text but makes no array.
    n_lines = (F.octet_length(text) - F.octet_length(F.translate(text, "\n", "")) + 1).cast("int")
    positions = F.coalesce("positions", F.array().cast("array<int>"))
    joined = joined.select(id_col, text_col, *extra, n_lines.alias("n_lines"), positions.alias("_positions"))
    return joined.select(
        id_col,
        text_col,
        *extra,
        "n_lines",
        F.size("_positions").alias("n_dropped"),
        _runs(F.col("_positions"), F.col("n_lines")).alias("keep_runs"),
    )


def kept_text(text: Column, n_dropped: Column, keep_runs: Column) -> Column:
    """The text without its dropped lines; the kept ones joined by ``\\n``."""
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n")
    kept = F.flatten(F.transform(keep_runs, lambda r: F.slice(lines, r["start"] + 1, r["length"])))
    return F.when(n_dropped == 0, text).otherwise(F.array_join(kept, "\n"))
