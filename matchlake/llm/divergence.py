"""Source divergence audit: how far each (lang, source) group's smoothed term
distribution stands from the other sources of its language and from the
language as a whole.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A
language keeps the ``V`` terms found in at least ``min_docs`` of its
documents. A group with ``N`` occurrences of kept terms gives a kept term with
``count`` occurrences the integer probability
``p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``; the language
the same over all its documents. All arithmetic is exact on longs.

* ``pair`` rows: for each other source of the language, the sum over all kept
  terms of ``|p - p'|``, ranked.
* ``term`` rows: the group's terms with ``p > q`` (``q`` the language's), value
  ``p - q``, the first ``top`` ranks.

Count cells. A term's ``p`` and ``q`` depend only on its (group count,
language count) cell, so the ``term`` part groups terms by cell, evaluates
``p - q`` once per cell, merges cells of equal value, ranks values by their
cumulative multiplicity and expands only the values that reach the first
``top`` ranks back to their terms, in UTF-8 order. A group with a third of the
corpus never needs a window over its whole vocabulary.

The ``pair`` sums run over every kept term, present or not. They are split
exactly: ``V * g(0, 0)`` for the terms neither source has, count cells of each
source against the other's zero, and cells of the terms both have, from a
join on (lang, term) of the sources that have the term; no (term, pair) row
is made for a term that only one or neither source has.

Defined results: null text, lang and source read as ''; a group without
terms still has its ``pair`` rows (value 0 if ``V`` is 0) and no ``term``
rows; a language with one source has no ``pair`` rows; repeated rows count
as often as they occur; an empty table gives no rows; extra input columns
are ignored whatever their names. Ranks run from 1 per (lang, source, part),
value descending, item ascending in UTF-8 byte order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import checkpointed, ship

# Bytes of a text as its terms have them: A-Z lower-cased, letters and bytes beyond ASCII kept, all others a space.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Terms of groups that a task counts before it gives them out.
HELD = 400_000

# Fixed values of the contract.
MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50


def prob(count: str, den: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / den) of the named long columns; ``div`` of positive longs is floor; null where den <= 0."""
    return F.expr(f"CASE WHEN {den} > 0 THEN 1 + (CAST({SCALE} AS BIGINT) * (CAST({count} AS BIGINT) + {SMOOTH})) div {den} END")


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group and term of a partition: occurrences and documents, given out whenever ``HELD`` terms are counted."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in found.items():
            # Both were counted in step, so their terms stand in one order.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(lang), len(count)), pa.repeat(pa.scalar(source), len(count)),
                    pa.array(count, pa.binary()), pa.array(count.values(), pa.int64()), pa.array([docs[t] for t in count], pa.int64()),
                ],
                names=["lang", "source", "term", "c", "df"],
            )

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            terms = (text or b"").translate(_TO_TERMS).split()
            if terms:
                count, docs = found.setdefault((lang, source), (Counter(), Counter()))
                before = len(count)
                count.update(terms)
                docs.update(set(terms))
                held += len(count) - before
        if held >= HELD:
            yield from out()
            found, held = {}, 0
    yield from out()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, c, df) for every term of a group, and the groups (lang, source) that occur.

    Every partition counts the occurrences and documents of its (group, term)
    rows, and one ``groupBy`` adds them up, so what crosses the shuffle is at
    most the distinct (group, term) rows of a task.
    """
    ship(docs.sparkSession)
    base = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    groups = base.select("lang", "source").distinct()
    words = base.mapInArrow(_counter, "lang string, source string, term binary, c long, df long")
    counts = words.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("c").alias("c"), F.sum("df").alias("df")
    )
    return counts, groups


def audit(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value (long), rank (int); see the module."""
    counts, groups = term_counts(docs, text_col, lang_col, source_col)
    # kept terms in one window over (lang, term); only they are written, once
    by_term = Window.partitionBy("lang", "term")
    present = checkpointed(
        counts.select("lang", "source", "term", "c", F.sum("c").over(by_term).alias("cl"), F.sum("df").over(by_term).alias("dfl"))
        .where(F.col("dfl") >= min_docs)
        .select("lang", "source", "term", "c", "cl")
    )
    groups = checkpointed(groups)
    kept = present.select("lang", "term", "cl").distinct()
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("cl").alias("nl"))
    # (lang, source, term, c, cl): kept terms that the group has
    sizes = present.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    consts = (
        groups.join(langs, "lang", "left")
        .join(sizes, ["lang", "source"], "left")
        .select(
            "lang",
            "source",
            F.coalesce("v", F.lit(0)).cast("long").alias("v"),
            (F.coalesce("n", F.lit(0)) + SMOOTH * F.coalesce("v", F.lit(0))).cast("long").alias("den"),
            (F.coalesce("nl", F.lit(0)) + SMOOTH * F.coalesce("v", F.lit(0))).cast("long").alias("denl"),
        )
    )
    return _pair_part(present, consts).unionByName(_term_part(present, consts, top))


def _term_part(present: DataFrame, consts: DataFrame, top: int) -> DataFrame:
    """Count cells (c, cl) per group, values merged, cumulative multiplicity, then the first ``top`` ranks expanded."""
    cells = present.groupBy("lang", "source", "c", "cl").agg(F.count("*").alias("m"))
    cells = cells.join(consts, ["lang", "source"]).select(
        "lang", "source", "c", "cl", "m", (prob("c", "den") - prob("cl", "denl")).alias("value")
    )
    values = cells.where(F.col("value") > 0).groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    before = F.coalesce(
        F.sum("m").over(Window.partitionBy("lang", "source").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    reached = values.select("lang", "source", "value", before.alias("before")).where(F.col("before") < top)
    chosen = cells.join(reached, ["lang", "source", "value"]).select("lang", "source", "c", "cl", "value", "before")
    terms = present.join(chosen, ["lang", "source", "c", "cl"]).select("lang", "source", F.col("term").alias("item"), "value", "before")
    within = F.row_number().over(Window.partitionBy("lang", "source", "value").orderBy("item"))
    ranked = terms.withColumn("k", within).where(F.col("k") <= top).where(F.col("k") + F.col("before") <= top)
    return ranked.select(
        "lang", "source", F.lit("term").alias("part"), "item", F.col("value").cast("long").alias("value"),
        (F.col("before") + F.col("k")).cast("int").alias("rank"),
    )


def _pair_part(present: DataFrame, consts: DataFrame) -> DataFrame:
    """Sum over all V kept terms of |p_s - p_s'| for every ordered pair of sources of a language, split exactly:

    V*g00 + sum over the cells of s of m*(g(a,0) - g00) + the same for s' + sum over
    the cells (a, b) of terms both have of m*(g(a,b) - g(a,0) - g(0,b) + g00),
    where g(a, b) = |P_s(a) - P_s'(b)|.
    """
    x = consts.select("lang", F.col("source").alias("s"), F.col("den").alias("den_s"), "v")
    y = consts.select("lang", F.col("source").alias("t"), F.col("den").alias("den_t"))
    pairs = x.join(y, "lang").where(F.col("s") != F.col("t"))
    pairs = pairs.select(
        "lang", "s", "t", "v", "den_s", "den_t",
        prob("0", "den_s").alias("z_s"), prob("0", "den_t").alias("z_t"),
    ).withColumn("g00", F.coalesce(F.abs(F.col("z_s") - F.col("z_t")), F.lit(0)))  # V = 0: no terms, value 0
    # one side: cells of s against the other's zero
    own = present.groupBy("lang", "source", "c").agg(F.count("*").alias("m"))
    side = own.withColumnRenamed("source", "s").join(pairs, ["lang", "s"])
    side = side.groupBy("lang", "s", "t").agg(
        F.sum(F.col("m") * (F.abs(prob("c", "den_s") - F.col("z_t")) - F.col("g00"))).alias("h")
    )
    back = side.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), F.col("h").alias("h_back"))
    # both: terms that both sources have, as cells (a, b)
    a = present.select("lang", "term", F.col("source").alias("s"), F.col("c").alias("a"))
    b = present.select("lang", "term", F.col("source").alias("t"), F.col("c").alias("b"))
    both = a.join(b, ["lang", "term"]).where(F.col("s") != F.col("t")).groupBy("lang", "s", "t", "a", "b").agg(F.count("*").alias("m"))
    both = both.join(pairs, ["lang", "s", "t"])
    pa, pb = prob("a", "den_s"), prob("b", "den_t")
    term = F.abs(pa - pb) - F.abs(pa - F.col("z_t")) - F.abs(F.col("z_s") - pb) + F.col("g00")
    inner = both.groupBy("lang", "s", "t").agg(F.sum(F.col("m") * term).alias("i"))
    total = (
        pairs.join(side, ["lang", "s", "t"], "left")
        .join(back, ["lang", "s", "t"], "left")
        .join(inner, ["lang", "s", "t"], "left")
        .select(
            "lang",
            F.col("s").alias("source"),
            F.col("t").alias("item"),
            (F.col("v") * F.col("g00") + F.coalesce("h", F.lit(0)) + F.coalesce("h_back", F.lit(0)) + F.coalesce("i", F.lit(0)))
            .cast("long")
            .alias("value"),
        )
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return total.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.cast("int").alias("rank"))
