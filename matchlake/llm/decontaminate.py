"""Removal of benchmark passages, by windows of normalised words.

The benchmark is turned into a set of window hashes and a set of anchors (the
longest word of each window). Both travel with the plan as literal hash sets,
of at most ``max_windows`` entries. Documents are scanned once: a window is
hashed only where it covers an anchor, hits of the hash set are verified on
their words by an equality join, and only verified places leave the scan.
A benchmark beyond the bound takes the join for every window instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import plain_words

WINDOW = 10
MAX_WINDOWS = 50_000
MAX_BYTES = 16_000_000


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: ``gram`` (words joined by a space), ``size``, ``anchor`` and ``items`` (ids as text).

    An item of fewer words than ``window`` is one window; an item without
    words, or null, has none.
    """
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), plain_words(F.col("text")).alias("words"))
    words = words.where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)
    grams = words.select("item", "size", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.col("size")))).alias("gram"))
    longest = F.array_max(F.transform("gram", lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    grams = grams.select(F.array_join("gram", " ").alias("gram"), "size", longest.alias("anchor"), "item")
    return grams.groupBy("gram", "size", "anchor").agg(F.collect_set("item").alias("items"))


def _gram(words: Column, start: Column, size: int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _all_starts(words: Column, size: int) -> Column:
    none = F.array().cast("array<int>")
    return F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(none)


def _anchored_starts(words: Column, size: int, anchors: list[str]) -> Column:
    """Starts of the windows of ``size`` words that hold an anchor, each once."""
    none = F.array().cast("array<int>")
    last = F.size(words) - size + 1
    places = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).isin(anchors))
    around = F.transform(places, lambda i: F.sequence(F.greatest(i - size + 1, F.lit(1)), F.least(i, last)))
    return F.when(last >= 1, F.array_distinct(F.flatten(around))).otherwise(none)


def _listed(words: Column, size: int, hashes: list[int]) -> Callable[[Column], Column]:
    return lambda start: F.xxhash64(_gram(words, start, size)).isin(hashes)


def _place(words: Column, size: int) -> Callable[[Column], Column]:
    return lambda start: F.struct(start.alias("start"), F.lit(size).alias("size"), _gram(words, start, size).alias("gram"))


def _within(windows: DataFrame, max_windows: int) -> bool:
    """Whether the windows are few and small enough to be sent to every task."""
    length = F.octet_length("gram") + F.octet_length(F.array_join("items", ","))
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
    return size["n"] <= max_windows and size["bytes"] <= MAX_BYTES


def _candidates(words: Column, windows: DataFrame, bounded: bool) -> Column:
    """Array of (start, size, gram) of a document's windows that may be in the benchmark."""
    if not bounded:
        sizes = [row["size"] for row in windows.select("size").distinct().collect()]
        parts = [(size, _all_starts(words, size)) for size in sizes]
    else:
        # At most max_windows rows: the sets below are bounded by it.
        rows = windows.select("size", "anchor", F.xxhash64("gram").alias("hash")).collect()
        parts = []
        for size in sorted({row["size"] for row in rows}):
            anchors = sorted({row["anchor"] for row in rows if row["size"] == size})
            hashes = sorted({row["hash"] for row in rows if row["size"] == size})
            parts.append((size, F.filter(_anchored_starts(words, size, anchors), _listed(words, size, hashes))))
    found = [F.transform(starts, _place(words, size)) for size, starts in parts]
    none = F.array().cast("array<struct<start:int,size:int,gram:string>>")
    return F.concat(none, *found)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: ``n_words``, ``spans`` (merged hit stretches as start and end word, end not included),
    ``n_hit``, ``items`` (ids as text, sorted) and ``n_items``.

    Rows equal in id and text are one document. Null or wordless texts have no
    words and no hits. Other columns are ignored, whatever their names.
    """
    windows = benchmark_windows(benchmark, window)
    bounded = _within(windows, max_windows)
    text = F.col(text_col)
    words = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("body"), plain_words(text).alias("words"))
    places = words.select("doc", "body", F.size("words").alias("n_words"), _candidates(F.col("words"), windows, bounded).alias("found"))
    places = places.select("doc", "body", "n_words", F.explode_outer("found").alias("at"))
    # A document without candidates keeps one row, under a key of its own that no window has.
    own = F.concat(F.lit(" "), F.coalesce(F.col("doc").cast("string"), F.lit("")))
    places = places.select("doc", "body", "n_words", "at.start", "at.size", F.coalesce("at.gram", own).alias("gram"))
    known = windows.select("gram", "items")
    checked = places.join(F.broadcast(known) if bounded else known, "gram", "left")
    hit = F.when(F.col("items").isNotNull(), F.struct((F.col("start") - 1).alias("start"), (F.col("start") - 1 + F.col("size")).alias("end")))
    per_doc = checked.groupBy("doc", "body", "n_words").agg(
        F.sort_array(F.collect_set(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Sorted by start, a hit opens a stretch where it begins past all ends before it.
    span = "struct<start:int,end:int>"
    zero = F.struct(F.array().cast(f"array<{span}>").alias("done"), F.lit(None).cast(span).alias("open"))
    merged = F.aggregate("hits", zero, _extend, _close)
    out = per_doc.select(F.col("doc").alias(id_col), "body", F.col("n_words").cast("long").alias("n_words"), merged.alias("spans"), "items")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return out.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))


def _extend(state: Column, hit: Column) -> Column:
    touches = state["open"].isNotNull() & (hit["start"] <= state["open"]["end"])
    longer = F.struct(state["open"]["start"].alias("start"), F.greatest(state["open"]["end"], hit["end"]).alias("end"))
    done = F.when(touches | state["open"].isNull(), state["done"]).otherwise(F.array_append(state["done"], state["open"]))
    return F.struct(done.alias("done"), F.when(touches, longer).otherwise(hit).alias("open"))


def _close(state: Column) -> Column:
    return F.when(state["open"].isNull(), state["done"]).otherwise(F.array_append(state["done"], state["open"]))


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without the words in ``spans`` and without the separators before them."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    tail = F.regexp_extract(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    edges = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"])).alias("start"),
        F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(pieces))).alias("end"),
    )
    kept = F.flatten(F.transform(edges, lambda e: F.slice(pieces, e["start"] + 1, F.greatest(e["end"] - e["start"], F.lit(0)))))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(kept, ""), tail))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    action: str = "documents",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without the contaminated documents (``action="documents"``) or without the hit words (``"spans"``).

    All columns of ``docs`` stay as they are, whatever their names; working columns take names no input column has.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"action is documents or spans, not {action}")
    names = docs.columns
    # Working names that no input column has.
    doc, body, hit_spans = ("_" * (1 + max((len(c) for c in names), default=0)) + n for n in ("doc", "body", "spans"))
    hits = scan(docs, benchmark, window, max_windows, id_col, text_col).where(F.col("n_hit") > 0)
    hits = hits.select(F.col(id_col).alias(doc), F.col("body").alias(body), F.col("spans").alias(hit_spans))
    same = docs[id_col].eqNullSafe(hits[doc]) & (F.xxhash64(docs[text_col]) == hits[body])
    if action == "documents":
        return docs.join(hits, same, "left_anti")
    joined = docs.join(hits, same, "left")
    spans = F.coalesce(hits[hit_spans], F.array().cast("array<struct<start:int,end:int>>"))
    cleaned = F.when(F.col(text_col).isNotNull(), remove_spans(F.col(text_col), spans)).alias(text_col)
    return joined.select(*[cleaned if c == text_col else F.col(c) for c in names])
