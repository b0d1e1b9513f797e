"""License statements found by ordered signature rules.

A text's words are looked up in the rules' keywords; only rules whose keywords
stand in the text run their regex, over the whole normalised text. Overlapping
detections are resolved by one sweep per document in order of start, longest
first: a detection inside an earlier interval of the same or a surer rule goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import plain_words
from matchlake.llm.license_rules import Rule, rules

# Fixed phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


def _stands(words: Column, phrase: Column, size: int) -> Callable[[Column], Column]:
    return lambda i: F.slice(words, i, size) == phrase


def _place(label: str) -> Callable[[Column], Column]:
    return lambda i: F.struct((i - 1).alias("start"), F.lit(label).alias("label"))


def _phrase_places(words: Column) -> Column:
    """Array of (start word, label) of the fixed phrases; texts without their rarest word are not searched."""
    none = F.array().cast("array<struct<start:int,label:string>>")
    found = []
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        rare = max(parts, key=len)
        target = F.array(*[F.lit(p) for p in parts])
        starts = F.filter(F.sequence(F.lit(1), F.size(words)), _stands(words, target, len(parts)))
        places = F.transform(starts, _place(label))
        found.append(F.when(F.array_contains(words, rare), places).otherwise(none))
    return F.concat(none, *found)


def _matches(words: Column, present: Column, table: list[Rule]) -> Column:
    """Array of (rule fields, gap length, match length) in text order per rule; gaps are the text between matches."""
    literal = F.array(*[
        F.struct(
            F.lit(n).alias("rule"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"),
            F.array(*[F.array(*[F.lit(k) for k in one]) for one in r.keywords]).alias("keywords"),
            F.lit(r.pattern).alias("pattern"), F.lit(r.score).alias("score"),
        )
        for n, r in enumerate(table)
    ])

    def active(found: Column) -> Column:
        return F.filter(literal, lambda r: F.forall(r["keywords"], lambda one: F.arrays_overlap(found, one)))

    def lengths(text: Column, rule: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), lambda m: F.length(m))
        gaps = F.transform(F.split(text, rule["pattern"]), lambda g: F.length(g))
        return F.transform(F.arrays_zip(hits.alias("hit"), gaps.alias("gap")), lambda x, i: F.struct(
            rule["rule"].alias("rule"), rule["priority"].alias("priority"), rule["label"].alias("label"),
            rule["score"].alias("score"), i.alias("nth"), x["gap"].alias("gap"), x["hit"].alias("length"),
        ))

    def of_text(bound: Column) -> Column:
        matches = F.transform(active(bound["found"]), lambda rule: lengths(bound["text"], rule))
        # The gap after the last match has no match of its own.
        return F.filter(F.flatten(matches), lambda m: m["length"].isNotNull())

    none = F.array().cast(
        "array<struct<rule:int,priority:int,label:string,score:double,nth:int,gap:int,length:int>>"
    )
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    # One bound value: inside the function neither the text nor the keywords are computed again per rule.
    bound = F.array(F.struct(text.alias("text"), present.alias("found")))
    return F.when(F.size(present) > 0, F.flatten(F.transform(bound, of_text))).otherwise(none)


def detections(
    docs: DataFrame, table: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document and surviving detection, or one row with null ``rule`` for a document without any.

    Columns: ``doc``, ``body`` (hash of the text), ``n_words`` and ``places`` (fixed
    phrases; both set on one row of each document, null on its others), ``rule``, ``priority``, ``label``, ``score``, ``start`` and ``end``
    (offsets in the normalised text). Rows equal in id and text are one
    document; a null or wordless text has no words; other columns are ignored.
    """
    table = rules() if table is None else table
    text = F.col(text_col)
    words = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("body"), plain_words(text).alias("words"))
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in table for one in r.keywords for k in one})])
    present = F.array_intersect("words", keywords)
    # Per-document columns are computed below the explode and kept on its first row only: a text with
    # many statements carries its phrase places once, not once per detection.
    per_doc = words.select(
        "doc", "body", F.size("words").alias("n_words"), _phrase_places(F.col("words")).alias("places"),
        _matches(F.col("words"), present, table).alias("ms"),
    )
    found = per_doc.select("doc", "body", "n_words", "places", F.posexplode_outer("ms").alias("pos", "m"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    found = found.select(
        "doc", "body", F.when(first, F.col("n_words")).alias("n_words"),
        F.when(first, F.col("places")).alias("places"), "m.*",
    )
    # Offsets and suppression are sums and maxima in text order within a document.
    found = found.repartition("doc", "body").dropDuplicates(["doc", "body", "rule", "nth"])
    in_rule = Window.partitionBy("doc", "body", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(in_rule))
    found = found.withColumn("start", F.col("end") - F.col("length"))
    before = (
        Window.partitionBy("doc", "body")
        .orderBy("start", F.desc("end"), "priority", "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.lit(False)
    for level in sorted({r.priority for r in table}):
        reach = F.max(F.when(F.col("priority") <= level, F.col("end"))).over(before)
        inside = inside | ((F.col("priority") == level) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    found = found.withColumn("inside", inside)
    kept = found.withColumn("live", F.col("rule").isNotNull() & ~F.col("inside"))
    return kept.select("doc", "body", "n_words", "places", "rule", "priority", "label", "score", "start", "end", "live")


def scan(docs: DataFrame, table: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``n_words``, ``places`` of fixed phrases, distinct ``base_labels`` and ``labels`` (sorted arrays) and ``score``.

    ``labels`` adds what the rules found; ``score`` is that of the surest statement, 1 for a fixed phrase, else 0.
    """
    found = detections(docs, table, id_col, text_col)
    per_doc = found.groupBy("doc", "body").agg(
        F.first("n_words", ignorenulls=True).alias("n_words"),
        F.first("places", ignorenulls=True).alias("places"),
        F.collect_set(F.when(F.col("live"), F.col("label"))).alias("own"),
        F.max(F.when(F.col("live"), F.col("score"))).alias("surest"),
    )
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return per_doc.select(
        F.col("doc").alias(id_col),
        "body",
        F.col("n_words").cast("long").alias("n_words"),
        "places",
        base.alias("base_labels"),
        F.array_sort(F.array_union(base, F.col("own"))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("surest", F.lit(0.0))).alias("score"),
    )
