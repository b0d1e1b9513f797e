"""Quality rules: word statistics, and perplexity bands of Kneser-Ney models per language.

Spark counts the word bigrams of all documents, and the spelling (grams of
character classes), one model each per listed language and one for all other
languages. Every document is then scored three times: by the word model of its
language, without the document's own occurrences, and by spelling, by the
model of its language, and stretch by stretch by whichever language model
expects the stretch best. Exact quartiles of the scores, per language, give
an upper bound of the words' score, a lower bound of the second and an upper
bound of the third, beyond which a document is rejected: words in disorder are
not expected by the word model; text in two languages is expected by one
spelling or the other, noise by none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import checkpointed, ship, shuffles_dropped
from matchlake.llm import word_model
from matchlake.llm.ngram_model import CLASS_NATS, CODES, KneserNey, codes

LANGUAGES = ("en", "de", "fr", "es")
OTHER = "other"
# A band reaches this many quartile distances (and at least so many nats per character) below the lower and above
# the upper quartile; above, it reaches no more than MOST_ABOVE, however widely noisy texts spread the quartiles.
REACH = (5.0, 10.0)
LEAST_REACH = (0.1, 0.5)
MOST_ABOVE = 0.8
# The same for the words' score, in nats a word; only its upper bound counts.
WORD_REACH = (5.0, 0.5)
LEAST_WORD_REACH = (0.1, 1.5)
MOST_ABOVE_WORDS = 3.0
# Characters of a stretch that one language model is chosen for.
STRETCH = 64
# Scores are binned to 1/BINS nat for the quartiles.
BINS = 1000

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def word_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = text.encode().split()
    if not words:
        return 0, 0, len(_SYMBOLS.findall(text)), 0, 0
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(words), chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that stand twice or more in the list."""
    if len(words) < 4:
        return 0
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 21:
        # Three numbers would not fit 63 bits.
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    in_order = np.sort(windows)
    if (in_order[1:] != in_order[:-1]).all():
        return 0
    _, window, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = (count > 1)[window]
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def model_name(lang: Column, languages: tuple[str, ...]) -> Column:
    return F.when(lang.isin(*languages), lang).otherwise(OTHER)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram counts of a partition: one row per model and gram, at most ``CODES`` per model."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                if name not in totals:
                    totals[name] = np.zeros(CODES, dtype=np.int64)
                np.add.at(totals[name], codes(text.encode()), 1)
    for name, total in totals.items():
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(grams)), pa.array(grams.astype(np.int32)), pa.array(total[grams])],
            names=["model", "gram", "n"],
        )


def fit_models(rows: DataFrame) -> dict[str, KneserNey]:
    """Models of the (``model``, ``text``) rows. What reaches the driver is at most ``CODES`` rows per model."""
    with shuffles_dropped(rows.sparkSession):
        counts = rows.mapInArrow(_count, "model string, gram int, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))
        table = counts.toPandas()
    return {
        name: KneserNey(part["gram"].to_numpy(), part["n"].to_numpy())
        for name, part in table.sort_values("gram").groupby("model")
    }


_SCORED = (
    "row long, model string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "nats double, best_nats double, word_nats double"
)


def _scorer(models, words: word_model.WordModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``models``: broadcast variable with the models of spelling; ``words``: the model of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(models.value)
        # Log probabilities of every code that a partition meets, by all models, filled from the hash arrays on first sight.
        logs = np.zeros((CODES, len(names)), dtype=np.float32)
        known = np.zeros(CODES, dtype=bool)
        # Texts of unlisted languages may be anything, so their model is no measure for the listed ones.
        listed = [k for k, name in enumerate(names) if name != OTHER]
        for number, ids, kinds_of, texts in word_model.chunks(batches):
            rows = []
            for name, text in zip(kinds_of, texts, strict=True):
                statistics = word_statistics(text)
                nats = best = None
                if text and name in names:
                    found = codes(text.encode())
                    new = np.unique(found[~known[found]])
                    if len(new):
                        for k, model in enumerate(models.value.values()):
                            logs[new, k] = model.log_probabilities(new) - CLASS_NATS[new % len(CLASS_NATS)]
                        known[new] = True
                    sums = -np.add.reduceat(logs[found], np.arange(0, len(found), STRETCH), axis=0, dtype=np.float64)
                    own = names.index(name)
                    nats = float(sums[:, own].sum() / len(found))
                    best = float(sums[:, sorted({own, *listed})].min(axis=1).sum() / len(found))
                rows.append((*statistics, nats, best))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(kinds_of, pa.string()),
                    *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    pa.array(words.nats(number, kinds_of, texts), from_pandas=True),
                ],
                names=["row", "model", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "nats", "best_nats", "word_nats"],
            )

    return run


def bands(
    scored: DataFrame,
    reach: tuple[float, float] = REACH,
    least: tuple[float, float] = LEAST_REACH,
    score: str = "nats",
    most: float = MOST_ABOVE,
) -> dict[str, tuple[float, float]]:
    """Lower and upper bound of the nats per character, per model, from all documents that have enough words."""
    binned = scored.where((F.col("n_words") >= MIN_WORDS) & F.col(score).isNotNull())
    binned = binned.groupBy("model", F.floor(F.col(score) * BINS).alias("bin")).agg(F.count("*").alias("n"))
    out = {}
    # Nats per character lie between 0 and a small number, so a model has a few thousand bins at most.
    for name, part in binned.toPandas().groupby("model"):
        part = part.sort_values("bin")
        share = part["n"].cumsum().to_numpy() / part["n"].sum()
        low, high = (float(part["bin"].to_numpy()[np.searchsorted(share, q)]) / BINS for q in (0.25, 0.75))
        below, above = (max(r * (high - low), floor) for r, floor in zip(reach, least, strict=True))
        out[name] = (low - below, high + min(above, most))
    return out


def assess(
    docs: DataFrame,
    languages: tuple[str, ...] = LANGUAGES,
    reach: tuple[float, float] = REACH,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Per row of ``docs``: id, word statistics, ``perplexity`` (per character, by the model of the row's language),
    ``base_failed`` and ``kept``.

    Words are runs without ASCII white space; a null text is empty. A text
    without characters has a null perplexity and fails the base rules. A null
    or unlisted language uses the model of all such rows. Null ids and repeated
    rows stay as they are; other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("row"),
        model_name(F.col(lang_col), languages).alias("model"),
        F.col(text_col).alias("text"),
    )
    models = docs.sparkSession.sparkContext.broadcast(fit_models(rows.select("model", "text")))
    words = word_model.fit(rows, [*languages, OTHER])
    scored = checkpointed(rows.mapInArrow(_scorer(models, words), _SCORED))
    words.drop(docs.sparkSession)
    inside = F.lit(False)
    lower, upper = bands(scored, reach), bands(scored, reach, score="best_nats")
    ordered = bands(scored, WORD_REACH, LEAST_WORD_REACH, "word_nats", most=MOST_ABOVE_WORDS)
    for name in lower:
        low, high = lower[name][0], upper[name][1]
        spelled = (F.col("nats") >= low) & (F.col("best_nats") <= high)
        inside = inside | ((F.col("model") == name) & spelled & (F.col("word_nats") <= ordered[name][1]))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return scored.select(
        F.col("row").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(inside, F.lit(False))).alias("kept"),
        F.exp("nats").alias("perplexity"),
        F.exp("word_nats").alias("word_perplexity"),
        F.col("model").alias("language"),
    )
