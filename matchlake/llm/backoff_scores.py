"""Stupid-backoff language model scores of documents against counts of the whole corpus.

Bigrams are exploded from the texts with numpy and travel as compressed blocks
of rows, dealt by the hash of their context word, so that a context's total
and its bigrams' counts meet in one task. Each document is scored without its
own occurrences; bigrams then unseen back off to word counts, in a second join
dealt by the hash of the word. Partial sums are added per document.

A word with more than ``1 / HEAVY`` of all occurrences would swamp its task.
There are fewer than ``HEAVY`` such words, so their counts are sent to every
task: their bigrams are dealt by the whole bigram, and back-offs to them are
resolved on the spot.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import shared_folder, ship
from matchlake.llm.hashing import mix, word_hashes

DISCOUNT = 0.4
# A word never seen elsewhere counts as this many occurrences.
UNSEEN = 0.5
HEAVY = 50_000
# Code of a word that is not heavy; above all places in the list.
_NOT_HEAVY = 65_535
# Word hashes have 56 bits, which tell apart the words of any corpus but for a vanishing share.
_HASH_BYTES = 7
_HASH_BITS = np.uint64(2**56 - 1)
_CODEC = pa.Codec("zstd", compression_level=3)
# Word occurrences per bucket, which bounds what meets in one task.
BUCKET_WORDS = 1_500_000
SLICE_BYTES = 4_000_000
# Slices whose word counts are added up before they leave a task.
MERGED_SLICES = 8

_BIGRAM = np.dtype([("w1", "u8"), ("w2", "u8"), ("doc", "i8"), ("m", "i4"), ("own1", "i4"), ("own2", "i4")])
_WORD = np.dtype([("w", "u8"), ("doc", "i8"), ("m", "i4"), ("own", "i4")])
_SUM = np.dtype([("doc", "i8"), ("score", "f8"), ("n", "i8")])
# Context of a document's first word.
_START = np.uint64(0)


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns one after the other, each compressed with all lowest bytes first; word hashes have seven bytes."""
    out = []
    for column in columns:
        planes = np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.dtype.itemsize).T
        raw = planes[: _HASH_BYTES if column.dtype == np.uint64 else None].tobytes()
        packed = _CODEC.compress(raw, asbytes=True)
        out += [len(packed).to_bytes(4, "little"), packed]
    return b"".join(out)


class _Reader:
    def __init__(self, block: bytes):
        self.block, self.at = block, 0

    def column(self, kind: str, n: int) -> np.ndarray:
        kind = np.dtype(kind)
        width = _HASH_BYTES if kind == np.uint64 else kind.itemsize
        size = int.from_bytes(self.block[self.at : self.at + 4], "little")
        packed = self.block[self.at + 4 : self.at + 4 + size]
        self.at += 4 + size
        planes = np.zeros((kind.itemsize, n), dtype=np.uint8)
        planes[:width] = np.frombuffer(_CODEC.decompress(packed, n * width, asbytes=True), np.uint8).reshape(width, n)
        return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack(rows: np.ndarray) -> bytes:
    return _squeeze(np.array([len(rows)], dtype="i8"), *[rows[name] for name in rows.dtype.names])


def _unpack(blocks: pd.Series, kind: np.dtype) -> np.ndarray:
    parts = []
    for block in blocks:
        reader = _Reader(block)
        part = np.empty(int(reader.column("i8", 1)[0]), dtype=kind)
        for name in kind.names:
            part[name] = reader.column(kind[name].str, len(part))
        parts.append(part)
    return np.concatenate(parts) if parts else np.empty(0, dtype=kind)


def _pack_bigrams(rows: np.ndarray, heavy: HeavyWords) -> bytes:
    """Like ``_pack``, with documents and heavy words as places in lists."""
    docs, doc = np.unique(rows["doc"], return_inverse=True)
    known, at = heavy.find(rows["w2"])
    sizes = np.array([len(rows), len(docs), int((~known).sum())], dtype="i8")
    return _squeeze(
        sizes, np.diff(docs, prepend=0), doc.astype("u4"), np.where(known, at, _NOT_HEAVY).astype("u2"),
        rows["w2"][~known], rows["w1"], rows["m"], rows["own1"], rows["own2"],
    )


def _unpack_bigrams(blocks: pd.Series, heavy: HeavyWords) -> np.ndarray:
    parts = []
    for block in blocks:
        reader = _Reader(block)
        n, n_docs, n_rest = reader.column("i8", 3).tolist()
        part = np.empty(n, dtype=_BIGRAM)
        docs = np.cumsum(reader.column("i8", n_docs))
        part["doc"] = docs[reader.column("u4", n)]
        code = reader.column("u2", n)
        known = code != _NOT_HEAVY
        part["w2"][known] = heavy.word[code[known]]
        part["w2"][~known] = reader.column("u8", n_rest)
        part["w1"] = reader.column("u8", n)
        for name in ("m", "own1", "own2"):
            part[name] = reader.column("i4", n)
        parts.append(part)
    return np.concatenate(parts) if parts else np.empty(0, dtype=_BIGRAM)


def _dealt(
    rows: np.ndarray, bucket: np.ndarray, pack: Callable[[np.ndarray], bytes] = _pack
) -> Iterator[tuple[int, bytes]]:
    if not len(rows):
        return
    bucket = bucket.astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
        yield int(bucket[a]), pack(rows[a:b])


def _words(docs: list[int], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, bounds = word_hashes(texts, lower=True)
    return np.array(docs, dtype=np.int64), words & _HASH_BITS, bounds


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, word hashes and bounds of the words of each document, in slices of ``SLICE_BYTES``."""
    docs: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            docs.append(doc)
            texts.append(b"" if text is None else text.encode())
            size += len(texts[-1])
            if size >= SLICE_BYTES:
                yield _words(docs, texts)
                docs, texts, size = [], [], 0
    if docs:
        yield _words(docs, texts)


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (word, n, led) added up by word."""
    rows = np.concatenate(parts, axis=1)
    word, inverse = np.unique(rows[0], return_inverse=True)
    sums = [np.bincount(inverse, weights=rows[k], minlength=len(word)).astype(np.int64) for k in (1, 2)]
    return np.stack([word, *sums])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts, merged over several slices: occurrences, and occurrences with a word after them."""

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _merged(parts)], names=["w", "n", "led"])

    parts: list[np.ndarray] = []
    for _, words, bounds in _slices(batches):
        last = np.zeros(len(words), dtype=bool)
        last[bounds[1:][np.diff(bounds) > 0] - 1] = True
        word, inverse, n = np.unique(words, return_inverse=True, return_counts=True)
        led = n - np.bincount(inverse[last], minlength=len(word))
        parts.append(np.stack([word.astype(np.int64), n.astype(np.int64), led.astype(np.int64)]))
        if len(parts) == MERGED_SLICES:
            yield out(parts)
            parts = []
    if parts:
        yield out(parts)


class HeavyWords:
    """Counts of the most frequent words, by binary search over their sorted hashes."""

    def __init__(self, word: np.ndarray, n: np.ndarray, led: np.ndarray):
        order = np.argsort(word)
        self.word, self.n, self.led = word[order], n[order], led[order]

    def find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is heavy, and its place in the tables (0 where it is not)."""
        if not len(self.word):
            return np.zeros(len(word), dtype=bool), np.zeros(len(word), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        known = self.word[at] == word
        return known, np.where(known, at, 0)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b))


def _explode(heavy, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of bigrams: one row per document and bigram, with its repeats and the document's own word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, words, bounds in _slices(batches):
            if not len(words):
                continue
            at = np.repeat(np.arange(len(docs), dtype=np.uint64), np.diff(bounds))
            first = np.zeros(len(words), dtype=bool)
            first[bounds[:-1][np.diff(bounds) > 0]] = True
            w1 = np.where(first, _START, np.concatenate(([_START], words[:-1])))
            _, where, own = np.unique(_pair(at, words), return_inverse=True, return_counts=True)
            final = np.zeros(len(words), dtype=bool)
            final[bounds[1:][np.diff(bounds) > 0] - 1] = True
            led = (own - np.bincount(where[final], minlength=len(own)))[where]
            _, index, m = np.unique(_pair(_pair(at, w1), words), return_index=True, return_counts=True)
            rows = np.empty(len(index), dtype=_BIGRAM)
            rows["w1"], rows["w2"], rows["doc"], rows["m"] = w1[index], words[index], docs[at[index].astype(int)], m
            rows["own1"] = np.where(first[index], 0, led[np.maximum(index - 1, 0)])
            rows["own2"] = own[where[index]]
            rows = rows[np.lexsort((rows["w2"], rows["w1"]))]
            spread = heavy.value.find(rows["w1"])[0] | (rows["w1"] == _START)
            key = np.where(spread, _pair(rows["w1"], rows["w2"]), rows["w1"])
            pack = lambda part: _pack_bigrams(part, heavy.value)
            blocks = list(_dealt(rows, key % np.uint64(buckets), pack))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in blocks], pa.int64()), pa.array([p for _, p in blocks], pa.binary())],
                names=["bucket", "block"],
            )

    return run


def _summed(doc: np.ndarray, score: np.ndarray, n: np.ndarray) -> np.ndarray:
    ids, inverse = np.unique(doc, return_inverse=True)
    out = np.empty(len(ids), dtype=_SUM)
    out["doc"], out["score"] = ids, np.bincount(inverse, weights=score, minlength=len(ids))
    out["n"] = np.bincount(inverse, weights=n, minlength=len(ids)).astype(np.int64)
    return out


def _frame(kind: int, blocks: list[tuple[int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "bucket": [b for b, _ in blocks], "block": [p for _, p in blocks]})


def _sums(doc: np.ndarray, score: np.ndarray, n: np.ndarray, buckets: int) -> pd.DataFrame:
    rows = _summed(doc, score, n)
    bucket = mix(rows["doc"].astype(np.uint64)) % np.uint64(buckets)
    return _frame(0, list(_dealt(rows, bucket)))


def _back_off(count: np.ndarray, total: int) -> np.ndarray:
    return np.log(np.where(count > 0, count, UNSEEN) / total)


def _bigram_scores(heavy, total: int, buckets: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Partial sums per document (kind 0) and bigrams left to back off to words that are not heavy (kind 1)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = _unpack_bigrams(group["block"], heavy.value)
        start = rows["w1"] == _START
        _, pair = np.unique(_pair(rows["w1"], rows["w2"]), return_inverse=True)
        elsewhere = np.bincount(pair, weights=rows["m"])[pair] - rows["m"]
        _, context = np.unique(rows["w1"], return_inverse=True)
        known, at = heavy.value.find(rows["w1"])
        here = np.bincount(context, weights=rows["m"])[context]
        led = np.where(known, heavy.value.led[at] if len(heavy.value.led) else 0, here) - rows["own1"]
        seen = (elsewhere > 0) & ~start
        score = np.zeros(len(rows))
        score[seen] = np.log(elsewhere[seen] / led[seen])
        penalty = np.where(start, 0.0, np.log(DISCOUNT))
        known, at = heavy.value.find(rows["w2"])
        local = ~seen & known
        score[local] = penalty[local] + _back_off(heavy.value.n[at[local]] - rows["own2"][local], total)
        done = seen | local
        left = rows[~done]
        score[~done] = penalty[~done]
        asked = np.empty(len(left), dtype=_WORD)
        asked["w"], asked["doc"], asked["m"], asked["own"] = left["w2"], left["doc"], left["m"], left["own2"]
        sums = _sums(rows["doc"], score * rows["m"], rows["m"], buckets)
        wanted = _frame(1, list(_dealt(asked, asked["w"] % np.uint64(buckets))))
        return pd.concat([sums, wanted], ignore_index=True)

    return run


def _word_scores(total: int, buckets: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Back-offs of one bucket of words, joined to their counts, and the sums that came along, as partial sums."""

    def run(asked: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        sums = _unpack(asked["block"][asked["kind"] == 0], _SUM)
        rows = _unpack(asked["block"][asked["kind"] == 1], _WORD)
        passed = _sums(sums["doc"], sums["score"], sums["n"], buckets)
        if not len(rows):
            return passed
        word = counts["w"].to_numpy().astype(np.uint64)
        order = np.argsort(word)
        n = counts["n"].to_numpy()[order[np.searchsorted(word, rows["w"], sorter=order)]]
        found = _sums(rows["doc"], _back_off(n - rows["own"], total) * rows["m"], np.zeros(len(rows)), buckets)
        return pd.concat([passed, found], ignore_index=True)

    return run


def _add(group: pd.DataFrame) -> pd.DataFrame:
    rows = _unpack(group["block"], _SUM)
    sums = _summed(rows["doc"], rows["score"], rows["n"])
    return pd.DataFrame({name: sums[name] for name in sums.dtype.names})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_words`` and ``log_score``, the mean natural log score of its words (null without words).

    Words are runs without ASCII white space, A-Z lower-cased. A word scores
    its bigram's count over its context's, or ``DISCOUNT`` times its own count
    over all words where the bigram is not seen in other documents; a first
    word scores its own count over all words. Rows with one id are counted as
    documents of their own and summed under the id; a null id is left out.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull())
    counts = texts.mapInArrow(_count_words, "w long, n long, led long")
    folder = f"{shared_folder(spark)}/word-counts-{uuid.uuid4().hex}"
    counts.groupBy("w").agg(F.sum("n").alias("n"), F.sum("led").alias("led")).write.parquet(folder)
    counts = spark.read.parquet(folder)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Fewer than HEAVY words can each have more than 1 / HEAVY of all occurrences.
    top = counts.where(F.col("n") * HEAVY > total).toPandas()
    heavy = HeavyWords(top["w"].to_numpy().astype(np.uint64), top["n"].to_numpy(), top["led"].to_numpy())
    sent = spark.sparkContext.broadcast(heavy)
    buckets = max(int(total // BUCKET_WORDS), 8)

    blocks = texts.mapInArrow(_explode(sent, buckets), "bucket long, block binary")
    kinds = "kind int, bucket long, block binary"
    scored = blocks.groupBy("bucket").applyInPandas(_bigram_scores(sent, total, buckets), kinds)
    words = counts.select("w", "n", (F.col("w") % buckets).alias("bucket")).groupBy("bucket")
    sums = scored.groupBy("bucket").cogroup(words).applyInPandas(_word_scores(total, buckets), kinds)
    added = sums.groupBy("bucket").applyInPandas(_add, "doc long, score double, n long")
    return (
        docs.select(F.col(id_col).alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
        .join(added.withColumnRenamed("doc", id_col), id_col, "left")
        .select(id_col, F.coalesce("n", F.lit(0)).alias("n_words"), (F.col("score") / F.col("n")).alias("log_score"))
    )
