"""Modified Kneser-Ney model of word bigrams, one per language, in hash-partitioned sorted arrays.

The model grows with the corpus, so no task holds it. Documents are read in
chunks (a partition's rows, cut after ``CHUNK_CHARS`` of text). A chunk sends
its distinct bigrams as sorted hashes, dealt by hash range; the task of a range
merges the arrays of all chunks and answers each chunk with the totals of its
own bigrams, in the order they were asked in. Of the chunks that hold a bigram one is
told to own it; the owners count, per word, the distinct bigrams that it leads
(by total: 1, 2, 3 and more) and those that it ends, its continuation count. A second round adds
these up per word in the same way. Both answers lie in the shared folder, one
folder per chunk.

A document is scored without its own occurrences: they are taken from every
count that its words are scored with. Only the discounts and the share of
words never seen are those of the whole corpus.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import chunk_tables, remove, shared_folder, shuffles_dropped
from matchlake.llm.hashing import blocks, mix, word_hashes

# Characters of text in a chunk, unless one text has more.
CHUNK_CHARS = 8_000_000
# Words scored at once, unless one text has more.
SLICE_WORDS = 200_000
# Hashes have 48 bits: of two billion bigrams fewer than one in 100,000 meets another.
_HASH_BYTES = 6
_SHIFT = np.uint64(64 - 8 * _HASH_BYTES)
# Counts of counts per model: totals of 1, 2, 3 and 4, of 3 and more, all, and their sum.
STATS = 7

_ASKED = "bucket int, chunk long, mark long, hashes binary, models binary, counts binary"
_ANSWER = "chunk long, bucket int, mark long, n int, counts binary"


def _pack(values: np.ndarray, width: int = 8) -> bytes:
    """Their number, then all lowest bytes first, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, width: int = 8) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = pa.decompress(packed[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str], list[str]]]:
    """Number, ids, models and texts of each chunk of a partition of (row, model, text); the same on every reading."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24
    ids: list = []
    names: list[str] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for row, name, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            ids.append(row)
            names.append(name)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= CHUNK_CHARS:
                yield number, ids, names, texts
                number += 1
                ids, names, texts, size = [], [], [], 0
    if ids:
        yield number, ids, names, texts


class Chunk:
    """Distinct words and bigrams of some documents; a bigram is led by the word before or the start of its text."""

    def __init__(self, models: list[str], names: list[str], texts: list[str]):
        self.models = np.array([models.index(name) for name in names], dtype=np.uint8)
        salts = mix(np.arange(1, len(models) + 1, dtype=np.uint64))[self.models]
        hashes, sizes = [], []
        encoded = [text.encode() for text in texts]
        for a, b in blocks(encoded):
            found, bounds = word_hashes(encoded[a:b], lower=True)
            hashes.append(found)
            sizes.append(np.diff(bounds))
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        n = len(self.doc)
        del encoded
        some = np.flatnonzero(self.sizes)
        words = mix(np.concatenate(hashes) ^ salts[self.doc]) if n else np.zeros(0, dtype=np.uint64)
        self.word, at = np.unique(np.concatenate((words, mix(salts[some]))) >> _SHIFT, return_inverse=True)
        del hashes, words
        self.word_model = np.zeros(len(self.word), dtype=np.uint8)
        self.word_model[at[:n]] = self.models[self.doc]
        self.word_model[at[n:]] = self.models[some]
        # Distinct bigrams by their places in the words, in order of their leads.
        first = np.empty(n, dtype=np.int64)
        first[1:] = at[: max(n - 1, 0)]
        first[(np.cumsum(self.sizes) - self.sizes)[some]] = at[n:]
        pair, where, self.count = np.unique(first * len(self.word) + at[:n], return_inverse=True, return_counts=True)
        self.at = where.astype(np.int32)
        self.lead, self.tail = (x.astype(np.int32) for x in np.divmod(pair, max(len(self.word), 1)))
        del first, at, pair, where
        key = mix(self.word[self.lead] * np.uint64(0x9E3779B97F4A7C15) + mix(self.word[self.tail])) >> _SHIFT
        self.order = np.argsort(key)
        self.key = key[self.order]


def _ask(chunk: int, hashes: np.ndarray, models: np.ndarray, counts: list[np.ndarray], buckets: int) -> pa.RecordBatch | None:
    """The sorted hashes of a chunk and what it counts for each, one row per hash range."""
    edges = np.searchsorted(hashes, [(k << (8 * _HASH_BYTES)) // buckets for k in range(buckets + 1)])
    rows = [
        {
            "bucket": k, "chunk": chunk, "mark": zlib.crc32(hashes[a:b].tobytes()), "hashes": _pack(np.diff(hashes[a:b], prepend=np.uint64(0)), _HASH_BYTES),
            "models": _pack(models[a:b], 1), "counts": _pack(np.concatenate([c[a:b] for c in counts])),
        }
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a
    ]
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW) if rows else None


_ARROW = pa.schema([
    ("bucket", pa.int32()), ("chunk", pa.int64()), ("mark", pa.int64()),
    ("hashes", pa.binary()), ("models", pa.binary()), ("counts", pa.binary()),
])


def _answer(width: int, models: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Totals of a hash range per chunk, each with a bit that tells one of the chunks that have a hash to own it.

    A row of chunk -1 holds the counts of counts of the last of the ``width`` numbers, per model.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        parts = [np.cumsum(_unpack(h, _HASH_BYTES)) for h in group["hashes"]]
        sizes = [len(p) for p in parts]
        hashes = np.concatenate(parts)
        kinds = np.concatenate([_unpack(m, 1) for m in group["models"]])
        counts = [_unpack(c).reshape(width, -1) for c in group["counts"]]
        _, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        totals = [np.bincount(at, weights=np.concatenate([c[k] for c in counts])).astype(np.int64) for k in range(width)]
        owner = np.zeros(len(hashes), dtype=np.int64)
        owner[first] = 1
        sent = [2 * total[at] + owner for total in totals]
        stats = np.zeros((models, STATS), dtype=np.int64)
        last = totals[-1]
        for m in range(models):
            own = last[(kinds[first] == m) & (last > 0)]
            stats[m] = [*((own == k).sum() for k in (1, 2, 3, 4)), (own >= 3).sum(), len(own), own.sum()]
        ends = np.cumsum(sizes)
        rows = [
            (chunk, bucket, mark, size, _pack(np.concatenate([s[end - size : end] for s in sent])))
            for chunk, bucket, mark, size, end in zip(group["chunk"], group["bucket"], group["mark"], sizes, ends, strict=True)
        ]
        rows.append((-1, group["bucket"].iloc[0], 0, 0, _pack(stats.ravel())))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "mark", "n", "counts"])

    return run


def _read(folder: str, chunk: int, hashes: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The answer to a chunk: totals in the order of its hashes, and what it owns. Refused if it is not to these hashes."""
    if not len(hashes):
        return [np.zeros(0, dtype=np.int64)] * width, np.zeros(0, dtype=bool)
    rows = [r for stored in chunk_tables(folder, chunk) for r in stored.to_pylist()]
    rows.sort(key=lambda r: r["bucket"])
    start, parts = 0, []
    for r in rows:
        end = start + r["n"]
        if zlib.crc32(hashes[start:end].tobytes()) != r["mark"]:
            break
        parts.append(_unpack(r["counts"]).astype(np.int64).reshape(width, -1))
        start = end
    if start != len(hashes):
        raise RuntimeError("the documents were not the same when read again; store them before they are judged")
    found = np.concatenate(parts, axis=1)
    return list(found >> 1), (found[0] & 1).astype(bool)


def _bigrams(models: list[str], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, names, texts in chunks(batches):
            c = Chunk(models, names, texts)
            asked = _ask(number, c.key, c.word_model[c.tail][c.order], [c.count[c.order]], buckets)
            if asked:
                yield asked

    return run


def _bigram_totals(c: Chunk, number: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Total of each bigram of the chunk, and whether the chunk owns it."""
    (found,), own = _read(folder, number, c.key, 1)
    total, owner = np.empty(len(c.key), dtype=np.int64), np.empty(len(c.key), dtype=bool)
    total[c.order], owner[c.order] = found, own
    return total, owner


def _words(models: list[str], buckets: int, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per word of a chunk: occurrences as a lead; owned bigrams that it leads, by total; owned bigrams that it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, names, texts in chunks(batches):
            c = Chunk(models, names, texts)
            total, owner = _bigram_totals(c, number, folder)
            words = len(c.word)
            led = np.bincount(c.lead, weights=c.count, minlength=words).astype(np.int64)
            kinds = [np.bincount(c.lead[owner & t], minlength=words) for t in (total == 1, total == 2, total >= 3)]
            ended = np.bincount(c.tail[owner], minlength=words)
            asked = _ask(number, c.word, c.word_model, [led, *kinds, ended], buckets)
            if asked:
                yield asked

    return run


def discounts(stats: np.ndarray) -> np.ndarray:
    """Discounts of a count of 1, of 2, and of 3 and more, by modified Kneser-Ney, from counts of counts."""
    n = stats[:4].astype(float)
    if not (n[0] and n[1]):
        # Too few rare counts to estimate from: half a count.
        return np.full(3, 0.5)
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0, 0.0), k) for k in (1, 2, 3)])


@dataclass(frozen=True)
class WordModel:
    """Where the answers lie, and per model the discounts of both orders and the size of the word distribution."""

    models: list[str]
    bigrams: str
    words: str
    pair_stats: np.ndarray
    word_stats: np.ndarray

    def nats(self, number: int, names: list[str], texts: list[str]) -> np.ndarray:
        """Mean negative log probability of each document's words, without its own occurrences; nan without words."""
        c = Chunk(self.models, names, texts)
        total, _ = _bigram_totals(c, number, self.bigrams)
        known, _ = _read(self.words, number, c.word, 5)
        out = np.full(len(texts), np.nan)
        ends = np.cumsum(c.sizes)
        start = 0
        while start < len(texts):
            base = ends[start] - c.sizes[start]
            end = max(start + 1, int(np.searchsorted(ends, base + SLICE_WORDS, side="right")))
            inside = slice(base, ends[end - 1])
            sums = self._sums(c, total, known, c.doc[inside] - start, c.at[inside], c.models[start:end])
            some = c.sizes[start:end] > 0
            out[start:end][some] = sums[some] / c.sizes[start:end][some]
            start = end
        return out

    def _sums(self, c: Chunk, total: np.ndarray, known: list[np.ndarray], docs: np.ndarray, at: np.ndarray, models: np.ndarray) -> np.ndarray:
        """Nats of some documents of a chunk, from the document and the bigram of each of their words."""
        led, one, two, more, ended = known
        pair_discount = np.array([discounts(s) for s in self.pair_stats])
        word_discount = np.array([discounts(s) for s in self.word_stats])
        # One row per document and distinct bigram of it.
        cell, m = np.unique(docs.astype(np.int64) * max(len(c.key), 1) + at, return_counts=True)
        doc, pair = np.divmod(cell, max(len(c.key), 1))
        lead, tail, model = c.lead[pair], c.tail[pair], models[doc]
        before = total[pair]
        left = before - m
        width = max(len(c.word), 1)
        # Rows of a document with one lead stand together.
        at_lead = np.cumsum(np.diff(doc * width + lead, prepend=-1) != 0) - 1
        _, at_tail = np.unique(doc * width + tail, return_inverse=True)

        def per(place: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.bincount(place, weights=x)[place] if len(x) else np.zeros(0)

        gone = (left == 0).astype(float)
        context = led[lead] - per(at_lead, m)
        # Bigrams that the word leads in other documents, by their total there.
        kinds = [
            count[lead] - per(at_lead, 1.0 * (np.minimum(before, 3) == k) - (np.minimum(left, 3) == k))
            for k, count in enumerate((one, two, more), 1)
        ]
        # Words: continuation counts, then an even share for words never seen.
        seen = ended[tail] - per(at_tail, gone)
        lost = np.bincount(doc, weights=gone, minlength=len(models))
        whole = np.maximum(self.word_stats[:, 6][model] - lost[doc], 1)
        off = np.where(seen > 0, word_discount[model, np.clip(seen, 1, 3).astype(int) - 1], 0)
        counted = np.stack([self.word_stats[:, 0], self.word_stats[:, 1], self.word_stats[:, 4]], axis=1)
        spare = np.minimum((word_discount * counted).sum(axis=1)[model] / whole, 1)
        vocabulary = self.word_stats[:, 5][model] + 1
        lower = np.maximum(seen - off, 0) / whole + np.maximum(spare, 1 / (whole + 1)) / vocabulary
        off = np.where(left > 0, pair_discount[model, np.clip(left, 1, 3) - 1], 0)
        back = sum(pair_discount[model, k] * kinds[k] for k in range(3))
        p = np.where(
            context > 0, (np.maximum(left - off, 0) + np.maximum(back, 1e-6) * lower) / np.maximum(context, 1), lower
        )
        return np.bincount(doc, weights=-np.log(p) * m, minlength=len(models))

    def drop(self, spark) -> None:
        remove(spark, self.bigrams)
        remove(spark, self.words)


def _stored(asked: DataFrame, width: int, models: int) -> tuple[str, np.ndarray]:
    """Folder with the answers, one folder per chunk, and the counts of counts per model."""
    spark = asked.sparkSession
    folder = f"{shared_folder(spark)}/word-model-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        answers = asked.groupBy("bucket").applyInPandas(_answer(width, models), _ANSWER)
        answers.repartition("chunk").write.partitionBy("chunk").parquet(folder)
    # One row per hash range, of a few numbers each.
    found = spark.read.schema(_ANSWER).parquet(folder).where("chunk = -1").select("counts").toPandas()["counts"]
    return folder, sum((_unpack(c).astype(np.int64) for c in found), np.zeros(models * STATS, dtype=np.int64)).reshape(models, STATS)


def fit(rows: DataFrame, models: list[str]) -> WordModel:
    """Model of the (``row``, ``model``, ``text``) rows, for scoring the same rows in the same partitions.

    Words are runs without ASCII white space, A-Z lower-cased. ``rows`` is read
    three times and must be the same each time, as stored tables are; if it is not, scoring ends with an error.
    """
    buckets = max(8, 4 * rows.rdd.getNumPartitions())
    pairs, pair_stats = _stored(rows.mapInArrow(_bigrams(models, buckets), _ASKED), 1, len(models))
    words, word_stats = _stored(rows.mapInArrow(_words(models, buckets, pairs), _ASKED), 5, len(models))
    return WordModel(models, pairs, words, pair_stats, word_stats)
