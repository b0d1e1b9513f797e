"""SentencePiece encoding and decoding by a table of the corpus's distinct chunks.

The model's pieces hold white space markers only at their start, so no merge
crosses the end of a marked word. Documents are read in chunks of about
``CHUNK_CHARS``; a chunk sends its distinct marked words, dealt by hash. The task
of a hash bucket segments and decodes each distinct word of the whole corpus
once, by the library, and answers every chunk with the ids of its own words, in
the order they were asked in. The answers lie in the shared folder, one folder
per chunk; texts are put together from them by position.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import chunk_tables, shared_folder, ship, shuffles_dropped

MARK = "▁"
# Words kept in a table that is used text by text; a full table is emptied and filled anew.
TABLE_WORDS = 400_000
# Characters of text in a chunk, unless one text has more.
CHUNK_CHARS = 1 << 25
# Characters of text put together at once, unless one text has more.
SLICE_CHARS = 1_000_000

_ASKED = "bucket int, chunk long, words string"
_ANSWER = "chunk long, bucket int, mark long, sizes array<int>, ids array<int>, odd array<int>, decoded array<string>"

_MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def crossing_pieces(pieces: list[str]) -> list[str]:
    """Pieces with a marker after another character; the table is exact for models that have none."""
    return [p for p in pieces if MARK in p.lstrip(MARK)]


def chunks(text: str) -> list[str]:
    """Marked words of a text, in order, each without its first marker and with spaces for the others."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return [c[1:].replace(MARK, " ") for c in _MARKED.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


@lru_cache(maxsize=2)
def _library(model: str):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    if crossing_pieces([library.id_to_piece(i) for i in range(library.get_piece_size())]):
        raise ValueError("pieces of this model cross white space markers")
    return library


class ChunkTable:
    """Ids and decoded text of distinct chunks."""

    def __init__(self, model: str):
        self.library = _library(model)
        self.mark = self.library.piece_to_id(MARK)
        self.known: dict[str, tuple[np.ndarray, str]] = {}

    def learn(self, words: set[str]) -> None:
        new = list(words - self.known.keys())
        if len(self.known) + len(new) > TABLE_WORDS:
            self.known.clear()
            new = list(words)
        # A lone marker is the empty chunk, for which the library returns nothing.
        ids = [found or [self.mark] for found in self.library.encode(new, num_threads=1)]
        texts = self.library.decode(ids, num_threads=1)
        for word, found, text in zip(new, ids, texts, strict=True):
            self.known[word] = (np.array(found, dtype=np.int32), " " + text)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        split = [chunks(t) for t in texts]
        self.learn(set().union(*split))
        for words in split:
            if not words:
                yield np.empty(0, dtype=np.int32), ""
                continue
            ids, parts = zip(*map(self.known.__getitem__, words), strict=True)
            yield np.concatenate(ids), "".join(parts)[1:]


def _documents(batches: Iterator[pa.RecordBatch], characters: int) -> Iterator[tuple[int, pa.Array, list[str]]]:
    """Number, ids and texts of each chunk of a partition of (doc, text); the same on every reading."""
    from pyspark import TaskContext

    number, size = TaskContext.get().partitionId() << 24, 0
    ids: list = []
    texts: list[str] = []
    for batch in batches:
        kind = batch.column(0).type
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(row)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= characters:
                yield number, pa.array(ids, kind), texts
                number += 1
                ids, texts, size = [], [], 0
    if ids:
        yield number, pa.array(ids, kind), texts


def _dealt(texts: list[str], buckets: int) -> list[list[str]]:
    """Distinct words of some texts in hash buckets, each in order."""
    words: set[str] = set()
    for text in texts:
        words.update(chunks(text))
    out: list[list[str]] = [[] for _ in range(buckets)]
    for word in sorted(words):
        out[zlib.crc32(word.encode()) % buckets].append(word)
    return out


def _mark(words: str) -> int:
    return zlib.crc32(words.encode())


def _asker(buckets: int, characters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts in _documents(batches, characters):
            dealt = [(k, words) for k, words in enumerate(_dealt(texts, buckets)) if words]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in dealt], pa.int32()),
                    pa.array([number] * len(dealt), pa.int64()),
                    pa.array([MARK.join(words) for _, words in dealt], pa.string()),
                ],
                names=["bucket", "chunk", "words"],
            )

    return run


def _segmenter(model: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The words of a hash bucket, each segmented once whichever chunks hold it; one answer per chunk."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked = [words.split(MARK) for words in group["words"]]
        table = ChunkTable(model)
        table.learn(set().union(*asked))
        rows = []
        for chunk, bucket, joined, words in zip(group["chunk"], group["bucket"], group["words"], asked, strict=True):
            ids, texts = zip(*map(table.known.__getitem__, words), strict=True)
            odd = [k for k, (word, text) in enumerate(zip(words, texts, strict=True)) if text[1:] != word]
            sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
            rows.append((chunk, bucket, _mark(joined), sizes, np.concatenate(ids), odd, [texts[k][1:] for k in odd]))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "mark", "sizes", "ids", "odd", "decoded"])

    return run


class Answers:
    """Ids and decoded text of the words of one chunk.

    Words without an answer are segmented here: Spark may cut the partitions of
    a table otherwise when it reads it again, and a chunk then has other words
    than it asked for.
    """

    def __init__(self, model: str, folder: str, number: int, dealt: list[list[str]]):
        found = {}
        for stored in chunk_tables(folder, number):
            columns = [stored.column(name).combine_chunks() for name in ("bucket", "mark", "sizes", "ids", "odd", "decoded")]
            for bucket, mark, *values in zip(*columns, strict=True):
                found[bucket.as_py(), mark.as_py()] = values
        self.place: dict[str, int] = {}
        self.odd: dict[str, str] = {}
        sizes, ids, missing = [], [], []
        for bucket, words in enumerate(dealt):
            if not words:
                continue
            answer = found.get((bucket, _mark(MARK.join(words))))
            if answer is None or len(answer[0]) != len(words):
                missing += words
                continue
            self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
            sizes.append(answer[0].values.to_numpy())
            ids.append(answer[1].values.to_numpy())
            self.odd.update((words[k], text) for k, text in zip(answer[2].as_py(), answer[3].as_py(), strict=True))
        if missing:
            table = ChunkTable(model)
            table.learn(set(missing))
            for word in missing:
                found_ids, text = table.known[word]
                self.place[word] = len(self.place)
                sizes.append(np.array([len(found_ids)], dtype=np.int32))
                ids.append(found_ids)
                if text[1:] != word:
                    self.odd[word] = text[1:]
        self.missing = len(missing)
        self.sizes = np.concatenate([np.empty(0, dtype=np.int32), *sizes])
        self.ids = np.concatenate([np.empty(0, dtype=np.int32), *ids])
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts, the bounds of each text's ids, and the decoded texts."""
        split = [chunks(t) for t in texts]
        ends = np.cumsum([0, *map(len, split)])
        at = np.fromiter((self.place[word] for words in split for word in words), dtype=np.int64, count=ends[-1])
        sizes = self.sizes[at]
        past = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        ids = self.ids[np.repeat(self.starts[at] - past[:-1], sizes) + np.arange(past[-1])]
        if self.odd:
            split = [[self.odd.get(word, word) for word in words] for words in split]
        return ids, past[ends].astype(np.int32), [" ".join(words) for words in split]


def _encoder(model: str, folder: str, buckets: int, characters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, docs, texts in _documents(batches, characters):
            answers = Answers(model, folder, number, _dealt(texts, buckets))
            # Small slices keep the ids and texts in flight small, whatever the length of the texts.
            for start, end in _slices(texts):
                ids, offsets, decoded = answers.encode(texts[start:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        docs[start:end],
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                        pa.array(decoded, pa.string()),
                    ],
                    names=["doc", "ids", "decoded"],
                )

    return run


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def store_words(rows: DataFrame, model: str, folder: str, buckets: int) -> None:
    """Write to ``folder`` the ids of every distinct word of the (``doc``, ``text``) rows, by chunk."""
    with shuffles_dropped(rows.sparkSession):
        asked = rows.mapInArrow(_asker(buckets, CHUNK_CHARS), _ASKED)
        answers = asked.groupBy("bucket").applyInPandas(_segmenter(model), _ANSWER)
        # As many tasks as partitions of the rows, so that each writes a few chunks however many there are.
        answers.repartition(max(2, buckets // 4), "chunk").write.partitionBy("chunk").parquet(folder)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Per row of ``docs``: id, ``ids`` (without begin and end ids) and ``decoded``, the text the ids decode to.

    Equal to the library's ``encode(text)`` and ``decode(ids)``. A null text is
    empty and has no ids; null ids and repeated rows stay; other columns are
    ignored, whatever their names. ``model`` is a file each executor has.

    ``docs`` is read at once for the table of words, written to ``folder`` (a new
    one under ``spark.checkpoint.dir`` by default), and again by the returned
    DataFrame, which also reads the table: the caller removes ``folder`` once
    done with the result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    folder = folder or f"{shared_folder(spark)}/piece-words-{uuid.uuid4().hex}"
    buckets = max(8, 4 * rows.rdd.getNumPartitions())
    store_words(rows, model, folder, buckets)
    kind = rows.schema["doc"].dataType.simpleString()
    out = rows.mapInArrow(_encoder(model, folder, buckets, CHUNK_CHARS), f"doc {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("doc", id_col)
