"""Token ids of a corpus in wavelet matrix shards, in order of document id.

Texts are range-partitioned by id, encoded, and cut into shards of whole
documents. A shard is one row of a Parquet table: its wavelet matrix as one
compressed binary, with the ids and lengths of its documents.
"""

from __future__ import annotations

import codecs
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.llm.common import shared_folder, ship
from matchlake.llm.wavelet import WaveletMatrix, build

# Tokens in a shard, unless one document has more.
SHARD_TOKENS = 1 << 20
# Words kept in a worker's table; a full table is emptied and filled anew.
TABLE_PIECES = 600_000
# Characters of the texts that are cut together, unless one text has more.
SLICE_CHARS = 1 << 23
END = 0

_SHARD = "part int, shard int, n_tokens long, docs array<long>, lengths array<int>, matrix binary"
# White space in anybody's list of it. A text may be cut before a space only where none stands beside the space.
_SPACE = "\\s\u180e\u200b\ufeff"
_EDGE_SPACE = re.compile(f"^[{_SPACE}]|[{_SPACE}]$|^$")
# Kinds of bytes: a word of the byte-level pre-tokenizer is a run of letters, digits or signs, with the space before it, or
# a line end before something else. Only characters that every list knows have a kind; an apostrophe has none, as it
# starts endings like 's.
_ODD, _LETTER, _DIGIT, _SIGN, _BLANK, _LINE = range(6)
_KINDS = np.full(256, _ODD, dtype=np.uint8)
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KINDS[0x30:0x3A] = _DIGIT
_KINDS[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != ord("'")]] = _SIGN
_KINDS[[0x20, 0x0A]] = _BLANK, _LINE
# The characters that stand for bytes in a byte-level vocabulary, and a byte in no word above that parts them.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_UNSEEN = sorted(set(range(0x100)) - set(_SEEN))
_ALPHABET = "".join(chr(x) if x in _SEEN else chr(0x100 + _UNSEEN.index(x)) for x in range(0x100))
_PARTING = b"\x7f"


class _Codes(dict):
    """Numbers words in order of arrival and remembers the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


def _kinds(data: np.ndarray) -> np.ndarray:
    """Kind of each byte of UTF-8 text. Beyond ASCII, the letters from U+00C0 to U+024F have one."""
    kinds = _KINDS[data]
    at = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    lead, rest = data[at], data[at + 1]
    known = np.where(lead == 0xC9, rest < 0x90, (lead != 0xC3) | ((rest != 0x97) & (rest != 0xB7)))
    kinds[at[known]] = kinds[at[known] + 1] = _LETTER
    return kinds


def _cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the units that texts side by side (at ``bounds``) consist of, the units that are no plain words, and
    the texts that cannot be cut.

    A unit is a word, or a whole space-led piece of a text if it holds a byte of no kind or two line ends in a row.
    """
    kinds = _kinds(data)
    first = np.zeros(len(data) + 1, dtype=bool)
    first[bounds] = True
    lines = kinds == _LINE
    twice = np.flatnonzero(lines[:-1] & lines[1:])
    spaces = np.flatnonzero(kinds == _BLANK)
    after = np.append(kinds, _LINE)[spaces + 1]
    bad = first[spaces + 1] | (after == _BLANK) | (after == _LINE) | (~first[spaces] & lines[spaces - 1])
    first[spaces] = True
    odd_bytes = np.concatenate((np.flatnonzero(kinds == _ODD), twice))
    pieces = np.flatnonzero(first)
    odd_pieces = np.unique(np.searchsorted(pieces, odd_bytes, "right") - 1)
    first[1:-1] |= (kinds[1:] != kinds[:-1]) & (kinds[:-1] != _BLANK)
    starts = np.flatnonzero(first[:-1])
    # No unit starts inside an odd piece.
    lo, hi = np.searchsorted(starts, pieces[odd_pieces]), np.searchsorted(starts, pieces[odd_pieces + 1])
    inside = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(inside, lo + 1, 1)
    np.add.at(inside, np.maximum(hi, lo + 1), -1)
    starts = starts[np.cumsum(inside)[:-1] == 0]
    return starts, np.searchsorted(starts, pieces[odd_pieces]), np.searchsorted(bounds, spaces[bad], "right") - 1


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class PieceTable:
    """Ids of the distinct words of a corpus, as found by the tokenizers library.

    The byte-level pre-tokenizer always cuts before a single space between two
    other characters, and between letters, digits and signs, so a text's ids are
    those of its words put together. Texts are cut by their bytes, many at a
    time, and a word goes to the library once as long as the table holds it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # The same model, for words that are cut already and written in its own alphabet.
        parting = _ALPHABET[_PARTING[0]]
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.Split(parting, "isolated")
        vocabulary = self.library.get_vocab()
        self.parting = vocabulary[parting]
        self.bits = max(vocabulary.values()).bit_length()
        self.specials = [a.content for a in self.library.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        """Code -> start and length in ``ids``; a length of -1 marks a piece that may not be cut out."""
        self.codes = _Codes()
        self.starts = np.empty(0, dtype=np.int64)
        self.lengths = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, and how many each has. They go to the library in lines of many, parted by a byte of its own."""
        lines = [_PARTING.join(words[i : i + 100]) + _PARTING for i in range(0, len(words), 100)]
        found = self.words.encode_batch_fast([codecs.charmap_decode(x, "strict", _ALPHABET)[0] for x in lines], add_special_tokens=False)
        ids = np.concatenate([np.empty(0, dtype=np.uint32), *(np.array(e.ids, dtype=np.uint32) for e in found)])
        ends = np.flatnonzero(ids == self.parting)
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not keep words apart")
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _coded(self, units: list[bytes], odd: np.ndarray) -> np.ndarray:
        """Codes of distinct units; the new ones are taken into the table."""
        if len(self.codes) > TABLE_PIECES:
            self._clear()
        known = len(self.codes)
        codes = np.fromiter(map(self.codes.__getitem__, units), dtype=np.int64, count=len(units))
        new, self.codes.new = self.codes.new, []
        if not new:
            return codes
        strange = odd[codes >= known]
        ids, counts = self._plain([w for w, s in zip(new, strange.tolist(), strict=True) if not s])
        texts = [new[i].decode() for i in np.flatnonzero(strange)]
        others = self._whole(texts)
        barred = [bool(_EDGE_SPACE.search(t.removeprefix(" "))) for t in texts]
        lengths = np.empty(len(new), dtype=np.int64)
        lengths[~strange], lengths[strange] = counts, [len(x) for x in others]
        starts = np.empty(len(new), dtype=np.int64)
        starts[~strange] = np.cumsum(counts) - counts
        starts[strange] = len(ids) + np.cumsum(lengths[strange]) - lengths[strange]
        lengths[np.flatnonzero(strange)[barred]] = -1
        self.starts = np.concatenate((self.starts, starts + len(self.ids)))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, ids, *others))
        return codes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = pa.array(["".join(texts)], pa.large_binary())
        buffer = joined.buffers()[2]
        data = np.frombuffer(buffer, dtype=np.uint8) if buffer and buffer.size else np.empty(0, dtype=np.uint8)
        bounds = np.cumsum([0, *(len(t) if t.isascii() else len(t.encode()) for t in texts)])
        data = data[: bounds[-1]]
        if not len(data):
            return self._whole(texts)
        starts, odd_units, uncut = _cut(data, bounds)
        offsets = pa.py_buffer(np.append(starts, len(data)))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, offsets, buffer]).dictionary_encode()
        local = coded.indices.to_numpy()
        odd = np.zeros(len(coded.dictionary), dtype=bool)
        odd[local[odd_units]] = True
        codes = self._coded(coded.dictionary.to_pylist(), odd)[local]
        lengths = self.lengths[codes]
        # Texts with special strings, or with white space beside a space, are encoded whole.
        barred = np.searchsorted(bounds, starts[lengths < 0], "right") - 1
        whole = sorted({*uncut.tolist(), *barred.tolist(), *(i for i, t in enumerate(texts) if any(x in t for x in self.specials))})
        lengths = np.maximum(lengths, 0)
        ids = self.ids[_ranges(self.starts[codes], lengths)]
        cuts = np.append(0, np.cumsum(lengths))[np.searchsorted(starts, bounds)]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i, found in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = found
        return out


# One table per worker process, shared by the partitions it works on.
_tables: dict[str, PieceTable] = {}


def _table(path: str) -> PieceTable:
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of a batch, as many rows at a time as have ``SLICE_CHARS`` characters."""
    docs, texts = batch.column(0).to_pylist(), ["" if t is None else t for t in batch.column(1).to_pylist()]
    start = size = 0
    for i, text in enumerate(texts, 1):
        size += len(text)
        if size >= SLICE_CHARS or i == len(texts):
            yield docs[start:i], texts[start:i]
            start, size = i, 0


def _writer(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = _table(path)
        part, shard = TaskContext.get().partitionId(), 0
        docs, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(ids)
            row = {
                "part": part, "shard": shard, "n_tokens": len(tokens), "docs": docs,
                "lengths": [len(x) for x in ids], "matrix": build(tokens, table.bits),
            }
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for docs_in, texts in _slices(batch):
                for doc, found in zip(docs_in, table.encode(texts), strict=True):
                    docs.append(doc)
                    ids.append(np.append(found, np.uint32(END)))
                    size += len(ids[-1])
                    if size >= SHARD_TOKENS:
                        yield flush()
                        docs, ids, size, shard = [], [], 0, shard + 1
        if docs:
            yield flush()

    return run


_ARROW = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()),
    ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("matrix", pa.binary()),
])


def write(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write their shards to ``folder``, in ascending id order (null ids first).

    A null text is empty; each document ends with id 0; rows with equal ids stand next
    to each other; other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc").sortWithinPartitions("doc")
    ordered.mapInArrow(_writer(tokenizer), _SHARD).write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: ``doc``, ``start`` (ids before it in the corpus), ``n_tokens`` and ``ids_crc32``, from the files."""
    ship(spark)
    shards = spark.read.schema(_SHARD).parquet(folder)
    # Offsets in two steps: shards within a partition, then one row per partition.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("ahead"))
    starts = sums.join(parts, "part").select("part", "shard", (F.col("base") + F.col("ahead")).alias("first"))
    docs = shards.select("part", "shard", "docs", "lengths", "matrix").mapInArrow(
        _reader, "part int, shard int, doc long, ahead long, n_tokens long, ids_crc32 long"
    )
    found = docs.join(starts, ["part", "shard"])
    return found.select("doc", (F.col("first") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            tokens = WaveletMatrix(row["matrix"]).tokens().astype("<u4")
            lengths = np.array(row["lengths"], dtype=np.int64)
            ahead = np.cumsum(lengths) - lengths
            crc = [zlib.crc32(tokens[a : a + n]) for a, n in zip(ahead, lengths, strict=True)]
            count = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * count, pa.int32()), pa.array([row["shard"]] * count, pa.int32()),
                    pa.array(row["docs"], pa.int64()), pa.array(ahead), pa.array(lengths), pa.array(crc, pa.int64()),
                ],
                names=["part", "shard", "doc", "ahead", "n_tokens", "ids_crc32"],
            )


def occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """Places of the given tokens: ``token``, ``part``, ``shard`` and ``place`` in the shard, by select on the planes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix(row["matrix"])
                for token in tokens:
                    places = [matrix.place(token, n) for n in range(matrix.count(token))]
                    if places:
                        yield pa.RecordBatch.from_pydict({
                            "token": [token] * len(places), "part": [row["part"]] * len(places),
                            "shard": [row["shard"]] * len(places), "place": places,
                        })

    ship(spark)
    shards = spark.read.schema(_SHARD).parquet(folder).select("part", "shard", "matrix")
    return shards.mapInArrow(find, "token long, part long, shard long, place long")


def token_counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """Occurrences of the given tokens in the corpus: ``token``, ``n``; counted from ranks, without decoding."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix(row["matrix"])
                yield pa.RecordBatch.from_pydict({"token": tokens, "n": [matrix.count(t) for t in tokens]})

    ship(spark)
    shards = spark.read.schema(_SHARD).parquet(folder).select("matrix")
    counts = shards.mapInArrow(count, "token long, n long")
    return counts.groupBy("token").agg(F.sum("n").alias("n"))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
