"""Token operators against the libraries themselves, on every text whole."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from matchlake.llm import pieces, queries, token_shards
from matchlake.llm.wavelet import WaveletMatrix, build
from tests.llm.conftest import SF

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("which", ["odd_docs", "some_docs", "no_docs"])
def test_pieces_equal_the_library(which, request):
    docs = request.getfixturevalue(which)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = []
    for row in docs.collect():
        ids = library.encode(row["text"] or "")
        expected.append((row["doc_id"], tuple(ids), library.decode(ids)))
    got = [(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in pieces.encode(docs, PIECES).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_pieces_with_a_full_table(some_docs, monkeypatch):
    texts = [r["text"] for r in some_docs.limit(20).collect()]
    monkeypatch.setattr(pieces, "TABLE_WORDS", 50)
    table = pieces.ChunkTable(PIECES)
    assert [list(i) for i, _ in table.encode(texts)] == table.library.encode(texts)
    assert pieces.crossing_pieces(["▁a", "▁▁", "a▁", "b"]) == ["a▁"]


def test_a_word_is_segmented_in_one_place_for_the_whole_corpus(odd_docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 40)
    rows = odd_docs.selectExpr("doc_id AS doc", "text")
    pieces.ship(spark)
    words = {w for r in rows.collect() for w in pieces.chunks(r["text"] or "")}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    asked = rows.mapInArrow(pieces._asker(5, 40), pieces._ASKED).collect()
    assert len({r["chunk"] for r in asked}) > 3
    places = {}
    for r in asked:
        for w in r["words"].split(pieces.MARK):
            places.setdefault(w, set()).add(r["bucket"])
    assert places.keys() == words and all(len(p) == 1 for p in places.values())
    folder = f"{tmp_path}/words"
    pieces.store_words(rows, PIECES, folder, 5)
    stored = {(r["chunk"], r["bucket"]): r for r in spark.read.parquet(folder).collect()}
    assert stored.keys() == {(r["chunk"], r["bucket"]) for r in asked}
    for r in asked:
        ws, answer = r["words"].split(pieces.MARK), stored[r["chunk"], r["bucket"]]
        assert answer["ids"] == [i for w in ws for i in (library.encode(w) or [library.piece_to_id(pieces.MARK)])]
        found = pieces.Answers(PIECES, folder, r["chunk"], [ws if k == r["bucket"] else [] for k in range(5)])
        assert found.missing == 0


@pytest.mark.parametrize("which", ["odd_docs", "some_docs"])
def test_pieces_of_many_chunks_equal_the_library(which, request, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(pieces, "SLICE_CHARS", 500)
    test_pieces_equal_the_library(which, request)


def test_pieces_of_rows_that_are_cut_otherwise_when_read_again(odd_docs, spark, tmp_path):
    folder = f"{tmp_path}/words"
    rows = odd_docs.selectExpr("doc_id AS doc", "text")
    pieces.ship(spark)
    pieces.store_words(rows, PIECES, folder, 4)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in rows.where("text IS NOT NULL").collect():
        answers = pieces.Answers(PIECES, folder, 0, pieces._dealt([r["text"]], 4))
        ids, bounds, decoded = answers.encode([r["text"]])
        assert list(ids) == library.encode(r["text"]) and list(bounds) == [0, len(ids)]
        assert decoded == [library.decode(library.encode(r["text"]))]


def test_pieces_query(spark):
    rows = {r["doc_id"]: r for r in queries.op7_pieces(spark, SF).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(doc["text"] or "")
        row = rows[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def _expected(docs):
    library = Tokenizer.from_file(BYTES)
    out, start = [], 0
    for row in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids + [0]
        out.append((row["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    return out


@pytest.mark.parametrize("which", ["odd_docs", "some_docs", "no_docs"])
def test_shards_hold_the_library_ids_in_id_order(spark, which, request):
    docs = request.getfixturevalue(which)
    folder = token_shards.new_folder(spark)
    token_shards.write(docs, BYTES, folder)
    rows = sorted(token_shards.read(spark, folder).collect(), key=lambda r: r["start"])
    expected = _expected(docs)
    assert [r["doc"] for r in rows] == [e[0] for e in expected]
    assert sorted([(r["doc"], r["n_tokens"], r["ids_crc32"]) for r in rows], key=str) == sorted(expected, key=str)
    assert [r["start"] for r in rows] == list(np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1])


def test_small_shards_counts_and_places(spark, some_docs, monkeypatch):
    folder = token_shards.new_folder(spark)
    token_shards.write(some_docs, BYTES, folder)
    library = Tokenizer.from_file(BYTES)
    ids = np.concatenate([library.encode(r["text"] or "").ids + [0] for r in some_docs.collect()])
    counts = {r["token"]: r["n"] for r in token_shards.token_counts(spark, folder, [0, 11, 13, 50256]).collect()}
    assert counts == {t: int((ids == t).sum()) for t in (0, 11, 13, 50256)}
    assert token_shards.occurrences(spark, folder, [0, 11]).count() == counts[0] + counts[11]


def test_op3_query(spark):
    got = queries.op3_token_shards(spark, SF).orderBy("start").collect()
    expected = _expected(spark.read.parquet(f"{SF}/documents.parquet"))
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == expected


@pytest.mark.parametrize("n", [0, 1, 7, 512, 513, 3000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    tokens = rng.integers(0, 300, n).astype(np.uint32)
    matrix = WaveletMatrix(build(tokens, 9))
    assert (matrix.tokens() == tokens).all()
    assert [matrix.access(i) for i in range(0, n, 37)] == tokens[::37].tolist()
    for token in (0, 5, 299, 511, 600):
        assert matrix.count(token) == (tokens == token).sum()
        assert matrix.count(token, n // 3, n // 2) == (tokens[n // 3 : n // 2] == token).sum()
        assert [matrix.place(token, k) for k in range(matrix.count(token))] == np.flatnonzero(tokens == token).tolist()


def test_piece_table_reset(some_docs, monkeypatch):
    monkeypatch.setattr(token_shards, "TABLE_PIECES", 30)
    texts = [r["text"] or "" for r in some_docs.limit(20).collect()] + ["a b, c. d.. é, x1. 'll. \u0378, end.", "a . , b", " ,", "x ,y"]
    table = token_shards.PieceTable(BYTES)
    table.encode(texts[:5])
    assert [x.tolist() for x in table.encode(texts)] == [e.ids for e in table.library.encode_batch(texts, add_special_tokens=False)]


def test_a_word_goes_to_the_library_once(some_docs):
    """Whatever sign or line end stands beside it, and in whichever piece of a text."""
    table = token_shards.PieceTable(BYTES)
    texts = ["x Omega Omega. Omega, Omega;\nOmega\nOmega Omega### Omega12", "y Omega.\nOmega\nOmega it's Omega", "Omega Omega's", ""]
    assert [x.tolist() for x in table.encode(texts)] == [e.ids for e in table.library.encode_batch(texts, add_special_tokens=False)]
    words = [w for w in table.codes if b"Omega" in w]
    assert sorted(words) == [b" Omega", b" Omega's", b"Omega"]


def test_cut_texts_equal_the_library_on_random_strings():
    parts = [*"aZ9.é,'#\n\n\t _ß×÷ªº²½ǅƻɏɐ字Жж́​﻿᠎\x7f\x00|<>", "'s", "  ", " a", " b.", "\r\n", "ing", "\n\n\n", "<|endoftext|>"]
    draw = np.random.RandomState(5)
    texts = ["".join(draw.choice(parts, draw.randint(0, 14))) for _ in range(20000)]
    table = token_shards.PieceTable(BYTES)
    expected = [e.ids for e in table.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in table.encode(texts)] == expected
    assert [x.tolist() for t in texts[:2000] for x in table.encode([t])] == expected[:2000]
