import os

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# Nulls, empty and white texts, odd spaces, other alphabets, controls, markers, special strings and a very long text.
ODD = [
    None, "", " ", "  ", "\n", "\n\n a \n", " lead", "trail ", "two  spaces", "a\tb\r\nc\x0bd\x0ce", "▁a▁▁b ▁",
    "日本語 テスト", "Ａ ﬁ é é", "\x00a\x7f \x1c b", "a᠎ b​ c﻿ d　e\xa0f", "<|endoftext|> x", "<s> </s> <unk>",
    "it's we'll I'd 12 345,6", "x" * 3000, "word " * 3000, "ÀÉ İı ẞß ΑΣς", "🙂 👩‍👩‍👧 🇫🇷", "a\u0085b   c",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, some twice, with null ids and extra columns whose names clash with working names."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "  "), (900, "copy"), (900, "copy"), (None, "no id"), (None, None)]
    columns = "doc_id long, text string, words string, pos int, n int, body string, doc int, key int"
    return spark.createDataFrame([(i, t, "w", 1, 2, "b", 3, 4) for i, t in rows], columns).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
