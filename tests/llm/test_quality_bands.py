"""Planted noise and mixed texts at the parameters of production."""

import random

import pytest
from pyspark.sql import functions as F

from matchlake.llm import quality
from tests.llm.conftest import SF

DOCS = SF.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def judged(spark):
    """Documents, noise of two kinds in every language (ids from -1 down to -499) and texts in two languages (from -500)."""
    random.seed(3)
    docs = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text", "lang")
    texts = {k: [r["text"] for r in docs.where((F.col("lang") == k) & (F.length("text") > 3000)).orderBy("doc_id").limit(9).collect()] for k in quality.LANGUAGES}
    hexed = lambda: " ".join("%08x" % random.getrandbits(32) for _ in range(200))
    symbols = lambda: " ".join("".join(random.choices("qxzjwkv0123456789#%&@~^", k=5)) for _ in range(200))
    noise = [(f(), k) for k in quality.LANGUAGES for f in (hexed, symbols)]
    mixed = [(a[:1500] + "\n" + b[:1500], k) for k in quality.LANGUAGES for o in quality.LANGUAGES if o != k for a, b in zip(texts[k][:2], texts[o])]
    rows = [(-1 - i, *r) for i, r in enumerate(noise)] + [(-500 - i, *r) for i, r in enumerate(mixed)]
    planted = spark.createDataFrame(rows, docs.schema)
    return {r["doc_id"]: r for r in quality.assess(docs.union(planted)).collect()}, len(noise), len(mixed)


def test_planted_noise_is_rejected(judged):
    got, n, _ = judged
    for i in range(n):
        assert not got[-1 - i]["base_failed"] and not got[-1 - i]["kept"]


def test_texts_in_two_languages_stay(judged):
    got, _, n = judged
    assert [got[-500 - i]["kept"] for i in range(n) if not got[-500 - i]["base_failed"]].count(False) == 0


def test_clean_documents_stay(spark, judged):
    clean = {r["doc_id"] for r in spark.read.parquet(f"{DOCS}/labels.parquet").where("quality = 1").collect()}
    assert all(judged[0][i]["kept"] for i in clean if not judged[0][i]["base_failed"])


def test_noisy_spread_does_not_widen_the_band(spark):
    rows = [("en", 60, 1.4 + k / 2000) for k in range(1000)]
    high = quality.bands(spark.createDataFrame(rows, "model string, n_words long, nats double"))["en"][1]
    assert high <= 1.775 + quality.MOST_ABOVE
