"""Scores against a plain count over all documents."""

import math
import re
from collections import Counter

import pytest

from matchlake.llm import backoff_scores, queries
from tests.llm.conftest import SF


def brute_force(rows):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows if i is not None]
    words, led, pairs = Counter(), Counter(), Counter()
    for _, w in docs:
        words.update(w)
        led.update(w[:-1])
        pairs.update(zip(w, w[1:]))
    total = words.total()
    out = {}
    for i, w in docs:
        own, own_led, own_pairs = Counter(w), Counter(w[:-1]), Counter(zip(w, w[1:]))
        score = out.get(i, (0.0, 0))[0]
        for k, word in enumerate(w):
            pair = (w[k - 1], word)
            if k and pairs[pair] > own_pairs[pair]:
                score += math.log((pairs[pair] - own_pairs[pair]) / (led[pair[0]] - own_led[pair[0]]))
            else:
                rest = words[word] - own[word]
                score += math.log((rest or backoff_scores.UNSEEN) / total) + (math.log(backoff_scores.DISCOUNT) if k else 0)
        out[i] = (score, out.get(i, (0, 0))[1] + len(w))
    return {i: (n, s / n if n else None) for i, (s, n) in out.items()}


@pytest.mark.parametrize("heavy", [50_000, 200, 1])
@pytest.mark.parametrize("which", ["odd_docs", "some_docs"])
def test_equals_brute_force(which, heavy, request, monkeypatch):
    monkeypatch.setattr(backoff_scores, "HEAVY", heavy)
    docs = request.getfixturevalue(which)
    expected = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_words"], r["log_score"]) for r in backoff_scores.score(docs).collect()}
    assert got.keys() == expected.keys()
    for doc, (n, value) in expected.items():
        assert got[doc][0] == n
        assert got[doc][1] == pytest.approx(value) if n else got[doc][1] is None


def test_no_documents(no_docs):
    assert backoff_scores.score(no_docs).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = brute_force([(r["doc_id"], r["text"]) for r in docs])
    for row in queries.op9_backoff_scores(spark, SF).collect():
        assert row["log_score"] == pytest.approx(expected[row["doc_id"]][1], abs=1e-6)
