"""The word model: against a plain count over all other documents, and text whose words stand in disorder."""

import math
import os
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchlake.llm import quality, word_model


def brute(rows):
    """Nats a word of each (model, text), from counts over all other documents; discounts and the unseen share from all."""
    grams = [(m, [(m, a, b) for w in [t.lower().split()] for a, b in zip(["\n", *w], w)]) for m, t in rows]
    every = Counter(g for _, gs in grams for g in gs)

    def tables(count):
        ended, kinds, led = Counter(), Counter(), Counter()
        for (m, a, b), n in count.items():
            if n:
                ended[m, b] += 1
                kinds[m, a, min(n, 3)] += 1
                led[m, a] += n
        return ended, kinds, led

    def discount(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        if not (n[0] and n[1]):
            return [0.5] * 3
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0, 0), k) for k in (1, 2, 3)]

    whole = tables(every)[0]
    out = []
    for m, gs in grams:
        d2 = discount([n for g, n in every.items() if g[0] == m])
        conts = [n for g, n in whole.items() if g[0] == m]
        d1 = discount(conts)
        left = every - Counter(gs)
        ended, kinds, led = tables(left)
        total = max(sum(1 for g, n in left.items() if g[0] == m), 1)
        spare = min(sum(d1[min(n, 3) - 1] for n in conts) / total, 1)
        nats = 0
        for _, a, b in gs:
            e, n, c = ended[m, b], left[m, a, b], led[m, a]
            p = (max(e - d1[min(e, 3) - 1], 0) if e else 0) / total + max(spare, 1 / (total + 1)) / (len(conts) + 1)
            if c:
                back = sum(d2[k - 1] * kinds[m, a, k] for k in (1, 2, 3))
                p = ((max(n - d2[min(n, 3) - 1], 0) if n else 0) + max(back, 1e-6) * p) / c
            nats -= math.log(p)
        out.append(nats / len(gs) if gs else None)
    return out


def corpus(n, seed):
    """Texts in which most words have one of three followers."""
    rng = random.Random(seed)
    ends = ("ran", "mit", "del", "sor", "pex", "lun", "gav", "hob", "wis", "tem")
    words = [f"{a}{b}{c}" for a in ("bo", "la", "ti", "ne", "ku", "sa") for b in ends for c in ("a", "e", "i", "o")]
    after = {w: rng.sample(words, 3) for w in words}
    out = []
    for _ in range(n):
        w = [rng.choice(words)]
        while len(w) < 120:
            w.append(rng.choice(after[w[-1]]))
        out.append(" ".join(w))
    return out


def test_same_as_counts_of_the_other_documents(spark):
    texts = corpus(20, 1)
    rows = [(i, "en" if i % 3 else "de", t) for i, t in enumerate(texts)]
    rows += [(50, "en", texts[1]), (51, "de", texts[0].upper()), (52, "en", ""), (53, "en", "one"), (None, "en", " x\ty \n x y x")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    got = {(r["doc_id"]): r["word_perplexity"] for r in quality.assess(docs).collect()}
    for (row, _, _), nats in zip(rows, brute([(m, t) for _, m, t in rows]), strict=True):
        assert got[row] is None if nats is None else math.log(got[row]) == pytest.approx(nats, rel=1e-6)


def test_words_in_disorder_are_rejected(spark):
    texts = corpus(300, 2)
    shuffled = [" ".join(random.Random(i).sample(t.split(), 120)) for i, t in enumerate(texts[:20])]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(-1 - i, t, "en") for i, t in enumerate(shuffled)]
    got = {r["doc_id"]: r for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(got[-1 - i]["base_failed"] or got[-1 - i]["kept"] for i in range(20))
    assert all(got[i]["kept"] and not got[i]["base_failed"] for i in range(300))


def test_rows_that_change_between_readings_end_the_job(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(corpus(30, 3))], "doc_id long, text string, lang string")
    changed = F.udf(lambda t: f"{t} {uuid.uuid4().hex}")
    with pytest.raises(Exception, match="not the same when read again"):
        quality.assess(docs.withColumn("text", changed("text"))).collect()


def test_the_pipeline_drops_words_in_disorder(spark):
    texts = corpus(300, 4)
    shuffled = [" ".join(random.Random(i).sample(t.split(), 120)) for i, t in enumerate(texts[:10])]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)] + [(-1 - i, t, "en", "web", len(t)) for i, t in enumerate(shuffled)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert kept == set(range(300))


def test_shuffles_of_the_model_are_gone_once_its_answers_are_stored(spark):
    def shuffled():
        places = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        files = [os.path.join(at, f) for d in places for at, _, names in os.walk(d.getPath()) for f in names if f.endswith(".data")]
        return {f: os.path.getsize(f) for f in files if f.rpartition("/")[2].startswith("shuffle_")}

    rows = spark.createDataFrame([(i, "en", t) for i, t in enumerate(corpus(400, 5))], "row long, model string, text string")
    quality.ship(spark)
    before = shuffled()
    asked = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    model = word_model.fit(rows, ["en", "other"])
    model.drop(spark)
    left = {f: n for f, n in shuffled().items() if f not in before}
    assert left == {}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == asked
