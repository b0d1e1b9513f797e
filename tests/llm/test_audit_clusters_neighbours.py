"""Divergence audit, centroid clustering and nearest neighbours against brute force in plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from matchlake.llm import centroids, divergence, neighbours
from tests.llm.conftest import ODD, SF

# Divergence audit


def audit_brute(rows, min_docs, top):
    """rows: (text, lang, source); the contract's rows as tuples (lang, source, part, item, value, rank)."""
    docs = []
    for text, lang, source in rows:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        docs.append((lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    groups = sorted({(lang, source) for lang, source, _ in docs})
    df, count, lang_count = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        count[(lang, source)].update(words)
        lang_count[lang].update(words)
    kept = {lang: sorted(t for t, n in df[lang].items() if n >= min_docs) for lang in df}
    out = []

    def probs(counter, terms):
        den = sum(counter[t] for t in terms) + 5 * len(terms)
        return {t: 1 + (1_000_000_000 * (counter[t] + 5)) // den for t in terms}

    for lang, source in groups:
        terms = kept.get(lang, [])
        p = probs(count[(lang, source)], terms)
        q = probs(lang_count[lang], terms)
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                po = probs(count[(lang, other)], terms)
                pairs.append((other, sum(abs(p[t] - po[t]) for t in terms)))
        pairs.sort(key=lambda x: (-x[1], x[0].encode()))
        out += [(lang, source, "pair", item, value, i + 1) for i, (item, value) in enumerate(pairs)]
        hits = [(t, p[t] - q[t]) for t in terms if count[(lang, source)][t] > 0 and p[t] > q[t]]
        hits.sort(key=lambda x: (-x[1], x[0].encode()))
        out += [(lang, source, "term", item, value, i + 1) for i, (item, value) in enumerate(hits[:top])]
    return sorted(out)


def got_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def mixed_docs(spark):
    words = ["alpha", "Beta", "gamma", "Δelta", "éta", "zeta", "x1y", "ÀB"]
    rows = []
    for i in range(60):
        text = " ".join(words[j % len(words)] for j in range(i % 7, i % 7 + (i % 11) + 1))
        rows.append((i, text, ["en", "fr", None][i % 3], ["s1", "s2", None, "s1"][i % 4]))
    rows += [(100 + i, t, "en", "s9") for i, t in enumerate(ODD)]
    rows += [(200, "alpha alpha alpha", "en", "s1")] * 3 + [(201, None, None, None), (202, "", "de", "only")]
    columns = "doc_id long, text string, lang string, source string, term string, c int, df int, first int"
    return spark.createDataFrame([(*r, "t", 1, 2, 3) for r in rows], columns).repartition(3)


@pytest.mark.parametrize(("min_docs", "top"), [(2, 50), (5, 3), (1, 1), (1000, 50)])
def test_audit_against_brute_force(mixed_docs, min_docs, top):
    got = got_rows(divergence.audit(mixed_docs, min_docs=min_docs, top=top))
    rows = [(r["text"], r["lang"], r["source"]) for r in mixed_docs.collect()]
    assert got == audit_brute(rows, min_docs, top)


def test_audit_ties_cut_at_the_top_rank(spark):
    # twelve terms, each once in every document of one source: all tie; ranks follow UTF-8 order
    terms = [f"t{chr(97 + i)}" for i in range(12)] + ["über", "zz"]
    rows = [(i, " ".join(terms), "en", "a" if i % 2 else "b") for i in range(8)] + [(99, "ta", "en", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = got_rows(divergence.audit(docs, min_docs=2, top=5))
    assert got == audit_brute([(t, lang, s) for _, t, lang, s in rows], 2, 5)


def test_audit_of_no_documents(no_docs):
    assert divergence.audit(no_docs).count() == 0


def test_audit_of_the_small_table(some_docs):
    got = got_rows(divergence.audit(some_docs))
    rows = [(r["text"], r["lang"], r["source"]) for r in some_docs.collect()]
    assert got == audit_brute(rows, 30, 50)


# Centroid clustering


def kmeans_brute(rows, k, rounds, dim):
    points = []
    for vec_id, vec in rows:
        if vec_id is None or vec is None or len(vec) != dim:
            continue
        if any(x is None or not math.isfinite(x) or abs(math.floor(64 * x)) >= 2**27 for x in vec):
            continue
        points.append((vec_id, [math.floor(64 * x) for x in vec]))
    start = sorted(points, key=lambda p: (hashlib.sha256(f"1:{p[0]}".encode()).hexdigest(), p[1]))[:k]
    cents = [list(v) for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in points:
            members[nearest(v)[1]].append(v)
        for i, vs in members.items():
            cents[i] = [sum(col) // len(vs) for col in zip(*vs)]
    assigned = [(vec_id, *nearest(v)[::-1]) for vec_id, v in points]
    per = Counter()
    for _, c, d in assigned:
        per[c] += d
    total = sum(per.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((vec_id, c, d, per[c], total, digest[c]) for vec_id, c, d in assigned)


def test_clusters_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 2.0, 3.0]), (62, [float("nan")] * 4), (63, [1.0, 2.0]), (None, [0.0] * 4)]
    rows += [(64, [float("inf"), 0.0, 0.0, 0.0]), (65, [1e30, 0.0, 0.0, 0.0]), (5, rows[5][1]), (70, [0.0] * 4), (71, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, v int")
    got = sorted(tuple(r) for r in centroids.report(df, k=5, rounds=3, dim=4).collect())
    floats = [(i, None if v is None else [None if x is None else float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    assert got == kmeans_brute(floats, 5, 3, 4)


def test_fewer_vectors_than_centroids_and_none(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in centroids.report(df, k=16, rounds=3, dim=2).collect())
    assert got == kmeans_brute([(1, [0.5, 0.25]), (2, [0.5, 0.25])], 16, 3, 2)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.report(empty).count() == 0


def test_clusters_of_the_small_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = sorted(tuple(r) for r in centroids.report(df).collect())
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    assert got == kmeans_brute(rows, 16, 3, 64)


# Nearest neighbours


def exact_top(rows, every, top, dim):
    kept = {}
    for vec_id, vec in rows:
        if vec_id is None or vec is None or len(vec) != dim or any(x is None or not math.isfinite(x) for x in vec) or not any(vec):
            continue
        kept[vec_id] = min(kept.get(vec_id, vec), vec)
    out = {}
    for q, xq in kept.items():
        if q % every == 0:
            scored = sorted(((sum(a * b for a, b in zip(xq, xc)), c) for c, xc in kept.items() if c != q), key=lambda s: (-s[0], s[1]))
            out[q] = [(c, s) for s, c in scored[:top]]
    return out


def test_neighbours_exact_on_a_small_odd_table(spark):
    import random

    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    rows += [(40, None), (41, [0.0, 0.0, 0.0]), (42, [1.0, None, 1.0]), (43, [float("nan"), 1.0, 1.0]), (44, [1.0, 2.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (3, [9.0, 9.0, 9.0]), (60, [1.0, 1.0, 1.0]), (80, [1.0, 1.0, 1.0]), (100, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<double>, q int, c string")
    found = neighbours.nearest(df, every=20, top=7, dim=3)
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = exact_top(rows, 20, 7, 3)
    assert set(got) == set(want)
    for q in want:
        assert [c for c, _ in got[q]] == [c for c, _ in want[q]]
        assert all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got[q], want[q]))
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_neighbours_recall_on_the_small_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    want = exact_top(rows, 20, 20, 64)
    found = neighbours.nearest(df).collect()
    got = defaultdict(dict)
    for r in found:
        got[r["query_id"]][r["vec_id"]] = r["score"]
    hit = sum(len(set(got[q]) & {c for c, _ in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.9
    exact = {c: s for q in want for c, s in want[q]}
    scores = {(q, c): s for q in want for c, s in want[q]}
    assert all(abs(s - scores[(q, c)]) < 1e-12 for q in got for c, s in got[q].items() if (q, c) in scores) and exact
    assert all(len(got[q]) == 20 for q in want)


def test_neighbours_recall_with_norms_groups_and_copies(spark):
    """Gaussian vectors of spread norms, small tight groups, an outlier, copies and near copies."""
    import numpy as np

    draw = np.random.default_rng(4)
    gauss = draw.standard_normal((600, 64)) * draw.lognormal(0, 1, (600, 1))
    groups = draw.standard_normal((60, 64))[draw.integers(0, 60, 600)] + 0.01 * draw.standard_normal((600, 64))
    near = gauss[1] + 1e-3 * draw.standard_normal((200, 64))
    x = np.concatenate([gauss, groups, np.repeat(gauss[:1], 200, axis=0), near, 1000 * draw.standard_normal((1, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    hit = 0
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        least = np.sort(scores)[-20] - 1e-9 * abs(np.sort(scores)[-20])
        assert len(set(got[q])) == 20 and q not in got[q]
        hit += sum(scores[c] >= least for c in got[q])
    assert hit >= 0.97 * 20 * len(range(0, len(x), 20))


def test_term_counts_of_odd_texts_and_groups(spark):
    """Counted in the tasks of the partitions: odd texts, other alphabets, null groups."""
    import re
    from collections import Counter

    from matchlake.llm import divergence

    texts = ["Aa bB aa\tÉé 1x_y", None, "", "日本 語a B c-d", "aa AA aA", "x\x00y z\x7fz"]
    rows = [(t, lang, s) for t in texts for lang in ("en", None) for s in ("web", None)] * 2
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    count, docs = Counter(), Counter()
    for text, lang, source in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        count.update((lang or "", source or "", t) for t in terms)
        docs.update((lang or "", source or "", t) for t in set(terms))
    counts, groups = divergence.term_counts(df)
    assert {(r["lang"], r["source"], r["term"]): (r["c"], r["df"]) for r in counts.collect()} == {k: (n, docs[k]) for k, n in count.items()}
    assert groups.count() == 4 and "MapInArrow" in counts._jdf.queryExecution().executedPlan().toString()


def test_neighbours_rounds_are_small_jobs(spark, monkeypatch):
    """The driver holds plans and figures of every exchange, so rounds have few; vectors reach a bucket once a query."""
    import numpy as np

    draw = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.standard_normal((300, 64)))], "vec_id long, embedding array<double>")
    plans = []

    def written(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return frame.checkpoint()

    monkeypatch.setattr(neighbours, "checkpointed", written)
    monkeypatch.setattr(neighbours, "BUCKET", 50)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in neighbours.nearest(df).collect()}
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()])
    for q in range(0, 300, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        assert [got[q, r] for r in range(1, 21)] == np.argsort(-scores)[:20].tolist()
    rounds = [p for p in plans if "MapInArrow" in p]
    assert max(p.count("Repartition") + p.count("Aggregate") + p.count("Join ") for p in rounds) <= 7
    assert not any("Window" in p for p in rounds)
