"""Text operators against brute force over plain lists, on odd texts and on the small tables."""

import math

import pytest
from pyspark.sql import functions as F

from matchlake.llm import decontaminate, license_scan, line_dedup, near_dedup, preference, quality, queries, url_filter
from matchlake.llm.graph import connected_components
from matchlake.llm.license_rules import rules
from tests.llm import brute
from tests.llm.conftest import SF

BOTH = pytest.mark.parametrize("which", ["odd_docs", "some_docs", "no_docs"])


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# Line dedup


@BOTH
@pytest.mark.parametrize(("min_docs", "keep"), [(10, "none"), (2, "none"), (2, "first"), (1, "first")])
def test_lines(which, min_docs, keep, request):
    docs = request.getfixturevalue(which)
    found = line_dedup.keep_bitmaps(docs, min_docs=min_docs, keep=keep)
    found = found.withColumn("kept", line_dedup.kept_text(F.col("text"), F.col("n_dropped"), F.col("keep_runs")))
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["kept"]) for r in found.collect()]
    expected = brute.kept_lines(pairs(docs), min_docs, keep=keep)
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_line_runs_of_long_texts(spark):
    text = "\n".join(["same", "own"] * 2000)
    rows = [(1, text), (2, text.replace("own", "mine")), (3, None), (4, "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.keep_bitmaps(docs, min_docs=2)
    found = found.withColumn("kept", line_dedup.kept_text(F.col("text"), F.col("n_dropped"), F.col("keep_runs")))
    got = {r["doc_id"]: r["kept"] for r in found.collect()}
    assert got == {i: kept for i, _, _, _, kept in brute.kept_lines(rows, 2)}


# Near copies


def test_near_copies_of_all_kinds(spark, odd_docs):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, t) for i, t in pairs(odd_docs)]
    for k in range(60):
        changed = list(base)
        for j in range(k % 6):
            changed[(37 * k + 31 * j) % 200] = f"x{k}-{j}"
        rows.append((1000 + k, " ".join(changed)))
    rows += [(2000, "a b c d"), (2001, "A  b\nc d"), (2002, "a b c d e"), (2003, " ".join(base * 30))]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, node int, key string")
    expected = brute.components(rows)
    for r in near_dedup.near_duplicates(docs).collect():
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert r["component_id"] == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("block", [4096, 7])
def test_near_copies_of_documents(some_docs, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    rows = pairs(some_docs)
    expected = brute.components(rows)
    got = near_dedup.near_duplicates(some_docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(brute.shingles(t)) for i, t in rows}


@pytest.mark.parametrize("percent", [80, 90])
def test_near_copies_at_other_thresholds(spark, some_docs, percent):
    base = [f"w{i}" for i in range(100)]
    rows = pairs(some_docs)
    for k in range(40):
        # 0 to 7 changed words of 100: similarities from 1 down to about 0.73.
        changed = list(base)
        for j in range(k % 8):
            changed[(13 * k + 29 * j) % 100] = f"y{k}-{j}"
        rows.append((5000 + k, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, percent=percent).collect()}
    assert got == brute.components(rows, percent)


def test_no_near_copies(no_docs):
    assert near_dedup.near_duplicates(no_docs).collect() == []
    with pytest.raises(ValueError, match="80"):
        near_dedup.near_duplicates(no_docs, percent=79)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (100, 101)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# Decontamination

ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, None), (4, "..."),
    (5, "two THREE four, five six seven eight nine ten eleven"), (5, "one two three four five six seven eight nine ten eleven"),
    (11, "short item"),
]
LEAKS = [
    (1, "x one two three four five six seven eight nine ten eleven y"), (2, "a short-item, short item short"),
    (3, "two three four five six seven eight nine ten ELEVEN"), (4, "one two three four five six seven eight nine"),
    (5, None), (6, ""), (7, "short item " * 500), (None, "a short item"), (8, "É short éitem"), (2, "a short-item, short item short"),
]


@pytest.mark.parametrize("max_windows", [50_000, 0])
def test_leaks(spark, max_windows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in LEAKS], "doc_id long, text string, words string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = decontaminate.scan(docs, bench, max_windows=max_windows).collect()
    expected = {(i, *map(str, brute.benchmark_hits(t, ITEMS))) for i, t in LEAKS}
    rows = set()
    for r in got:
        hit = [k for s in r["spans"] for k in range(s["start"], s["end"])]
        assert len(hit) == r["n_hit"]
        rows.add((r["doc_id"], str(r["n_words"]), str(hit), str(r["items"])))
    assert rows == expected
    assert len(got) == len(set(LEAKS))


def test_leaks_removed(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in LEAKS], "doc_id long, text string, words string")
    bench = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id long, text string")
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(pairs(clean), key=str) == sorted([x for x in LEAKS if not brute.benchmark_hits(x[1], ITEMS)[1]], key=str)
    cut = decontaminate.decontaminate(docs, bench, action="spans")
    assert len(pairs(cut)) == len(LEAKS)
    for i, t in pairs(cut):
        before = [x for x in LEAKS if x[0] == i][0][1]
        hit = brute.benchmark_hits(before, ITEMS)[1]
        assert brute.plain_words(t) == [w for k, w in enumerate(brute.plain_words(before)) if k not in hit]
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(LEAKS)


def test_leaks_removed_beside_working_names(spark):
    """Input columns named like the working columns stay untouched."""
    names = ["_hit_doc", "_hit_body", "_hit_spans", "body", "spans", "n_hit"]
    docs = spark.createDataFrame([(i, t, *names) for i, t in LEAKS], ", ".join(["doc_id long", "text string"] + [f"{n} string" for n in names]))
    bench = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id long, text string")
    for action in ("documents", "spans"):
        out = decontaminate.decontaminate(docs, bench, action=action)
        assert out.columns == docs.columns
        assert all(list(r)[2:] == names for r in out.collect())


def test_op6_query(spark, some_docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = dict(pairs(some_docs))
    for r in queries.op6_decontaminate(spark, SF).collect():
        n, hit, found = brute.benchmark_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, len(hit), len(found))


# Licenses

LICENSED = [
    "Licensed under the Apache License, Version 2.0. See the MIT license", "under the mit license under the MIT License",
    "SPDX-License-Identifier: Apache-2.0; cc by nc cc-by-nc 4.0", "mit der und", "GNU General Public License v3 or gpl 2",
    "released under the GNU Lesser General Public License version 2.1, public domain", None, "", "apache license version 2",
    "This is dual licensed under the terms of the BSD 3-clause license. " * 200, "Creative Commons Attribution-ShareAlike 4.0",
]


@pytest.mark.parametrize("which", ["licensed", "odd_docs", "some_docs", "no_docs"])
def test_licenses(spark, which, request):
    if which == "licensed":
        rows = [(i, t, "m") for i, t in enumerate(LICENSED)] + [(None, LICENSED[0], "m"), (1, LICENSED[1], "m")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    else:
        docs = request.getfixturevalue(which)
    expected = set()
    for i, t in pairs(docs):
        w = brute.plain_words(t)
        places = [
            (k, label)
            for phrase, label in license_scan.PHRASES.items()
            for k in range(len(w))
            if w[k : k + len(phrase.split())] == phrase.split()
        ]
        own = brute.detections(t, rules())
        base = {label for _, label in places}
        surest = 1.0 if places else max([r.score for r in own], default=0.0)
        expected.add((i, len(w), str(sorted(places)), ",".join(sorted(base)), ",".join(sorted(base | {r.label for r in own})), surest))
    got = {
        (r["doc_id"], r["n_words"], str(sorted((p["start"], p["label"]) for p in r["places"])), ",".join(r["base_labels"]), ",".join(r["labels"]), r["score"])
        for r in license_scan.scan(docs).collect()
    }
    assert got == expected


def test_rules_are_many_and_ordered():
    table = rules()
    assert len(table) > 300
    assert [r.priority for r in table] == sorted(r.priority for r in table)


# Quality


@BOTH
def test_statistics(which, request):
    docs = request.getfixturevalue(which)
    docs = docs.withColumn("lang", F.lit(None).cast("string")) if "lang" not in docs.columns else docs
    got = quality.assess(docs).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    expected = [(i, *brute.statistics(t)) for i, t in pairs(docs)]
    assert sorted([(r["doc_id"], *[r[n] for n in names]) for r in got], key=str) == sorted(expected, key=str)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_model_is_a_distribution_and_equals_plain_kneser_ney():
    import numpy as np

    from matchlake.llm import ngram_model as m

    text = b"the cat sat on the mat and the dog sat on the log. " * 3 + "äß 12".encode()
    grams, counts = np.unique(m.codes(text), return_counts=True)
    model = m.KneserNey(grams, counts)
    head = int(m.codes(b"the ")[-1]) >> m.CLASS_BITS << m.CLASS_BITS
    for context in (head, 0, 31 << 15 | 31 << 10 | 31 << 5):
        logs = model.log_probabilities(np.arange(context, context + 32))
        assert math.isclose(np.exp(logs).sum(), 1, rel_tol=1e-4)
    # Orders one to four, counted with dictionaries.
    full = {tuple((g >> s) & 31 for s in (15, 10, 5, 0)): int(c) for g, c in zip(grams, counts)}
    level, probability = full, {}
    levels = {4: full}
    for order in (3, 2, 1):
        level = {}
        for g in levels[order + 1]:
            level[g[1:]] = level.get(g[1:], 0) + 1
        levels[order] = level

    def discount(values, c):
        n = [sum(1 for v in values if v == k) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return 0.5
        y = n[0] / (n[0] + 2 * n[1])
        k = min(c, 3)
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0
        return min(max(d, 0.0), k)

    def p(g):
        if not g:
            return 1 / 32
        values = levels[len(g)]
        same = {h: c for h, c in values.items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        left = sum(discount(values.values(), c) for c in same.values()) / total
        c = same.get(g, 0)
        return (c - discount(values.values(), c) if c else 0) / total + left * p(g[1:])

    for gram in [*grams[:40].tolist(), head | 5, 12345]:
        expected = math.log(p(tuple((gram >> s) & 31 for s in (15, 10, 5, 0))))
        assert math.isclose(model.log_probabilities(np.array([gram]))[0], expected, rel_tol=1e-4)


def test_bands_reject_what_stands_out(spark):
    rows = [("en", 60, 1.4 + k / 10_000) for k in range(1000)] + [("de", 60, 2.0)] * 9 + [("en", 60, 0.2), ("en", 60, 9.0), ("en", 3, 50.0), ("en", 99, None)]
    found = quality.bands(spark.createDataFrame(rows, "model string, n_words long, nats double"))
    low, high = found["en"]
    assert 0.2 < low < 1.4 and 1.5 < high < 9.0
    assert found["de"] == pytest.approx((2.0 - quality.LEAST_REACH[0], 2.0 + quality.LEAST_REACH[1]))


def test_noise_is_the_least_expected(spark):
    import random

    random.seed(1)
    syllables = ["ba", "lo", "ri", "sel", "tu", "re", "mi", "no"]
    prose = [" ".join("".join(random.choices(syllables, k=random.randint(1, 4))) for _ in range(200)) for _ in range(100)]
    noise = " ".join("".join(random.choices("qxzjwkv0123456789#%&@~^", k=5)) for _ in range(200))
    rows = [(i, t, "en") for i, t in enumerate(prose)] + [(999, noise, "en")]
    got = {r["doc_id"]: r for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert max(got.values(), key=lambda r: r["perplexity"])["doc_id"] == 999
    assert all(got[i]["kept"] for i in range(100))


def test_op1_keeps_clean_documents(spark):
    got = queries.op1_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    clean = got.join(labels, "doc_id").where("not base_failed")
    assert clean.where("not kept").count() == 0


# URLs

URLS = [
    "http://A.Example.com/en/1?x#y", "https://www.example.com/en/2", "https://x.www.example.com/en/", "http://example.com/fr/3", "http://com",
    "http://site.net/es/", "http://site.net/esx", "ftp://h.org/a.html", "http://h.org/a/", "http://m.h.org/a?utm", None, "", "no scheme/en/",
    "http://", "://h.org/b", "http://h.org?a://b/c", "HTTP://H.ORG/c#/en/", "http://É.org/\n/x", "http://example.comx/en/",
]


def test_urls(spark):
    rows = [(i, u, 1) for i, u in enumerate(URLS)] + [(None, "http://h.org/a", 1), (7, "ftp://h.org/a.html", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    listed = spark.createDataFrame([("h.org/a",), ("h.org/a",), (None,), ("h.org/b",)], "url string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) for r in url_filter.judge(pages, listed).collect()}
    expected = set()
    for i, u, _ in rows:
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host, tail = brute.lower(rest[:cut]), rest[cut:]
        path = tail[: next((k for k, c in enumerate(tail) if c in "?#"), len(tail))]
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        known = (host.removeprefix("www.").removeprefix("m.") + path.rstrip("/").removesuffix(".html")) in ("h.org/a", "h.org/b")
        expected.add((i, host, path, rule, verdict or ("block" if known else "allow"), known))
    assert got == expected


def test_bloom_filter_has_no_false_negatives_and_few_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h.org/"), "id").alias("url"))
    pages = spark.range(20000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), "id").alias("url"))
    got = url_filter.judge(pages, listed, rules=[])
    assert got.where("listed").count() == 3000
    assert got.where("listed and not maybe").count() == 0
    assert got.where("maybe and not listed").count() < 100
    none = url_filter.judge(pages, listed.limit(0), rules=[])
    assert none.where("maybe or listed").count() == 0
    assert url_filter.blocks_for(10**12) == url_filter.MAX_BLOCKS


# Preferences


def test_preferences(spark):
    def turns(*texts):
        return [(k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]

    rows = [
        (1, turns("q", "a", "r", "b"), turns("q", "a", "r", "c")), (2, turns("q", "a"), turns("q", "a")), (3, turns("q", "a"), None),
        (4, [], []), (5, turns("q", None), turns("q", None, "z")), (6, turns("x"), turns("y")), (None, None, turns("q", "")),
    ]
    kind = "array<struct<turn:long,role:string,text:string>>"
    frame = spark.createDataFrame([(*r, 1) for r in rows], f"pair_id long, chosen {kind}, rejected {kind}, n_prefix int")
    got = {r["pair_id"]: r for r in preference.format_pairs(frame).collect()}

    def rendered(ts):
        return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for _, r, t in ts)

    for i, a, b in rows:
        a, b = a or [], b or []
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x[1:] != y[1:]), min(len(a), len(b)))
        row = got[i]
        assert (row["n_prefix"], row["prompt"]) == (n, rendered(a[:n]))
        assert (row["chosen_completion"], row["rejected_completion"]) == (rendered(a[n:]), rendered(b[n:]))
        trained = "".join(p["text"] for p in row["rejected_pieces"] if p["trained"])
        assert trained == "".join(f"{t or ''}<|end|>\n" for _, r, t in b[n:] if r == "assistant")


def test_swapped_answers(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "z"), (2, 1, "assistant", "b"), (2, 2, "user", "thanks"), (4, 0, None, None), (None, 0, "user", "n")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r["pair_id"]: ([t["text"] for t in r["chosen"]], [t["text"] for t in r["rejected"]]) for r in preference.swapped_answers(table).collect()}
    assert got == {1: (["q", "a"], ["q", "b"]), 2: (["z", "b"], ["z"]), 4: ([None], []), None: (["n"], [])}
    assert preference.swapped_answers(table.limit(0)).collect() == []
