"""License rules without the keyword filter: every text that a rule's regex matches must reach it."""

import re._parser as parser

import pytest

from matchlake.llm import license_scan
from matchlake.llm.license_rules import LICENSES, rules
from tests.llm import brute

NAMED = [
    ("licensed under GPLv2", "gpl-2.0-short"), ("Licensed under GPLv3.", "gpl-3.0-short"), ("GPL2", "gpl-2.0-short"),
    ("under LGPLv3", "lgpl-short"), ("LGPLv2.1", "lgpl-short"), ("AGPLv3", "agpl-short"), ("MPLv2.0", "mpl-short"),
    ("CDDLv1.0", "cddl-1.0"), ("EUPLv1.2", "eupl-1.2"), ("EUPLv1.1", "eupl-1.1"), ("the Expat License", "mit"),
    ("PSF License", "psf-2.0"), ("NCSA Open Source License", "ncsa"), ("PNG Reference Library License", "libpng"),
    ("zero clause BSD licence", "0bsd"),
]


def detections(text):
    """As ``brute.detections``, all regexes run on every text."""
    return brute.detections(text, [r._replace(keywords=()) for r in rules()])


def language(parsed):
    """All strings of a regex without unbounded repeats."""
    out = [""]
    for kind, value in parsed:
        match str(kind):
            case "LITERAL":
                more = [chr(value)]
            case "IN":
                more = [chr(c) for _, c in value]
            case "SUBPATTERN":
                more = language(value[3])
            case "BRANCH":
                more = [x for branch in value[1] for x in language(branch)]
            case "MAX_REPEAT":
                assert value[:2] == (0, 1)
                more = ["", *language(value[2])]
            case other:
                raise ValueError(other)
        out = [a + b for a in out for b in more]
    return out


@pytest.mark.parametrize("label, keywords, name", LICENSES, ids=[x[0] for x in LICENSES])
def test_keywords_stand_in_every_name(label, keywords, name):
    for text in language(parser.parse(name)):
        words = set(text.split(" "))
        assert all(words & set(one.split("/")) for one in keywords.split(" ")), text


def test_filter_drops_no_match(spark):
    rows = [(i, t) for i, (t, _) in enumerate(NAMED)]
    rows += [(1000 + i, f"all of it is available under {n}, or not") for i, (*_, p) in enumerate(LICENSES) for n in language(parser.parse(p))[-1:]]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        expected = detections(text)
        assert set(got[i]["labels"]) - set(got[i]["base_labels"]) <= {r.label for r in expected} <= set(got[i]["labels"])
        assert got[i]["score"] == (1.0 if got[i]["base_labels"] else max(r.score for r in expected))
    for i, (_, label) in enumerate(NAMED):
        assert label in got[i]["labels"]


def test_brute_force_of_odd_texts_without_filter(odd_docs):
    got = {(r["doc_id"], ",".join(r["labels"])) for r in license_scan.scan(odd_docs).collect()}
    assert got == {(r["doc_id"], ",".join(sorted({x.label for x in detections(r["text"])}))) for r in odd_docs.collect()}


def test_many_statements_in_one_text(spark):
    """20,000 statements in one text: phrase places and detections are found once each, not once per detection."""
    line = "This code is released under the MIT License."
    df = spark.createDataFrame([(1, "\n".join([line] * 20000)), (2, line), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert len(got[1]["places"]) == 20000 and got[1]["n_words"] == 8 * 20000
    assert [p["start"] for p in got[1]["places"][:3]] == [4, 12, 20]
    assert got[1]["labels"] == got[2]["labels"] and "mit" in got[1]["labels"]
    assert got[3]["n_words"] == 0 and got[3]["places"] == [] and got[3]["score"] == 0.0
