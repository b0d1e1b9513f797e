"""The pipeline against brute force, stage by stage, and on tables that try to break it."""

import hashlib
import os
import subprocess
import sys

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from matchlake.llm import quality
from tests.llm import brute
from tests.llm.conftest import ODD, SF

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def expected(docs, verdicts, items):
    """docs: (id, text). Rows of the last stage."""
    docs = [(i, t) for i, t in docs if verdicts[i]]
    docs = [(i, kept) for i, _, _, _, kept in brute.kept_lines(docs)]
    group = brute.components(docs, 80)
    docs = [(i, t) for i, t in docs if group[i] == i and not brute.benchmark_hits(t, items)[1]]
    out = []
    for i, t in docs:
        ids = LIBRARY.encode(t)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids))]
        out.append((i, len(ids), *digest))
    return sorted(out)


def test_run_equals_brute_force(spark, some_docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in some_docs.collect()]
    verdicts = {r["doc_id"]: r["kept"] for r in quality.assess(some_docs).collect()}
    for i, t in docs:
        n, _, _, _, repeated = brute.statistics(t)
        assert not verdicts[i] or (n >= 50 and 100 * repeated <= 50 * n)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    want = expected(docs, verdicts, items)
    assert got == want
    assert 50 < len(got) < len(docs)


@pytest.fixture(scope="module")
def odd_table(spark):
    long_ = " ".join(f"word{i}" for i in range(120))
    rows = [(i, t, None, "src", None) for i, t in enumerate(ODD)] + [
        (500, long_, "en", None, 5), (500, long_, "en", None, 5), (501, long_, "xx", "s", 1), (None, long_, None, None, None), (None, None, None, None, None)
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({"body": F.lit("b"), "n": F.lit(1), "kept": F.lit(False), "words": F.lit(0), "n_words": F.lit(2)})


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd_table, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    last = stage == corpus_pipeline.STAGES[-1][0]
    for docs in (odd_table, odd_table.limit(0)):
        out = run(spark, docs, SF)
        rows = out.collect()
        assert last or out.columns == corpus_pipeline.COLUMNS
        assert len(rows) <= docs.count()
        if stage in ("line dedup", "pieces"):
            assert len(rows) == docs.count()


def test_near_copies_keep_the_smallest_id(spark, odd_table):
    ids = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, odd_table, SF).collect()]
    assert 500 in ids and 501 not in ids and ids.count(None) == 2


def test_library_works_without_the_text_operators(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("matchlake.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = entry.queries()
assert names and "pipeline" not in names and not any(n.startswith("op") for n in names)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_run_leaves_one_stage_table(spark, tmp_path):
    """Earlier stage tables are deleted once the next is written; the last one written stays for the result."""
    folder = str(tmp_path / "pipeline")
    rows = corpus_pipeline.run(spark, SF, folder).collect()
    assert rows and sorted(os.listdir(folder)) == [str(len(corpus_pipeline.STAGES) - 2)]
