"""The entry file drops the text operators only when their own folders are gone."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith({prefixes!r}):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = entry.queries()
assert names and not any(n.startswith("op") for n in names) and "pipeline" not in names
"""


def run(prefixes):
    return subprocess.run([sys.executable, "-c", CODE.format(prefixes=prefixes)], cwd=ROOT, capture_output=True, text=True)


def test_missing_text_folders_drop_their_queries():
    assert run(("matchlake.llm", "corpus_pipeline")).returncode == 0


def test_other_missing_modules_are_not_hidden():
    done = run(("public_tokenizers",))
    assert done.returncode != 0 and "ModuleNotFoundError" in done.stderr
