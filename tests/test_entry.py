"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("quillrank.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert "scores_okapi" in names and not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(e.oracle_sql()) <= set(names)
"""


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_nothing_imports_the_subpackage():
    for source in (ROOT / "quillrank").rglob("*.py"):
        if "llm" not in source.parts:
            assert "quillrank.llm" not in source.read_text()
