"""The entry module works with and without the training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "gleaner.llm" or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Hide())
"""


def names(code):
    out = subprocess.run([sys.executable, "-c", code + "\nimport __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=ROOT, capture_output=True, text=True, check=True)
    return [set(line.split()) for line in out.stdout.splitlines()]


def test_without_the_subpackage():
    queries, sql = names(HIDE)
    assert "hybrid_topk" in queries and sql <= queries and not any(q.startswith("op") and q[2].isdigit() for q in queries)


def test_sql_belongs_to_queries():
    queries, sql = names("")
    assert sql <= queries
