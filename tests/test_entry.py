"""The driver contract, with and without what only the training-data operators need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(*absent: str) -> tuple[set, set]:
    code = f"import sys\nfor m in {absent!r}: sys.modules[m] = None\nimport __spark_entry__ as e\nprint(*e.queries())\nprint(*e.oracle_sql())"
    made = subprocess.run([sys.executable, "-B", "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    return tuple(set(line.split()) for line in made.stdout.splitlines()[-2:])


def test_core_queries_need_no_tokenizers():
    queries, oracles = names("tokenizers", "public_tokenizers", "regex")
    assert "q3_shipping_priority" in queries and not any(n.startswith("op") and n[2].isdigit() for n in queries)
    assert queries == oracles
    assert queries <= names()[0]
