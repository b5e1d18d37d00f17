"""The entry without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CALLS = """
import __spark_entry__ as e
names, sql = set(e.queries()), set(e.oracle_sql())
assert len(names) > 170 and sql <= names and "pipeline" not in names and not any(n.startswith("op") for n in names), sorted(names)
"""


def copied(to, *without):
    skip = lambda folder, names: [n for n in names if n in (".git", "__pycache__") or os.path.join(folder, n) in [os.path.join(ROOT, w) for w in without]]
    shutil.copytree(ROOT, to, ignore=skip)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT)}
    return subprocess.run([sys.executable, "-c", CALLS], cwd=to, env=env, capture_output=True, text=True, check=False)


def test_entry_without_the_subpackage(tmp_path):
    for i, without in enumerate([("rasterloom/llm", "tests/llm"), ("rasterloom/llm", "tests/llm", "corpus_pipeline.py")]):
        got = copied(tmp_path / str(i), *without)
        assert got.returncode == 0, got.stderr
