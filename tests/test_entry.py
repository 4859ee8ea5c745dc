"""The entry file works with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q))"


def said(at):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SAY], cwd=at, env=env, capture_output=True, text=True, check=True)
    return [int(x) for x in out.stdout.split()]


def copied(tmp_path, *without):
    skip = shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md")
    return shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: set(skip(d, names)) | {n for n in names if os.path.relpath(os.path.join(d, n), ROOT) in without})


def test_without_the_two_folders_but_with_the_pipeline_file(tmp_path):
    n, of_llm = said(copied(tmp_path, "factloom/llm", "tests/llm"))
    assert n > 90 and of_llm == 0


def test_without_folders_and_pipeline_file(tmp_path):
    n, of_llm = said(copied(tmp_path, "factloom/llm", "tests/llm", "corpus_pipeline.py"))
    assert n > 90 and of_llm == 0
