"""The library stands without the training-text subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_copy_without_the_text_folders_lists_the_other_queries(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", ".pytest_cache"))
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    env = {**os.environ, "PYTHONPATH": ""}
    for gone in ([], ["corpus_pipeline.py"]):
        for name in gone:
            (copy / name).unlink()
        said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
        assert said.returncode == 0, said.stderr
        n, own, sql = said.stdout.split()[-3:]
        assert int(n) > 150 and own == "0" and sql == "True"
