"""The entry module without the optional subpackage."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT

from echotrail.plans.catalog import QUERIES


def test_entry_imports_without_the_optional_folders(tmp_path):
    skipped = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache")
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skipped)
    assert os.path.exists(copy / "corpus_pipeline.py") and not os.path.exists(copy / "echotrail" / "llm")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
        assert done.returncode == 0, done.stderr
        assert int(done.stdout.split()[0]) == len(QUERIES)
        os.remove(copy / "corpus_pipeline.py") if os.path.exists(copy / "corpus_pipeline.py") else None
