"""The entry holds without the subpackage of training-data operators, and without the pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"


def asked(folder):
    done = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return done.stdout.split()


@pytest.mark.parametrize("gone", [("tessera/llm",), ("tessera/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without(tmp_path, gone):
    shutil.copytree(f"{ROOT}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{f}"):
            shutil.copy(f"{ROOT}/{f}", tmp_path)
    for f in gone:
        path = tmp_path / f
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    n, numbered, pipeline = asked(tmp_path)
    assert int(n) > 150 and pipeline == "False"
    assert (numbered == "True") == ((tmp_path / "tessera/llm").exists())
