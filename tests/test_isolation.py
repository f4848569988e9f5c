"""The rest of the library without the optional subpackage, in a copy."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'label_top10' in q and 'job1_brick_demand' in q and set(o) <= set(q); print(sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_without_the_subpackage(tmp_path, pipeline_too):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "jobs", "voxelspark"):
        if os.path.exists(f"{HERE}/{name}"):
            (shutil.copytree if os.path.isdir(f"{HERE}/{name}") else shutil.copy)(f"{HERE}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "voxelspark" / "llm", ignore_errors=True)
    if pipeline_too and (tmp_path / "corpus_pipeline.py").exists():
        os.remove(tmp_path / "corpus_pipeline.py")
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[-1] == "0"
