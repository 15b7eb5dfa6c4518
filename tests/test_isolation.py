"""The entry without the subpackage of training-data operators."""

import json
import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTED = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def copied(target, left_out):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(f"{REPO}/{name}"):
            shutil.copy(f"{REPO}/{name}", target)
    shutil.copytree(f"{REPO}/vecmill", f"{target}/vecmill", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    return subprocess.run([sys.executable, "-c", LISTED], cwd=target, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})


@pytest.mark.parametrize("left_out", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_entry_without_the_subpackage(tmp_path, left_out):
    from vecmill.plans.oracles import ORACLES
    from vecmill.plans.queries import QUERIES

    done = copied(tmp_path, left_out)
    assert done.returncode == 0, done.stderr
    assert json.loads(done.stdout.splitlines()[-1]) == [sorted(QUERIES), sorted(ORACLES)]
