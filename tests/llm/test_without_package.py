"""Workers need no copy of the package: functions travel with their code."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from reqsieve.session import local_session
spark = local_session(4, "apart")
def importable(_):
    import importlib.util
    return [importlib.util.find_spec("reqsieve") is not None]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [False]
from reqsieve.llm.queries import QUERIES
for name in {names!r}:
    assert QUERIES[name](spark, {sf_dir!r}).count() > 0, name
print("all ran")
"""

NAMES = ["op1_token_files", "op3_decontaminate", "op8_personal_data", "op10_warc_captures", "op11_hard_negatives", "op13_chunk_reuse"]


def test_workers_without_the_package(sf_dir, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=REPO, names=NAMES, sf_dir=sf_dir)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-2000:]
