"""Queries run where workers find the package in no other way."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).parents[2])
CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__
from plumbline.session import local_session
spark = local_session("2")
queries = __spark_entry__.queries()
for name in ("op10_ngram_ratio", "op7_vertical_topk", "op6_capture_index", "op4_hamming_trie"):
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
