"""bench.py prints exactly one JSON line in the driver's format."""

import json
import os
import subprocess
import sys


def test_bench_prints_one_json_line():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_QUERIES="keyword_search")
    out = subprocess.run([sys.executable, "bench.py"], cwd=root, env=env, capture_output=True, text=True,
                         timeout=600)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1, out.stdout + out.stderr[-2000:]
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and rec["sf"] == 0.001 and set(rec["queries"]) == {"keyword_search"}
    assert rec["value"] == rec["queries"]["keyword_search"]
