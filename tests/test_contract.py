"""What the driver relies on."""

import json
import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and "regime" in found.columns


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bench_prints_one_line():
    env = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_QUERIES": "bars_daily"}
    out = subprocess.run([sys.executable, "bench.py"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300, check=True).stdout
    found = json.loads(out.strip().splitlines()[-1])
    assert found["queries"].keys() == {"bars_daily"} and found["sf"] == "0.001"


def test_nothing_else_imports_the_llm_package():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
