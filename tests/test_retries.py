"""Task failures before each shuffle and inside each write stage are
retried without losing or duplicating a row (see ``retry_job.py``)."""

import json
import os
import subprocess
import sys

from conftest import SF001

HERE = os.path.dirname(os.path.abspath(__file__))


def test_silver_and_gold_survive_task_failures():
    out = subprocess.run(
        [sys.executable, os.path.join(HERE, "retry_job.py"), SF001],
        capture_output=True,
        text=True,
        timeout=600,
        check=True,
    )
    result = json.loads(out.stdout.strip().splitlines()[-1])
    assert result["failed_attempts"] >= 2
    assert result["same"] and result["rows"] == 6000
    assert result["gold_failed_attempts"] >= 2
    assert result["gold_same"] and result["gold_rows"] == 150
    assert result["bronze_failed_attempts"] >= 1 and result["bronze_same"]
