"""The package reaches Python workers that do not have it."""

import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from tillmark.session import local_session
from tillmark.plans import registry
spark = local_session("2", 2, "2g")
print("ROWS", registry.queries()["ts6_arima_forecast"](spark, {folder!r}).count())
def worker(batches):
    import tillmark.operators.trees
    yield from batches
print("SEEN", spark.range(3).mapInArrow(worker, "id long").count())
"""


def test_a_session_started_elsewhere(tmp_path, folder):
    root = str(Path(__file__).resolve().parents[1])
    run = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(root=root, folder=folder)], cwd=tmp_path, capture_output=True, text=True, timeout=300,
    )
    assert "SEEN 3" in run.stdout, run.stderr[-2000:]
