"""Each operator with workers in a process that cannot import the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from factbase.session import build_session
from factbase.llm.queries import QUERIES
spark = build_session("shipping", "local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false",
                                                 "spark.checkpoint.dir": sys.argv[2]})
for name in ("op2_decontaminate", "op3_substrings", "op4_language", "op5_pages", "op12_runs", "op13_token_counts"):
    QUERIES[name][0](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name)
def known(rows):
    import importlib.util
    return [(importlib.util.find_spec("factbase") is not None,) for _ in rows]
print("known", spark.sparkContext.parallelize([1], 1).mapPartitions(known).collect()[0][0])
"""


def test_worker_code_travels_with_the_job(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "job.py").write_text(SCRIPT)
    done = subprocess.run([sys.executable, str(tmp_path / "job.py"), ROOT, str(tmp_path / "cut")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == 6 and "known False" in done.stdout
