"""The driver may import the entry module from any working directory."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {os.path.join(ROOT, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
n = E.queries()["nearest_other"](spark, "/root/testdata/sf0.001").count()
m = E.queries()["udf_batch_hook"](spark, "/root/testdata/sf0.001").agg({{"n_vowels": "sum"}}).first()[0]
print("RESULT", n, m)
"""


def test_kernels_run_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    line = [x for x in out.stdout.splitlines() if x.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    _, n, m = line[0].split()
    assert int(n) > 0 and int(m) > 0


def test_entry_without_the_text_pipeline():
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
sys.modules["assaylake.llm"] = None  # as if the folder were not there
import __spark_entry__ as E
from assaylake.plans.catalog import QUERIES
assert set(E.queries()) == set(QUERIES) == set(E.oracle_sql())
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=300)


def test_nothing_else_imports_the_text_pipeline():
    for folder, _, files in os.walk(os.path.join(ROOT, "assaylake")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "assaylake.llm" not in text.read(), f
