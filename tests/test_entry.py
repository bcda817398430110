"""The driver contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert callable(__spark_entry__.entry)


@pytest.mark.parametrize("without", [("corpus_pipeline.py", "partloom/llm"), ("partloom/llm",), ()])
def test_import_without_the_subpackage(tmp_path, without):
    for name in ("__spark_entry__.py", "partloom", "corpus_pipeline.py"):
        source = os.path.join(HERE, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    for name in without:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = """if True:
        import __spark_entry__ as e
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        ran = [e.queries()[q](spark, "/root/testdata/sf0.001").count() for q in ("iso_best_match", "unique_names", "mesh_topology")] if len(e.queries()) and RUN else [1]
        print(len(e.queries()), any(q.startswith("op") for q in e.queries()), min(ran))
    """.replace("RUN", str(bool(without)))
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    n, ops, rows = said.stdout.split()[-3:]
    assert int(n) > 90 and int(rows) > 0
    if without:
        assert ops == "False"
