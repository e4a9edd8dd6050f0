"""The driver's entry with and without the optional text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


def run(folder):
    return subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(folder)})


def copied(tmp_path):
    folder = tmp_path / "repo"
    os.makedirs(folder)
    shutil.copytree(f"{ROOT}/seabedflow", folder / "seabedflow", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", folder)
    return folder


def test_without_the_text_operators(tmp_path):
    folder = copied(tmp_path)
    shutil.rmtree(folder / "seabedflow" / "llm", ignore_errors=True)
    got = run(folder)
    assert got.returncode == 0 and int(got.stdout.split()[0]) > 60 and got.stdout.split()[1] == "False"


def test_an_error_inside_an_optional_module_is_not_hidden(tmp_path):
    folder = copied(tmp_path)
    (folder / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    got = run(folder)
    assert got.returncode != 0 and "a_module_that_is_not_there" in got.stderr
