"""The entry module and the core queries stand without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def listed(folder):
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, capture_output=True, text=True, check=True)
    return [line.split() for line in done.stdout.splitlines()]


def copy(tmp_path, *leave_out):
    shutil.copytree(REPO, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", *leave_out))
    return tmp_path / "copy"


def test_without_folders_and_pipeline(tmp_path):
    from tickloom.plans.queries import QUERIES

    queries, oracles = listed(copy(tmp_path, "llm", "corpus_pipeline.py"))
    assert set(queries) == set(oracles) == set(QUERIES)


def test_core_tests_run_without_the_folders(tmp_path):
    folder = copy(tmp_path, "llm", "corpus_pipeline.py")
    wanted = ["tests/test_xls.py::test_all_kinds_of_cells", "tests/test_queries.py::test_query_equals_sql[scan_filter_panel]", "tests/test_queries.py::test_entry"]
    done = subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider", *wanted], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-2000:]


def test_without_the_folders_only(tmp_path):
    from tickloom.plans.queries import QUERIES

    queries, _ = listed(copy(tmp_path, "llm"))
    assert set(queries) == set(QUERIES)


def test_other_missing_modules_are_reported(tmp_path):
    folder = copy(tmp_path, "execution.py")
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, capture_output=True, text=True)
    assert done.returncode and "tickloom.operators.execution" in done.stderr
