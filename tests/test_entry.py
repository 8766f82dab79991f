"""The entry points without the optional subpackage, and with a broken one."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()), len(e.oracle_sql()))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder) + os.pathsep + os.environ.get("PYTHONPATH", "")}, capture_output=True, text=True)


@pytest.fixture()
def copy(tmp_path):
    for name in ("__spark_entry__.py", "docweave"):
        here = ROOT / name
        (shutil.copytree if here.is_dir() else shutil.copy)(here, tmp_path / name)
    shutil.rmtree(tmp_path / "docweave" / "llm", ignore_errors=True)
    return tmp_path


def test_without_the_subpackage(copy):
    ran = names(copy)
    assert ran.returncode == 0, ran.stderr
    n, optional, _ = map(int, ran.stdout.split()[-3:])
    assert n > 300 and optional == 0
    (copy / "docweave" / "llm").mkdir()  # an empty folder is no subpackage
    assert names(copy).returncode == 0


def test_a_broken_dependency_is_an_error(copy):
    (copy / "docweave" / "llm").mkdir()
    (copy / "docweave" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    ran = names(copy)
    assert ran.returncode != 0 and "a_module_that_is_not_there" in ran.stderr
