"""The entry module with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LEDGER = "{k for k in e.queries() if not k.startswith('op') and k != 'pipeline'}"


def names(folder, expression):
    code = f"import __spark_entry__ as e; print('\\n'.join(sorted({expression})))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def copied(tmp_path, *left_out):
    target = tmp_path / "copy"
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", *left_out))
    return target


def test_without_the_subpackage(tmp_path):
    alone = names(copied(tmp_path, "llm", "corpus_pipeline.py"), "e.queries()")
    assert alone == names(ROOT, LEDGER) and len(alone) == 43


def test_a_library_that_is_missing_leaves_the_subpackage_out_with_a_warning(tmp_path):
    if not (ROOT / "ledgerscope" / "llm").exists():
        pytest.skip("the subpackage is not installed")
    target = copied(tmp_path)
    (target / "ledgerscope" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=target, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and done.stdout.split() == ["43", "43"]
    assert "a_module_that_is_not_there" in done.stderr


def test_other_errors_are_not_let_pass(tmp_path):
    if not (ROOT / "ledgerscope" / "llm").exists():
        pytest.skip("the subpackage is not installed")
    target = copied(tmp_path)
    (target / "ledgerscope" / "llm" / "queries.py").write_text("1 / 0\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=target, capture_output=True,
                          text=True, timeout=120)
    assert done.returncode != 0 and "ZeroDivisionError" in done.stderr
