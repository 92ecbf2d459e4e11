"""The entry module: names, and that it works without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_works_without_the_optional_parts(tmp_path):
    kept = tmp_path / "repo"
    shutil.copytree(ROOT, kept, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q) > 80 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=kept, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.stdout.strip() == "True"


def test_a_module_that_the_optional_parts_need_is_missed_aloud(tmp_path):
    kept = tmp_path / "repo"
    shutil.copytree(ROOT, kept, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=kept, capture_output=True, text=True, check=False, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode and "xxhash" in done.stderr


def test_nothing_else_imports_the_optional_parts():
    for folder, _, names in os.walk(os.path.join(ROOT, "quillspark")):
        if "llm" in folder:
            continue
        for name in (n for n in names if n.endswith(".py")):
            with open(os.path.join(folder, name)) as f:
                assert "quillspark.llm" not in f.read()
