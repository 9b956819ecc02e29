import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_imports_without_the_training_data_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "haplospark"), tmp_path / "haplospark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'size_clusters' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_the_other_tests_import_without_the_training_data_operators(tmp_path):
    leave = shutil.ignore_patterns("llm", "__pycache__", ".git", ".pytest_cache", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=leave)
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert done.returncode == 0 and "tests/llm" not in done.stdout, done.stdout[-2000:]


def test_a_broken_operator_is_not_hidden(tmp_path):
    shutil.copytree(os.path.join(ROOT, "haplospark"), tmp_path / "haplospark", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    (tmp_path / "haplospark/llm/packing.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode != 0 and "no_such_module" in done.stderr


def test_flagship_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
