import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["old_id", "current_id", "kind"]
    assert df.count() > 0


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_works_without_corpus_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e\nassert 'pipeline' not in e.queries() and len(e.queries()) > 90 and len(e.oracle_sql()) > 90\n"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    (copy / "reconloom" / "llm").mkdir()
    (copy / "reconloom" / "llm" / "__init__.py").write_text("")
    (copy / "corpus_pipeline.py").write_text("import no_such_library\n")
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode != 0 and "no_such_library" in done.stderr  # other missing modules are not swallowed


def test_workers_find_the_package(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from reconloom.session import local_session\n"
        "import __spark_entry__ as e\n"
        "print(e.queries()['sequence_ratio'](local_session(2, 2), '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
