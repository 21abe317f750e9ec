import subprocess
import sys

import __spark_entry__ as entry


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_package(tmp_path):
    import shutil
    from pathlib import Path

    top = Path(entry.__file__).parent
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    shutil.copytree(top / "strandbook", tmp_path / "strandbook", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'feed_pages' in q and 'pipeline' not in q"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_a_missing_module_of_the_corpus_package_is_not_hidden(tmp_path):
    import shutil
    from pathlib import Path

    top = Path(entry.__file__).parent
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    shutil.copytree(top / "strandbook", tmp_path / "strandbook", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "strandbook" / "llm").mkdir()
    (tmp_path / "strandbook" / "llm" / "__pycache__").mkdir()
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True)
    assert run().returncode == 0  # an empty folder is left behind
    (tmp_path / "strandbook" / "llm" / "__init__.py").write_text("")
    (tmp_path / "strandbook" / "llm" / "queries.py").write_text("import a_module_that_is_nowhere\n")
    done = run()
    assert done.returncode != 0 and "a_module_that_is_nowhere" in done.stderr
