"""The registry, with and without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry_works_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "chartloom", tmp_path / "chartloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_entry_goes_on_where_llm_cannot_be_imported(tmp_path):
    """An emptied folder, a module that lacks another one, and a pipeline without its operators leave the other queries alone."""
    shutil.copytree(ROOT / "chartloom", tmp_path / "chartloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    llm = tmp_path / "chartloom" / "llm"
    (llm / "__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    (llm / "__init__.py").write_text("")
    (llm / "queries.py").write_text("import no_such_module\n")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_llm():
    for p in (ROOT / "chartloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "chartloom.llm" not in p.read_text()


def test_oracles_have_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "chart_id"
