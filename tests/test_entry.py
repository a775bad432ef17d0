import shutil
import subprocess
import sys

import __spark_entry__
from conftest import ROOT


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert set(df.columns) == {"model_key", "scope", "mean_delta", "n"} and df.count() == 15


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_engine_stands_without_the_training_data_operators(tmp_path):
    for name in ("ledgerlark", "__spark_entry__.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'paired_delta' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_engine_stands_without_a_library_of_theirs(tmp_path):
    """What can't be imported is left out and told, and the engine's own queries stay."""
    shutil.copytree(ROOT / "ledgerlark", tmp_path / "ledgerlark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "ledgerlark" / "llm").mkdir()
    (tmp_path / "ledgerlark" / "llm" / "registry.py").write_text("import no_such_module_at_all\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'paired_delta' in q and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0 and "no_such_module_at_all" in done.stderr


def test_other_errors_of_theirs_are_errors(tmp_path):
    shutil.copytree(ROOT / "ledgerlark", tmp_path / "ledgerlark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "ledgerlark" / "llm").mkdir()
    (tmp_path / "ledgerlark" / "llm" / "registry.py").write_text("1 / 0\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode and "ZeroDivisionError" in done.stderr


def test_nothing_else_imports_them():
    for path in (ROOT / "ledgerlark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "ledgerlark.llm" not in path.read_text()
