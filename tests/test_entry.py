"""The entry module without the training-data folders and the pipeline, in any combination."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def names(folder):
    """Query names that a copy of the library gives."""
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print('NAMES', *e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=folder, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr
    return set(said.stdout.split("NAMES", 1)[1].split())


@pytest.mark.parametrize("gone", [["gaugewright/llm"], ["corpus_pipeline.py"], ["gaugewright/llm", "corpus_pipeline.py", "tests/llm"]])
def test_import_without(tmp_path, gone):
    for name in ("gaugewright", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
        (tmp_path / name).unlink(missing_ok=True)
    found = names(tmp_path)
    assert "cbs_ranking" in found and "pipeline" not in found
    if "gaugewright/llm" in gone:
        assert not any(n.startswith("op") for n in found)


def test_a_broken_module_is_not_hidden(tmp_path):
    """An import error inside the pipeline or an operator is raised, not taken for a missing folder."""
    shutil.copytree(ROOT / "gaugewright", tmp_path / "gaugewright", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path / "__spark_entry__.py")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    with pytest.raises(AssertionError, match="no_such_module"):
        names(tmp_path)
