"""The entry file in copies of the repository without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("pipeline_file", [True, False])
@pytest.mark.parametrize("empty_folder", [True, False])
def test_import_without_the_subpackage(tmp_path, pipeline_file, empty_folder):
    shutil.copytree(os.path.join(ROOT, "standscan"), tmp_path / "standscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if pipeline_file:
        (tmp_path / "corpus_pipeline.py").write_text("from standscan.llm import bpe  # noqa: F401\n")
    if empty_folder:
        (tmp_path / "standscan" / "llm" / "__pycache__").mkdir(parents=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    core, numbered, pipeline = done.stdout.split()
    assert int(core) >= 47 and numbered == "0" and pipeline == "False"


def test_errors_inside_the_subpackage_are_not_hidden(tmp_path):
    shutil.copytree(os.path.join(ROOT, "standscan"), tmp_path / "standscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "standscan" / "llm").mkdir()
    (tmp_path / "standscan" / "llm" / "__init__.py").write_text("")
    (tmp_path / "standscan" / "llm" / "queries.py").write_text("import no_such_module\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode != 0 and "no_such_module" in done.stderr
