"""The entry module without the corpus operators."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def names(folder, *gone) -> list[str]:
    shutil.copytree(REPO, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for x in gone:
        path = folder / x
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return json.loads(out.stdout)


def test_core_queries_load_without_the_corpus_operators(tmp_path):
    from fieldglass import registry

    core = [sorted(registry.queries()), sorted(registry.oracles())]
    assert names(tmp_path / "folders", "fieldglass/llm", "tests/llm") == core
    assert names(tmp_path / "all", "fieldglass/llm", "tests/llm", "corpus_pipeline.py") == core
