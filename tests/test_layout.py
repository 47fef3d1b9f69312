"""The optional part stays optional, and nothing else depends on it."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def sources():
    for folder, _, names in os.walk(os.path.join(ROOT, "factloom")):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for n in names:
                if n.endswith(".py"):
                    yield os.path.join(folder, n)


def test_nothing_imports_the_optional_part():
    for path in sources():
        text = open(path, encoding="utf-8").read()
        assert "llm" not in [w for line in text.splitlines() if line.lstrip().startswith(("import ", "from ")) for w in line.replace(".", " ").split()], path


@pytest.mark.parametrize("without", [("factloom/llm", "corpus_pipeline.py"), ("factloom/llm",), ("corpus_pipeline.py",)])
def test_entry_works_without_it(tmp_path, without):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for w in without:
        p = copy / w
        shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'owners_with_fallback' in q, any(n.startswith('op1_') for n in q), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1] == "True" and out[2] == "False" and int(out[3]) > 40
