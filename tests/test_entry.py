"""The driver's entry without a session, and without the training-data folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def shown(where: str) -> list[str]:
    run = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=where, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def test_names_need_no_session():
    from tidefold.plans import catalog

    assert int(shown(ROOT)[0]) >= len(catalog.QUERIES)


def test_the_rest_stands_alone(tmp_path):
    for name in ("__spark_entry__.py", "tidefold"):
        src = os.path.join(ROOT, name)
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    assert shown(str(tmp_path))[1:] == ["0", "False"]
