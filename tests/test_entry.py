"""The driver's contract, with and without the subpackage for training data."""

import ast
import pathlib
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "leadspark").rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n for n in names), p


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "leadspark", tmp_path / "leadspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 50, any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert out.stdout.split() == ["True", "False"], out.stderr[-500:]
