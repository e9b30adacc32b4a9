"""Rules of the repository itself."""

import ast
import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_nothing_outside_imports_the_llm_subpackage():
    for path in (ROOT / "loomdex").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_no_local_checkpoint():
    assert not any("localCheckpoint(" in p.read_text() for p in (ROOT / "loomdex").rglob("*.py"))


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    """In a copy without both folders the entry points and every other test still import."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "*.md"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'p3_found' in q and 'p2_found' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "tests/llm/" not in done.stdout, done.stdout[-2000:]
