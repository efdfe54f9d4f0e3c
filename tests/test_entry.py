import ast
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_needs_the_text_operators(tmp_path):
    for p in (ROOT / "voxelgrain").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), p
    import shutil

    shutil.copytree(ROOT / "voxelgrain", tmp_path / "voxelgrain", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'split_vi' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
