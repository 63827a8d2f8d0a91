import __spark_entry__ as entry


def test_names_match():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 60


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 200


def test_core_does_not_need_llm():
    import ast
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "hanweave"
    for path in root.rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_core_runs_without_llm(tmp_path):
    """A copy without the training-data folders, and one whose training-data modules can't be imported."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(entry.__file__).parent
    show = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql; print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    for name in ("gone", "broken"):
        copy = tmp_path / name
        shutil.copytree(root / "hanweave", copy / "hanweave", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if name == "gone" else [])))
        shutil.copy(root / "__spark_entry__.py", copy)
        if name == "broken" and (copy / "hanweave" / "llm").exists():
            (copy / "hanweave" / "llm" / "queries.py").write_text("import a_module_that_is_missing\n")
            shutil.copy(root / "corpus_pipeline.py", copy)
        done = subprocess.run([sys.executable, "-W", "ignore", "-c", show], cwd=copy, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        n, ops, pipeline = done.stdout.split()
        assert int(n) > 60 and (ops, pipeline) == ("False", "False")
