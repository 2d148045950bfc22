"""The driver's contract."""

import ast
import os
import subprocess
import sys

import __spark_entry__ as driver

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_gives_rows(spark):
    assert driver.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert driver.oracle_sql().keys() <= driver.queries().keys()


def test_nothing_else_imports_the_training_data_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "quern")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    for node in ast.walk(ast.parse(text.read())):
                        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                        assert not any(n.startswith("quern.llm") for n in names), f


def test_entry_imports_without_them():
    code = "import sys; sys.modules['corpus_pipeline'] = sys.modules['quern.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
