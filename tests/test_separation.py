"""The library stands without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q.startswith('op1') for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def copy(tmp_path, *left_out):
    skip = shutil.ignore_patterns(".git", "__pycache__", *left_out)
    return shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)


def test_imports_without_the_folders(tmp_path):
    count, pipeline, numbered = names(copy(tmp_path, "llm"))
    assert int(count) >= 199 and pipeline == "False" and numbered == "False"


def test_imports_without_folders_and_pipeline(tmp_path):
    count, pipeline, _ = names(copy(tmp_path, "llm", "corpus_pipeline.py"))
    assert int(count) >= 199 and pipeline == "False"


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "cliploom")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as text:
                    assert "cliploom.llm" not in text.read(), name
