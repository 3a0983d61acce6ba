"""The entry with the training-data subpackage left out, in whole or in part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(sum(n.startswith('q_') for n in e.queries()), sum(not n.startswith('q_') for n in e.queries()), len(e.oracle_sql()) > 200)"


def counted(folder, code=COUNT):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


@pytest.mark.parametrize("left_out", ["nothing", "folder", "content", "library"])
def test_entry_without_parts(tmp_path, left_out):
    shutil.copytree(TOP / "trailmark", tmp_path / "trailmark", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    llm, pipeline = tmp_path / "trailmark/llm", TOP / "corpus_pipeline.py"
    there = pipeline.exists() and llm.exists()
    if there and left_out in ("nothing", "library"):
        shutil.copy(pipeline, tmp_path)
    elif llm.exists() and left_out != "nothing":
        shutil.rmtree(llm)
        if left_out == "content":
            (llm / "__pycache__").mkdir(parents=True)
    found = counted(tmp_path, "import sys; sys.modules['xxhash'] = None; " * (left_out == "library") + COUNT)
    assert int(found[0]) > 200 and found[2] == "True"
    assert (int(found[1]) > 0) == (there and left_out == "nothing")
