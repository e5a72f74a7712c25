"""The rest of the library does not need the subpackage llm or what only that needs."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith(('p4_', 'p6_', 'p7_', 'p8_')) for n in q))"


def counted(folder, before=""):
    out = subprocess.run([sys.executable, "-c", before + COUNT], cwd=folder, capture_output=True, text=True, check=True)
    return [int(x) for x in out.stdout.split()]


def test_entry_without_the_folders_and_without_their_dependencies(tmp_path):
    shutil.copytree(os.path.join(ROOT, "pathlume"), tmp_path / "pathlume", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    core, llm = counted(tmp_path)
    assert core > 60 and llm == 0
    assert counted(ROOT, "import sys; sys.modules['ahocorasick'] = None; ") == [core, 0]
