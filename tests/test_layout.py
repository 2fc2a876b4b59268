"""The corpus subpackage is optional: nothing outside it imports it."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_corpus_subpackage():
    for p in (ROOT / "querent").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"querent[. ]+(import )?llm|corpus_pipeline", p.read_text()), p


def test_the_entry_module_works_without_it(tmp_path):
    shutil.copytree(ROOT / "querent", tmp_path / "querent", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and not [n for n in q if n.startswith('op')]"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
