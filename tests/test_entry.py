"""The entry module without the llm folders' libraries."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(before: str) -> list[str]:
    code = f"import sys; {before}; import __spark_entry__ as e; print(*sorted(e.queries()))"
    return subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, check=True).stdout.split()


def test_other_queries_are_there_without_a_library_of_the_subpackage():
    own = [n for n in names("sys.modules['lintora.llm'] = None") if not n.startswith("op")]
    assert len(own) > 80 and "scan_all" in own and "pipeline" not in own
    assert [n for n in names("sys.modules['zstandard'] = None") if not n.startswith("op")] == own


def test_other_errors_are_not_hidden():
    code = "import sys, types; m = types.ModuleType('corpus_pipeline'); sys.modules['lintora.plans.registry'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True).returncode != 0
