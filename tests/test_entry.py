"""The entry point serves the library's queries whether or not the corpus operators can be imported."""

import subprocess
import sys

import pytest

PROBE = """
import sys
for name in {blocked!r}:
    sys.modules[name] = None
import __spark_entry__ as E
names = E.queries()
assert "star_lookup" in names and set(E.oracle_sql()) <= set(names)
print(sum(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names)
"""


@pytest.mark.parametrize("blocked", [["skyledger.llm"], ["skyledger.llm.catalog", "corpus_pipeline"], ["ahocorasick"], ["numpy"]])
def test_entry_without_the_corpus_operators_or_what_they_need(blocked):
    if blocked == ["numpy"]:
        pytest.importorskip("numpy")
    out = subprocess.run([sys.executable, "-c", PROBE.format(blocked=blocked)], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == ["0", "False"]
