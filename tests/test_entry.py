"""The entry without the training-data subpackage, or without a package that it needs."""

import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parent.parent
CODE = """
import sys, warnings
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {hidden!r} or name == {hidden!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
warnings.simplefilter("ignore")
import __spark_entry__ as e
names = set(e.queries())
print(len(names), any(n.startswith("op1_") for n in names), "pipeline" in names, set(e.oracle_sql()) <= names)
"""


def left(hidden):
    said = subprocess.run([sys.executable, "-B", "-c", CODE.format(hidden=hidden)], cwd=TOP, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    return said.stdout.split()


def test_other_queries_survive():
    from tessera.plans import registry

    for hidden in ("tessera.llm", "zstandard", "xxhash"):
        assert left(hidden) == [str(len(registry.QUERIES)), "False", "False", "True"]
