import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent

#: Imports the entry where a module of the optional part is missing, or breaks with an ImportError of its own.
WITHOUT = """
import sys
class Broken:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Broken())
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 50 and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
"""


def test_the_entry_works_without_the_optional_part():
    for name in ("tidemark.llm", "tidemark.llm.queries", "numpy.polynomial.none", "tidemark.llm.store"):
        code = WITHOUT.format(name=name)
        if name == "numpy.polynomial.none":
            code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
        subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
