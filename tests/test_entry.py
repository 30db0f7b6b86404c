"""The driver's entry: the plain queries are there whatever the training-data operators need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(blocked):
    code = f"""
import sys, warnings
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked!r} or name in {blocked!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
warnings.simplefilter("ignore")
import __spark_entry__ as entry
q = entry.queries()
assert set(entry.oracle_sql()) <= set(q)
print(len(q), sum(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in q))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), int(out[1])


def test_plain_queries_survive_what_is_missing():
    plain = names(["cairn.llm", "corpus_pipeline"])
    assert plain[1] == 0 and plain[0] > 100
    assert names(["zstandard"]) == plain
