import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from tests.conftest import DATA

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    code = "import sys; sys.modules['lexiframe.llm'] = None\nfrom lexiframe.plans import registry\nassert registry.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for p in (ROOT / "lexiframe").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lexiframe.llm" not in p.read_text(), p


def test_stream(spark):
    q = entry.queries()
    got = q["stream_sentences"](spark, DATA).select("doc_id", "sentence")
    want = q["sentence_regex"](spark, DATA).select("doc_id", "sentence")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
