import importlib.util
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_text_operators():
    code = "import __spark_entry__ as e, sys; sys.meta_path.insert(0, type('B', (), {'find_spec': staticmethod(lambda n, p=None, t=None: (_ for _ in ()).throw(ImportError(n)) if n.startswith('gradeloom.llm') else None)})()); import gradeloom.evaluator, gradeloom.cli, gradeloom.streaming.incremental, gradeloom.sources.sinks, gradeloom.providers; assert not [m for m in sys.modules if m.startswith('gradeloom.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert importlib.util.find_spec("gradeloom") is not None
