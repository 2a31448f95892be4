import importlib.util
import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["request_id", "rank", "id", "display_name", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_llm_stands_alone():
    """Nothing outside the subpackage imports it, but for the guarded entry."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "wayfold")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, n)).read()
    assert importlib.util.find_spec("wayfold") is not None
