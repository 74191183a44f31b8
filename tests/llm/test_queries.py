import pytest

from noteglass.llm import queries

COLUMNS = {"p1_found": ["rec", "line_no"], "p3_found": ["src", "rec_id", "pos"], "p4_found": ["rec_a", "rec_b"], "p5_found": ["src", "rec_id", "defect"], "p6_ids": ["doc_id", "ids"]}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_on_the_small_tables(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert len(rows) > 0
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


def test_nothing_else_imports_this_package():
    import pathlib
    import re

    root = pathlib.Path(queries.__file__).parent.parent
    for f in root.rglob("*.py"):
        if f.parent.name != "llm":
            assert not re.search(r"^\s*(from|import) .*\bllm\b", f.read_text(), re.M), f
