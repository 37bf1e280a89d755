import pytest
from compare import spark_bag, sql_bag, views

from stemma.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf_dir, name):
    columns, rows = spark_bag(Q.QUERIES[name](spark, sf_dir))
    if name in Q.SQL:
        assert (columns, rows) == sql_bag(views(sf_dir), Q.SQL[name])
    assert len(set(columns)) == len(columns)


def test_nothing_else_imports_this():
    import pathlib

    root = pathlib.Path(Q.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "stemma.llm" not in p.read_text(), p
