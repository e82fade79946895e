"""Every query with SQL gives the SQL's rows; the others run and give rows."""

import pytest

from lodestone.plans import citations, features, mining, records

MODULES = (citations, mining, records, features)


@pytest.mark.parametrize(("module", "name"), [(m, n) for m in MODULES for n in m.SQL], ids=lambda x: x if isinstance(x, str) else "")
def test_same_rows(spark, same_rows, module, name):
    same_rows(spark, module.QUERIES[name], module.SQL[name])


@pytest.mark.parametrize(("module", "name"), [(m, n) for m in MODULES for n in m.QUERIES if n not in m.SQL], ids=lambda x: x if isinstance(x, str) else "")
def test_runs(spark, module, name):
    assert module.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["row_id", "article_id", "dataset_id", "type"]
    assert set(e.oracle_sql()) <= set(e.queries())
