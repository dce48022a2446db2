"""The driver contract: entry, every query and every SQL twin name."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"tag", "prevalence"}


def test_every_query_has_sql_or_is_listed(spark):
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 40


def test_every_query_runs_on_smallest_scale(spark):
    for name, fn in E.queries().items():
        df = fn(spark, "/root/testdata/sf0.001")
        df.write.format("noop").mode("overwrite").save()
