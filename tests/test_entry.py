import __spark_entry__ as entry_mod


def test_contract(spark):
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert len(q) > 120 and set(o) <= set(q)
    assert entry_mod.entry(spark).count() > 0
