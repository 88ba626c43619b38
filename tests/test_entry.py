from conftest import SF001


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and set(df.columns) >= {"CityTier", "return_rate", "n"}


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracle_subset_at_smallest_scale(spark):
    """Spark vs DuckDB on a sample of queries at sf0.001 (the full set runs in
    tests/oracle_check.py and in the driver's gate)."""
    import oracle_check as OC
    import __spark_entry__ as E
    names = ["clean_orders", "rate_by_value_quartile", "chi_square", "win_prior_history",
             "top_low_mid_high", "rules_cube", "metric_auc", "policy_sweep", "clean_audit"]
    con = OC.duck(SF001)
    for name in names:
        sdf = E.queries()[name](spark, SF001)
        srows = [tuple(r) for r in sdf.collect()]
        res = con.execute(E.oracle_sql()[name])
        orows = res.fetchall()
        ocols = [d[0] for d in res.description]
        assert sorted(sdf.columns) == sorted(ocols), name
        assert OC.digest(sdf.columns, srows)[0] == OC.digest(ocols, orows)[0], name
