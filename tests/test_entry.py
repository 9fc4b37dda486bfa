import __spark_entry__ as entry


def test_every_oracle_has_a_query_and_the_flagship_runs(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"action", "stage", "n", "score"}
