import pytest
from oracle import connection, spark_rows, sql_rows

from ledgerlark import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert spark_rows(catalogue.QUERIES[name](spark, sf_dir)) == sql_rows(con, catalogue.ORACLE_SQL[name])


def test_exact_bootstrap_is_repeatable_and_ordered(spark, sf_dir):
    first = {(r["model_key"], r["scope"]): r for r in catalogue.QUERIES["paired_bootstrap_exact"](spark, sf_dir).collect()}
    again = {(r["model_key"], r["scope"]): r for r in catalogue.QUERIES["paired_bootstrap_exact"](spark, sf_dir).collect()}
    assert first == again and len(first) == 15
    assert all(r["ci_low"] <= r["mean_delta"] <= r["ci_high"] for r in first.values())


def test_registered_bootstraps_take_all_replicates(spark, sf_dir):
    rows = catalogue.QUERIES["paired_bootstrap_portable"](spark, sf_dir).collect()
    assert len(rows) == 15 and {r["replicates"] for r in rows} == {2_000}
    ends = {(r["model_key"], r["scope"]): r for r in rows}
    for r in catalogue.QUERIES["delta_error_bars"](spark, sf_dir).collect():
        end = ends[r["model_key"], r["scope"]]
        assert r["mean_delta"] - r["below"] == pytest.approx(end["ci_low"], abs=1e-8) and r["mean_delta"] + r["above"] == pytest.approx(end["ci_high"], abs=1e-8)


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("paired_delta", "first_n_valid", "epoch_cycle_specs"):
            rows = []
            for n in ("1", "7"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                rows.append(spark_rows(catalogue.QUERIES[name](spark, sf_dir)))
            assert rows[0] == rows[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["paired_delta"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema", 1)[1].split(">")[0]
    plan = catalogue.QUERIES["first_n_valid"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n_chars,200)" in plan and "WindowGroupLimit" in plan
