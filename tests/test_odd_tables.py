"""Queries on copies of the tables that are odd in one place, held against their SQL."""

import duckdb
import pytest
from test_oracles import TABLES, rows

from tallyspark.operators import choice, posthoc, split
from tallyspark.plans import registry
from tallyspark.sources.binding import purchases
from tallyspark.sources.shared import FREED, stored


@pytest.fixture()
def odd(spark, sf, tmp_path):
    """Makes a copy of the tables with some selected anew, and holds a query on it against its SQL."""

    def check(name, **selects):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        for t in TABLES:
            con.execute(f"COPY ({selects.get(t, f'SELECT * FROM {t}')}) TO '{tmp_path}/{t}.parquet'")
        for t in TABLES:
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        want = con.execute(registry.oracle_sql()[name]).fetchdf()
        got = registry.queries()[name](spark, str(tmp_path)).toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert rows(got, columns) == rows(want, columns)
        return got

    return check


def test_person_kinds_leave_out_balances_that_say_none(odd):
    changed = "CASE c_custkey WHEN 3 THEN -1.0 WHEN 5 THEN NULL ELSE c_acctbal END AS c_acctbal"
    got = odd("k1_k9_person_kinds", customer=f"SELECT * REPLACE ({changed}) FROM customer")
    assert {"3", "5"} & set(got["customer_id"]) == set() and "4" in set(got["customer_id"])


def test_broken_tables_take_a_customer_of_one_row(odd):
    one = "(SELECT l_orderkey, min(l_linenumber * 1000000 + l_partkey) AS first FROM lineitem GROUP BY 1 HAVING l_orderkey = (SELECT min(l_orderkey) FROM lineitem))"
    got = odd(
        "v1_v13_broken_tables",
        customer="SELECT * FROM customer UNION ALL SELECT * REPLACE (900001 AS c_custkey) FROM customer WHERE c_custkey = 1",
        orders="SELECT * FROM orders UNION ALL SELECT * REPLACE (900001 AS o_orderkey, 900001 AS o_custkey) FROM orders WHERE o_orderkey = (SELECT min(l_orderkey) FROM lineitem)",
        lineitem=f"SELECT * FROM lineitem UNION ALL SELECT lineitem.* REPLACE (900001 AS l_orderkey) FROM lineitem JOIN {one} AS o ON lineitem.l_orderkey = o.l_orderkey AND l_linenumber * 1000000 + l_partkey = first",
    )
    assert got["passes"].all() and got["raises"].all()


def _shuffled(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        name = files.next().getName()
        if name.startswith("shuffle_") and name.endswith(".data"):
            found.add(name)
    return found


def test_stored_rows_leave_no_shuffle_files(spark):
    before = _shuffled(spark)
    rows_ = stored(spark.range(1000).repartition(3, "id"), "freed")
    assert not _shuffled(spark) - before
    assert rows_.count() == 1000
    assert spark.conf.get(FREED, "false") == "false"


def test_first_draws_are_few_and_carry_no_key(spark, sf, monkeypatch):
    drawn, seen = choice.drawn, []
    monkeypatch.setattr(choice, "drawn", lambda points, laid, key=None: (seen.append(points), drawn(points, laid, key))[1])
    s = split.temporal_split(purchases(spark, sf))
    n = s.count()
    assert choice.choice_sets(s, distinct=False).count() == n
    assert seen[0].count() + seen[1].count() <= 11 * n
    assert all(set(p.columns) <= {"event", "category", "d", "at", "width"} for p in seen)


def test_bootstrap_draws_equal_differences_together(spark, monkeypatch):
    """Without any row by itself no row's own numbers are drawn, and the interval is that of a mean of all rows."""
    seen = []
    count = type(spark.range(1)).mapInPandas
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda self, *a, **k: (seen.append(self.count()), count(self, *a, **k))[1])
    pairs = spark.range(4000).selectExpr("'m' AS model", "0 AS seed", "id AS event_idx", "CAST(id % 4 AS DOUBLE) AS nll", "CAST(0 AS DOUBLE) AS nll_a")
    got = posthoc.bootstrap(pairs, 400).first()
    width = 2 * 1.96 * (1.25 / 4000) ** 0.5
    assert seen == [4]  # a row a difference, not 4,000
    assert abs(got["delta_mean"] - 1.5) < 0.01 and abs((got["delta_hi"] - got["delta_lo"]) / width - 1) < 0.2


@pytest.mark.parametrize("name", ["j5_p17_p19_records", "r1_p17_p19_choice_records", "r10_simulated_purchases", "j14_legacy_lookups", "m8_few_shot_prompts"])
def test_purchases_are_not_made_anew_under_every_branch(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "l_orderkey#" in line for line in plan.splitlines()) <= 1
