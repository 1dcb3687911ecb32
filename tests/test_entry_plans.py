"""Driver contract and plan shapes."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from sievekit.sources.tables import TABLES, records


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["eppi_id", "position", "cumulative_relevant", "recall", "perc_of_total"]
    assert df.count() > 0


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    own = set(E.queries()) - set(E.LLM_QUERIES)
    missing = own - set(E.oracle_sql())
    assert missing <= {"priority_list"}


FAST = ["recall_curve_model", "stopping_runs_final", "sample_strata", "shuffle_order", "first_per_key_events",
        "filter_out_keeps_null", "anti_ids_null", "performance_by_model", "label_conflicts", "dedup_exact",
        "run_agreement_summary", "title_link", "bind_rows_fill", "paste_na", "criteria_screen", "report_blocks"]


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)

    def norm(cols, rows):
        idx = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in idx) for r in rows), key=repr)

    assert norm(sdf.columns, [tuple(r) for r in sdf.collect()]) == norm(dcols, res.fetchall())


@pytest.mark.parametrize("name", ["recall_curve_human", "stopping_runs_model", "title_link", "split_counts",
                                  "dedup_exact", "sample_strata", "semi_ids"])
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan or name in ("stopping_runs_model",)


def test_window_group_limit_in_strata(spark):
    from sievekit.operators.sampling import sample_strata

    r = records(spark, SF_SMALL)
    s = sample_strata(r, [("a", F.col("human_code") == 1, 5), ("b", F.col("human_code") == 0, 7)], 1)
    assert "WindowGroupLimit" in s._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in s._jdf.queryExecution().optimizedPlan().toString()


def test_filters_and_pruning_reach_scan(spark):
    r = records(spark, SF_SMALL).filter(F.col("eppi_id") < 50).select("eppi_id", "score")
    plan = _plan(r)
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,50)]" in plan
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]
