"""List properties on the driver tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from sievekit.operators import order as O
from sievekit.sources.tables import records


def test_recall_monotone_and_ends_at_100(spark):
    curve = O.recall_curve(records(spark, SF_SMALL), "human_code", rows_per_bucket=37)
    rows = curve.orderBy("position").select("position", "recall", "cumulative_relevant").collect()
    rec = [r["recall"] for r in rows]
    assert all(a <= b for a, b in zip(rec, rec[1:]))
    assert abs(rec[-1] - 100.0) < 1e-9
    assert [r["position"] for r in rows] == list(range(1, len(rows) + 1))


def test_runs_and_breaks_cover_list(spark):
    r = records(spark, SF_SMALL)
    runs = O.stopping_runs(r, "included_full", rows_per_bucket=37).collect()
    ranked = O.rank_list(r, rows_per_bucket=37)
    n = ranked.count()
    breaks = {row[0] for row in ranked.filter(~F.coalesce(F.col("included_full") == 0, F.lit(False)))
              .select("position").collect()}
    covered = set(breaks)
    for run in runs:
        span = set(range(run["start_row"], run["end_row"] + 1))
        assert len(span) == run["run_length"] and not (span & covered)
        covered |= span
    assert covered == set(range(1, n + 1))
    # sorted by length (desc), run ids alternate parity
    lengths = [x["run_length"] for x in runs]
    assert lengths == sorted(lengths, reverse=True)
    assert len({x["run_id"] % 2 for x in runs}) == 1


def test_rerank_a_ranked_list(spark):
    ranked = O.rank_list(records(spark, SF_SMALL), rows_per_bucket=37)
    curve = O.recall_curve(ranked, "human_code", rows_per_bucket=50)
    a = {r["eppi_id"]: r["position"] for r in ranked.select("eppi_id", "position").collect()}
    b = {r["eppi_id"]: r["position"] for r in curve.select("eppi_id", "position").collect()}
    assert a == b and "n_rows" in curve.columns
