"""Cleaning with quarantine: every row is kept or named, and the audit balances."""

from pyspark.sql import functions as F

from chargeweave.operators import cleaning, quarantine
from chargeweave.plans.jobs import clean_to_tables
from chargeweave.session import new_folder
from conftest import at

NAN = float("nan")


def faulty(readings, extra=()):
    rows = [
        ("S1", "C1", at(1), 5.0, 10.0, 2.0, None), ("S1", "C1", at(1), 5.0, 10.0, 2.0, None),
        ("S1", "C1", at(1), 7.0, 20.0, 1.0, 50.0), ("S1", "C2", at(2), -1.0, 10.0, 2.0, None),
        ("S1", "C3", at(2), NAN, 10.0, 2.0, None), ("S1", "C4", at(2), 0.0, 0.0, 2.0, None),
        ("S1", "C5", at(2), 3.0, 9.0, 0.0, None), ("S1", "C6", at(2), 3.0, 9.0, None, None),
        ("S1", "C7", at(2), 3.0, 9.0, 1e300, None), (None, "C1", at(1), 5.0, 10.0, 2.0, None),
        (None, "C1", at(1), 5.0, 10.0, 2.0, None), (None, "C1", at(1), 6.0, 10.0, 2.0, None),
        ("S1", "C8", None, 5.0, 10.0, None, None), *extra,
    ]
    return readings(rows).repartition(3)


def test_verdicts(readings):
    run = quarantine.clean_with_quarantine(faulty(readings), q=1.0)
    named = sorted((r.charger_id, r.verdict) for r in run.rejected.collect())
    assert named == [
        ("C1", "incomplete key"), ("C1", "incomplete key"), ("C2", "invalid"), ("C3", "invalid"), ("C4", "dead"),
        ("C5", "no session"), ("C6", "unknown count"), ("C7", "unknown count"), ("C8", "incomplete key"),
    ]
    kept = run.kept.collect()
    assert [(r.charger_id, r.avg_pwr_kw, r.active_session_count) for r in kept] == [("C1", 6.0, 1)]


def test_audit_balances(readings):
    many = [("S2", f"C{i}", at(i % 24, day=1 + i % 9), 1.0 + i % 50, 10.0 + i, 1.0, None) for i in range(120)]
    df = faulty(readings, many)
    run = quarantine.clean_with_quarantine(df, cap=40, q=0.9)
    audit = run.audit.collect()
    assert [r.step for r in audit] == list(range(1, 10)) and audit[0].rows_in == df.count()
    assert all(a.rows_left == b.rows_in for a, b in zip(audit, audit[1:]))
    assert all(r.rows_in - r.removed == r.rows_left for r in audit)
    resolved = audit[1].rows_left
    assert resolved == run.kept.count() + run.rejected.count() and audit[-1].rows_left == run.kept.count()
    names = {quarantine.VERDICTS[r.verdict]: r["count"] for r in run.rejected.groupBy("verdict").count().collect()}
    assert names == {r.name: r.removed for r in audit[2:] if r.removed} and names["station cap"] > 0


def test_kept_equals_clean(readings):
    many = [("S2", f"C{i % 7}", at(i % 24, day=1 + i % 9), 1.0 + i % 50, 10.0 + i, 1.5, None) for i in range(300)]
    df = faulty(readings, many)
    for cap in (25, None):
        run = quarantine.clean_with_quarantine(df, cap=cap, q=0.9)
        plain = cleaning.clean(df, cap=cap, q=0.9)
        assert run.kept.exceptAll(plain).count() == plain.exceptAll(run.kept).count() == 0
        assert (run.rejected.where("verdict = 'over the cap'").count() > 0) == (cap is not None)


def test_empty_and_all_rejected(readings):
    run = quarantine.clean_with_quarantine(faulty(readings).limit(0))
    assert run.kept.count() == run.rejected.count() == 0
    assert all(r.rows_in == 0 and r.removed_pct is None for r in run.audit.collect())
    none = faulty(readings).where("charging_station_id IS NULL")
    assert quarantine.clean_with_quarantine(none).rejected.count() == 2


def test_tables(spark, readings):
    folder = new_folder(spark, "cleaned_tables")
    run = clean_to_tables(faulty(readings), folder)
    assert run.rejected.where(F.col("verdict") == "dead").count() == 1
    assert spark.read.parquet(f"{folder}/audit").count() == 9
