"""The composed weekly load and its publication: bad cells, counters, several rows of one concept, stops between steps."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from weekcraft.operators import publish as P
from weekcraft.plans import history as H
from weekcraft.plans import report as R
from weekcraft.plans import weekly_load as WL

HEADERS = ["empresa", "empresa_cod", "establecimiento", "categoria", "concepto", "a_total", "1-1-2024", "2-1-2024", "31-02-2024"]
ROWS = [
    ("Uno", "11_Uno", "Fundo Alfa", "x", "(A) Vacas en ordeña", "10", "8", "12", None),
    ("Uno", "11_Uno", "Alfa", "x", "(A) Vacas en ordeña", None, "30", "40", "7"),           # a second row of the concept, without a total
    ("Uno", "11_Uno", "Alfa", "x", "(B) Producción promedio", "1e30", "1.234,5", "1e30", ""),  # numbers out of range
    ("Uno", "11_Uno", "Alfa", "x", "(C) ", "1", "1", "2", "3"),                               # no concept
    ("Dos", "22_Dos", " Beta ", "y", "(D) Superficie total", "n/d", "n/d", "5", None),
    ("Dos", None, "Beta", "y", "(D) Superficie total", "4", "5", "5", None),                  # no company
    ("Dos", "22_Dos", None, "y", "(D) Superficie total", "4", "5", "5", None),                # no site
]
COMPANIES = "company_id long, code string, name string"
SITES = "site_id long, company_id long, name string"


def report(spark, rows=ROWS, headers=HEADERS):
    schema = ", ".join(f"`{h}` string" for h in headers) + ", row_no long"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


@pytest.fixture()
def dims(spark):
    return spark.createDataFrame([(5, "11", "Uno SA")], COMPANIES), spark.createDataFrame([(70, 5, "Alfa")], SITES)


def day(n):
    return dt.date(2024, 1, n)


def test_load_of_a_report_with_every_kind_of_bad_cell(spark, dims):
    load = WL.process_weekly(WL.cells_of([report(spark)]), *dims)
    assert sorted(map(tuple, load.companies.collect())) == [(5, "11", "Uno SA"), (6, "22", "Empresa 22")]
    assert sorted(map(tuple, load.sites.collect())) == [(70, 5, "Alfa"), (71, 6, "Beta")]
    got = {(r["site_id"], r["day"], r["concept"]): r["value"] for r in load.daily.collect()}
    # The later row of the concept is written over the earlier one.
    assert got == {(70, day(1), "Vacas en ordeña"): 30.0, (70, day(2), "Vacas en ordeña"): 40.0, (70, day(1), "Producción promedio"): 1234.5, (71, day(2), "Superficie total"): 5.0}
    weekly = {r["site_id"]: r for r in load.weekly.collect()}
    # Mean of the rows' totals where there is one; the row without a total does not count then.
    assert weekly[70]["weight"] == 10.0 and weekly[70]["prod"] == 1234.5 and weekly[71]["area"] == 5.0
    assert (weekly[70]["year"], weekly[70]["week"], weekly[70]["period_start"], weekly[70]["period_end"]) == (2024, 1, day(1), day(2))
    reasons = sorted((r["report_row"], r["reason"]) for r in load.rejects.collect())
    assert reasons == sorted([("0:0", "null value"), ("0:1", "unparseable date"), ("0:2", "number out of range"), ("0:2", "null value"), ("0:2", "row total out of range")]
                             + [("0:3", "empty concept")] * 3 + [("0:4", "unparseable value"), ("0:4", "null value")]
                             + [("0:5", "empty company")] * 3 + [("0:6", "empty site")] * 3)


def test_counters_equal_a_recount(spark, dims):
    load = WL.process_weekly(WL.cells_of([report(spark), report(spark, ROWS[:2])]), *dims)
    s = load.stats.first().asDict()
    tagged = R.parse_cells(WL.cells_of([report(spark), report(spark, ROWS[:2])])).withColumn("reason", WL.load_reason()).collect()
    assert s["cells"] == len(tagged) == 27 and s["daily_rows"] == sum(r["reason"] is None for r in tagged)
    assert s["rejected_cells"] == load.rejects.filter(F.col("day_text").isNotNull()).count()
    assert s["rows"] == 9 and s["omitted_rows"] == len({r["report_row"] for r in tagged if r["reason"]})
    assert (s["companies_created"], s["sites_created"], s["unique_weeks"], s["unique_sites"]) == (1, 1, 1, 2)
    assert s["weekly_rows"] == load.weekly.count()


def test_stored_facts_keep_what_a_load_does_not_bring(spark, dims):
    daily = spark.createDataFrame([(70, day(1), "Vacas en ordeña", 5, "old", 1.0), (70, day(9), "Vacas en ordeña", 5, "old", 2.0)], WL.DAILY_SCHEMA)
    measures = dict.fromkeys(WL.MEASURES) | {"area": 3.0, "weight": 1.0}
    weekly = spark.createDataFrame([(70, 2024, 1, 5, day(3), day(4), *measures.values()), (70, 2023, 52, 5, None, None, *measures.values())], WL.WEEKLY_SCHEMA)
    load = WL.process_weekly(WL.cells_of([report(spark)]), *dims, daily, weekly)
    got = {(r["site_id"], r["day"], r["concept"]): (r["category"], r["value"]) for r in load.daily.collect()}
    assert got[70, day(1), "Vacas en ordeña"] == ("old", 30.0) and got[70, day(9), "Vacas en ordeña"] == ("old", 2.0)
    rows = {(r["year"], r["week"]): r for r in load.weekly.filter("site_id = 70").collect()}
    assert (rows[2024, 1]["area"], rows[2024, 1]["weight"], rows[2024, 1]["period_start"]) == (3.0, 10.0, day(1))
    assert rows[2023, 52]["weight"] == 1.0


def test_a_report_without_its_columns_is_refused(spark):
    with pytest.raises(ValueError, match="establecimiento"):
        WL.cells_of([report(spark).drop("establecimiento")])
    with pytest.raises(ValueError, match="empty"):
        WL.cells_of([report(spark, [])])


def test_totals_and_counts_are_per_report_row(spark):
    """RSH-5 and QLT-6: two rows of one concept have their own totals and count as two."""
    cells = WL.cells_of([report(spark, [("Uno", "11", "Alfa", "x", "(A) Vacas en ordeña", None, "4", "6", None), ("Uno", "11", "Alfa", "x", "(A) Vacas en ordeña", None, "20", None, None)])])
    tagged = R.parse_cells(cells).withColumn("reason", R.reject_reason())
    assert sorted((r["value"], r["row_total"]) for r in R.melt_report(tagged).collect()) == [(4.0, 10.0), (6.0, 10.0), (20.0, 20.0)]
    stats = R.load_stats(tagged, spark.createDataFrame([], "name string")).first()
    assert stats["rows"] == 2 and stats["omitted_rows"] == 2


def test_large_weeks_and_values_of_a_history_are_rejected(spark):
    rows = spark.createDataFrame([(0, "5", "Alfa", "1"), (1, "99999999999", "Alfa", "1"), (2, "5", "Beta", "1e30"), (3, "x", "", "1"), (4, "1e40", "Alfa", "2")],
                                 "row_no long, `N° Semana` string, Establecimiento string, `(I) MDAT` string")
    assert [(r["week"], r["site"]) for r in H.load_history(rows).collect()] == [(5, "Alfa")]
    got = {r["row_no"]: r["reason"] for r in H.history_rejects(H.parse_history(rows)).collect()}
    assert got == {1: H.REASON_WEEK_RANGE, 2: H.REASON_VALUE_RANGE, 3: f"{H.REASON_NO_WEEK} | {H.REASON_NO_SITE}", 4: H.REASON_NO_WEEK}


# --- publication ---------------------------------------------------------------------------

def stored(spark, store):
    return ({(r["site_id"], r["day"], r["concept"]): r["value"] for r in P.read_published(spark, store, "daily", WL.DAILY_SCHEMA).collect()},
            {(r["site_id"], r["week"]): r["weight"] for r in P.read_published(spark, store, "weekly", WL.WEEKLY_SCHEMA).collect()},
            P.read_published(spark, store, "rejects", WL.REJECTS_SCHEMA).count())


def test_a_load_that_stops_leaves_the_store_as_it_was(spark, dims, monkeypatch):
    store = tempfile.mkdtemp(prefix="weekcraft-store-")
    assert stored(spark, store) == ({}, {}, 0)
    WL.commit_load(spark, store, [report(spark)], *dims, load="a")
    before = stored(spark, store)
    assert before[0][70, day(1), "Vacas en ordeña"] == 30.0 and before[2] > 0
    later = [("Uno", "11_Uno", "Alfa", "x", "(A) Vacas en ordeña", "9", "99", None, None)]
    commit = P._commit
    for stop in ("daily", "rejects", "commit"):
        def fail(*args, **kw):
            raise RuntimeError("stopped")
        with monkeypatch.context() as m:
            if stop == "commit":
                m.setattr(P, "_commit", fail)
            else:
                real = P._partitions
                m.setattr(P, "_partitions", lambda s, folder, real=real, stop=stop: fail() if folder.endswith(stop) else real(s, folder))
            with pytest.raises(RuntimeError):
                WL.commit_load(spark, store, [report(spark, later)], *dims, load="b")
        assert stored(spark, store) == before
    assert P._commit is commit
    for _ in range(2):  # the load again, and once more
        WL.commit_load(spark, store, [report(spark, later)], *dims, load="b")
        after = stored(spark, store)
        assert after[0] == before[0] | {(70, day(1), "Vacas en ordeña"): 99.0}
        assert after[1] == before[1] | {(70, 1): 9.0}
        assert after[2] == before[2] + 2  # the rejects of both loads stay, each once
    assert P.remove_unused(spark, store) and stored(spark, store) == after


def test_partitions_that_a_load_does_not_touch_keep_their_files(spark):
    store = tempfile.mkdtemp(prefix="weekcraft-store-")
    rows = spark.createDataFrame([(1, "a/b=c"), (2, "x"), (3, None)], "v int, part string")
    P.publish(spark, store, {"t": (rows, "part")})
    first = P.read_manifest(spark, store)["t"]
    P.publish(spark, store, {"t": (rows.filter("part = 'x'").withColumn("v", F.lit(20)), "part")}, emptied={"t": [None]})
    second = P.read_manifest(spark, store)["t"]
    assert second["a/b=c"] == first["a/b=c"] and second["x"] != first["x"] and P.NULL not in second
    read = lambda **kw: sorted(map(tuple, P.read_published(spark, store, "t", rows.schema, **kw).collect()))
    assert read() == [(1, "a/b=c"), (20, "x")]
    assert read(only=["x"]) == [(20, "x")] and read(only=["nothing"]) == []
