"""The daily KPI by event time: late rows, splits into runs and micro-batches, empty Bronze."""

import datetime as dt

import pytest

from stratalake import schemas as S
from stratalake.sources import bronze as B
from stratalake.sources.publish import as_stored, read_table
from stratalake.streaming.daily import daily_kpi_stream, finished, set_aside_stream


def _row(event, at, arrived, status="pending", ref="R1", tenant="t"):
    day = dt.datetime(2024, 1, 1)
    said = None if at is None else day + dt.timedelta(hours=at)
    payload = '{"reference_id": %s%s}' % (f'"{ref}"' if ref else "null", f', "status": "{status}"' if status else "")
    return (tenant, event, "order", said, "erp", payload, day + dt.timedelta(hours=arrived), "f", f"b{arrived}")


# Days are open for one day. Day 1 ends at hour 24 and closes at 48.
ROWS = [
    _row("a", 1, 2), _row("b", 2, 3, ref="R2"), _row("c", 3, 4, ref=None), _row("d", 30, 31),
    _row("a", 1, 40, status="approved"), _row("c", 3, 41, status=None, ref=None),  # a status changes in time
    _row("b", 2, 49, status="approved", ref="R2"),  # a late status
    _row("e", 5, 48),  # a late event, on the very border
    _row("f", 60, 61), _row("g", None, 62), _row("h", 90, 63),  # no event time; arrived before it happened
    _row("i", 72, 73), _row("i", 72, 73), _row("j", 100, 101),
]
CLOSED = [
    ("t", dt.date(2024, 1, 1), "order", "approved", 1, 1, 1, 1),
    ("t", dt.date(2024, 1, 1), "order", "pending", 2, 1, 2, 3),
    ("t", dt.date(2024, 1, 2), "order", "pending", 1, 1, 30, 30),
    ("t", dt.date(2024, 1, 3), "order", "pending", 1, 1, 60, 60),
]
ASIDE = [("b", "late"), ("e", "late"), ("g", "untimed"), ("h", "ahead")]


def _bronze(spark, rows):
    return spark.createDataFrame(rows, as_stored(S.BRONZE_EVENTS))


def _hour(stamp):
    return int((stamp - dt.datetime(2024, 1, 1)).total_seconds() // 3600)


@pytest.mark.parametrize("cuts", [[], [35], [10, 45, 62, 80]])
def test_closed_days_do_not_depend_on_the_runs(spark, tmp_path, cuts):
    bronze, kpi, aside = (str(tmp_path / n) for n in ("bronze", "kpi", "aside"))
    arrivals = [r[6] for r in ROWS]
    borders = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in [*cuts, 999]]
    low = min(arrivals) - dt.timedelta(hours=1)
    for border in borders:
        part = [r for r in ROWS if low < r[6] <= border]
        B.append_bronze(_bronze(spark, part), bronze, str(border))
        finished(daily_kpi_stream(spark, bronze, kpi, str(tmp_path / "c1"), "1 day"))
        finished(set_aside_stream(spark, bronze, aside, str(tmp_path / "c2"), "1 day"))
        low = border
    found = [(*r[:6], _hour(r[6]), _hour(r[7])) for r in read_table(spark, kpi, S.DAILY_KPI).collect()]
    assert sorted(found) == CLOSED
    assert sorted((r.event_id, r.reason) for r in read_table(spark, aside, S.SET_ASIDE_EVENTS).collect()) == ASIDE


def test_files_out_of_order_are_told_or_waited_for(spark, tmp_path):
    """The newest rows come first; two days of disorder are enough to wait for the others."""
    bronze = str(tmp_path / "bronze")
    for name, rows in (("1", [_row("z", 96, 97)]), ("2", [_row("x", 97, 98)]), ("3", [_row("a", 20, 43)]), ("4", [_row("y", 300, 301)])):
        B.append_bronze(_bronze(spark, rows), bronze, name)
    with pytest.raises(RuntimeError, match="out of order"):
        finished(daily_kpi_stream(spark, bronze, str(tmp_path / "k1"), str(tmp_path / "c1"), "1 day", max_files=1))
    finished(daily_kpi_stream(spark, bronze, str(tmp_path / "k2"), str(tmp_path / "c2"), "1 day", max_files=1, disorder="54 hours"))
    assert {(r.event_date.day, r.event_count) for r in read_table(spark, str(tmp_path / "k2"), S.DAILY_KPI).collect()} == {(1, 1), (5, 2)}


def test_empty_bronze_closes_nothing(spark, tmp_path):
    bronze = str(tmp_path / "bronze")
    B.append_bronze(_bronze(spark, []), bronze, "1")
    finished(daily_kpi_stream(spark, bronze, str(tmp_path / "kpi"), str(tmp_path / "c")))
    assert read_table(spark, str(tmp_path / "kpi"), S.DAILY_KPI).count() == 0
