"""Versioned tables and the bar store: replace, upsert, readers, conflicts, files read, joins without exchange."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barwright.sources import sinks as SK
from barwright.sources.bars import BAR_SCHEMA, read_universe
from barwright.sources.store import BarStore
from barwright.sources.versioned import ConcurrentWrite, VersionedTable, hash_bucket


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, items):
    return spark.createDataFrame(items, "symbol string, n int")


def test_replace_is_whole_and_old_versions_stay_readable(spark, tmp_path):
    table = SK.report_table(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no version"):
        table.read()
    assert table.replace(frame(spark, [("A", 1), ("B", 2), ("B", 3)])) == 1
    reader = table.read()  # a reader that started before the next write
    assert table.replace(frame(spark, [("C", 9)])) == 2
    assert rows(reader) == [("A", 1), ("B", 2), ("B", 3)]
    assert rows(table.read()) == [("C", 9)] and rows(table.read(1)) == rows(reader)
    assert table.replace(frame(spark, [])) == 3 and table.read().count() == 0


def test_upsert_replaces_only_the_keys_at_hand(spark, tmp_path):
    table = SK.report_table(spark, str(tmp_path / "t"))
    table.upsert(frame(spark, [("A", 1), ("A", 2), ("B", 3), (None, 4), ("C", 5)]))
    before = set(table._manifest()["buckets"].items())
    table.upsert(frame(spark, [("A", 7), (None, 8), ("D", 6)]))
    assert sorted(map(repr, rows_any(table.read()))) == sorted(map(repr, [("A", 7), ("B", 3), (None, 8), ("C", 5), ("D", 6)]))
    kept = before & set(table._manifest()["buckets"].items())
    assert kept  # buckets without any of the keys are not written again


def rows_any(df):
    return [tuple(r) for r in df.collect()]


def test_an_unfinished_write_is_not_seen_and_a_second_writer_is_told(spark, tmp_path):
    table = SK.report_table(spark, str(tmp_path / "t"))
    table.replace(frame(spark, [("A", 1)]))
    table._write(frame(spark, [("A", 99)]))  # died before its version
    assert rows(table.read()) == [("A", 1)]
    stale = table._manifest()
    table.replace(frame(spark, [("A", 2)]))
    with pytest.raises(ConcurrentWrite):
        table._commit(stale | {"version": stale["version"] + 1})
    assert rows(table.read()) == [("A", 2)]
    assert table.vacuum(keep=1) >= 2
    assert rows(table.read()) == [("A", 2)] and table.versions() == [2]


def test_buckets_by_day_and_marks(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["symbol", "day"], "cast(day as string)")
    days = lambda *items: spark.createDataFrame([(s, dt.date(2024, 1, d), n) for s, d, n in items], "symbol string, day date, n int")
    table.upsert(days(("A", 1, 1), ("A", 2, 2), ("B", 2, 3)), {"stream": 0})
    table.upsert(days(("A", 2, 20)), {"stream": 1})
    assert rows(table.read().select("symbol", "n")) == [("A", 1), ("A", 20), ("B", 3)]
    assert table.marks() == {"stream": 1} and hash_bucket("x", 4) == "cast(pmod(xxhash64(x), 4) as string)"


@pytest.fixture(scope="module")
def bars(spark):
    out = []
    for symbol, years in (("OLD", [2001]), ("MID", [2001, 2002, 2003, 2004]), ("NEW", list(range(2001, 2011))), ("HOT", list(range(2005, 2011)))):
        out += [(symbol, dt.date(y, m, 1), 1.0, 1.0, 1.0, float(100 * (y - 2000) + m), 1.0) for y in years for m in range(1, 13)]
    return spark.createDataFrame(out, BAR_SCHEMA).repartition(3)


def test_newest_prices_read_the_newest_periods_first(spark, bars, tmp_path):
    store = BarStore(spark, str(tmp_path / "store"), 4).write(bars)
    asked = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    found, steps = store.latest_price(asked("NEW", "HOT", "NEW"))
    assert rows(found) == [("HOT", 1012.0, dt.date(2010, 12, 1)), ("NEW", 1012.0, dt.date(2010, 12, 1))] and steps == [["2010"]]
    files = [f for f in store.bars(["2010"]).inputFiles()]
    assert files and all("period=2010" in f for f in files)
    found, steps = store.latest_price(asked("MID", "NEW", "OLD", "NONE"))
    assert [r[:2] for r in rows(found)] == [("MID", 412.0), ("NEW", 1012.0), ("OLD", 112.0)]
    assert [len(s) for s in steps] == [1, 2, 4, 3]
    again = BarStore(spark, str(tmp_path / "store"), 4).open(bars.schema)
    assert rows(again.bars()) == rows(bars) and again.periods()[0] == "2010"
    assert store.latest_price(asked())[0].count() == 0


def test_stores_join_on_symbol_without_an_exchange(spark, bars, tmp_path):
    a, b = (BarStore(spark, str(tmp_path / n), 4).write(bars) for n in "ab")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.bars().alias("a").join(b.bars().alias("b"), "symbol").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert rows(joined) == [("HOT", 72**2), ("MID", 48**2), ("NEW", 120**2), ("OLD", 12**2)]


def test_universe_file(spark, tmp_path):
    (tmp_path / "lists.json").write_text('{"indices": ["X", "Y"], "metals": ["G"], "none": []}')
    assert rows(read_universe(spark, str(tmp_path / "lists.json"))) == [("indices", 0, "X"), ("indices", 1, "Y"), ("metals", 0, "G")]
