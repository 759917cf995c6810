import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from barloom.operators import cleaning
from barloom.operators.reports import ticker_overview, title_case
from barloom.sources import bar_files, watchlist
from barloom.sources.ticks import bars_from_ticks, packed_order

from helpers import BARS, bars_frame, walk

HEADER = "date,Open,High,Low,Close,Volume,Dividends,Stock Splits\n"


@pytest.fixture()
def folder(tmp_path):
    def write(name, lines):
        (tmp_path / name).write_text(HEADER + "\n".join(lines) + "\n")

    write("BRK-B-2020-03-01-2020-03-31.csv", [
        "2020-03-06 00:00:00-05:00,10,11,9,10.5,1000,0.0,0.0",
        "2020-03-09 00:00:00-04:00,10.5,12,10,n/a,2000,0.0,0.0",
        "2020-03-10 00:00:00-04:00,11,12,10,NaN,,0.0,0.0",
        "2020-03-11 00:00:00-04:00,11,,10,11.5,1500,0.0,0.0",
    ])
    write("XY-2020-01-01-2020-02-01.csv", ["2020-01-02 00:00:00-05:00,1,1,1,1,1,0.0,0.0"])
    write("XY-2020-01-01-2020-03-01.csv", ["2020-01-02 00:00:00-05:00,2,2,2,2,2,0.0,0.0"])
    write("notes.csv", ["2020-01-02 00:00:00-05:00,3,3,3,3,3,0.0,0.0"])
    return str(tmp_path)


def test_csv_files(spark, folder):
    bars = bar_files.read_bars_csv(spark, folder)
    assert {r["ticker"] for r in bars.select("ticker").collect()} == {"BRK-B", "XY", "UNKNOWN"}
    brk = bars.filter("ticker = 'BRK-B'").orderBy("date").collect()
    # Midnight in New York, before and after the clock change.
    assert [r["date"].day for r in brk] == [6, 9, 10, 11]
    assert [r["Close"] for r in brk] == [10.5, None, None, 11.5]
    assert brk[3]["High"] is None
    assert cleaning.clean_bars(bars).filter("ticker = 'BRK-B'").count() == 2


def test_instants_are_kept_for_intraday_bars(spark, folder):
    bars = bar_files.read_bars_csv(spark, f"{folder}/BRK*", intraday=True)
    first = bars.agg(F.min("date").cast("string")).first()[0]
    assert first == "2020-03-06 05:00:00"


def test_latest_file_per_ticker(spark, folder):
    bars = bar_files.latest_files(bar_files.read_bars_csv(spark, folder))
    assert [r["Close"] for r in bars.filter("ticker = 'XY'").collect()] == [2.0]
    names = [p.rsplit("/", 1)[1] for p in bar_files.newest_paths(spark, folder)]
    assert names == ["BRK-B-2020-03-01-2020-03-31.csv", "XY-2020-01-01-2020-03-01.csv"]


def test_ticker_column_wins(spark, tmp_path):
    (tmp_path / "all.csv").write_text("ticker," + HEADER + "ZZ,2020-01-02,1,1,1,1,1,0,0\n")
    bars = bar_files.read_bars_csv(spark, str(tmp_path))
    assert bars.first()["ticker"] == "ZZ" and bars.first()["date"] == dt.date(2020, 1, 2)


def write(folder, name, text):
    (folder / name).write_text(text)


def test_columns_go_by_their_names(spark, tmp_path):
    write(tmp_path, "A-2020-01-01-2020-02-01.csv", "Date,Close,Open,High,Low,Volume\n2020-01-02,10,1,12,0.5,7\n")
    write(tmp_path, "B-2020-01-01-2020-02-01.csv", "Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-02,1,12,0.5,10,9.9,7\n")
    write(tmp_path, "C-2020-01-01-2020-02-01.csv", "TICKER, date ,open,HIGH,Low,close,volume,x\nZZ,2020-01-02,1,12,0.5,10,7,8\n")
    rows = bar_files.read_bars_csv(spark, str(tmp_path)).drop("file_name").collect()
    assert {r["ticker"] for r in rows} == {"A", "B", "ZZ"}
    assert {tuple(r)[1:] for r in rows} == {(dt.date(2020, 1, 2), 1.0, 12.0, 0.5, 10.0, 7.0)}


@pytest.mark.parametrize(
    "text, problem",
    [
        ("Date,Open,High,Low,Close\n2020-01-02,1,1,1,1\n", "no column volume"),
        ("2020-01-02,1,1,1,1,1\n", "no header"),
        ("Date,Open,High,Low,Close,Volume\n2020-01-02,1,1,1,1,1\nDate,Close,High,Low,Open,Volume\n", "headers that differ"),
    ],
)
def test_files_without_the_columns_are_refused(spark, tmp_path, text, problem):
    write(tmp_path, "A-2020-01-01-2020-02-01.csv", HEADER + "2020-01-02,1,1,1,1,1,0,0\n")
    write(tmp_path, "B-2020-01-01-2020-02-01.csv", text)
    with pytest.raises(Exception, match=f"B-2020-01-01-2020-02-01.csv has {problem}"):
        bar_files.read_bars_csv(spark, str(tmp_path)).collect()


def test_layouts_are_read_from_first_lines(spark, tmp_path):
    wide = [f"x{i}" for i in range(200)]
    write(tmp_path, "A-2020-01-01-2020-02-01.csv", ",".join([*wide, "Date", '"Open"', "High", "Low", "Close", "Volume"]) + "\n" + ",".join(["9"] * 200) + ",2020-01-02,1,12,0.5,10,7\n")
    for k in range(5):
        write(tmp_path, f"B{k}-2020-01-01-2020-02-01.csv", '\n\ufeffDATE,"Note, long",open,high,low,close,volume\n2020-01-02,"a, b",1,12,0.5,10,7\nDATE,x,open,high,low,close,volume\n')
    layouts = bar_files.file_layouts(spark, str(tmp_path))
    assert sorted(len(paths) for _, paths in layouts) == [1, 5]
    raw = bar_files.read_raw(spark, str(tmp_path))
    plan = raw._jdf.queryExecution().executedPlan().toString()
    # One scan per layout, and no line is shuffled or joined; only needed columns are parsed.
    assert plan.count("FileScan csv") == 2 and "Exchange" not in plan and "Join" not in plan
    assert "c199" not in plan.split("ReadSchema")[1].split(">")[0]
    rows = bar_files.read_bars_csv(spark, str(tmp_path)).collect()
    assert len(rows) == 6 and {tuple(r)[1:7] for r in rows} == {(dt.date(2020, 1, 2), 1.0, 12.0, 0.5, 10.0, 7.0)}


def test_large_file_keeps_its_header_in_every_split(spark, tmp_path):
    lines = "".join(f"{i},2020-01-02,{i},{i},{i},{i}\n" for i in range(60_000))
    write(tmp_path, "A-2020-01-01-2020-02-01.csv", "Volume,Date,Open,High,Low,Close\n" + lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        bars = bar_files.read_bars_csv(spark, str(tmp_path))
        assert bars.rdd.getNumPartitions() > 3 and bars.filter("Volume = Close AND date = '2020-01-02'").count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_written_csv_is_read_by_both_readers(spark, tmp_path):
    tickers = ["AB", "BRK-B", "A/B", "0005", "A+B %"]
    bars = bars_frame(spark, [r for k, t in enumerate(tickers) for r in walk(t, 5, seed=k)])
    out = str(tmp_path / "out")
    bar_files.write_bars(bars, out, fmt="csv")
    got = bar_files.read_bars_csv(spark, out).drop("file_name")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in bars.select(got.columns).collect()}
    newest = bar_files.newest_paths(spark, out)
    assert len(newest) == 5 and bar_files.read_bars_csv(spark, newest).count() == 25


def test_plain_files_are_not_opened(spark, tmp_path):
    (tmp_path / "A-2020-01-01-2020-02-01.csv").write_text(HEADER)
    (tmp_path / "B-2020-01-01-2020-02-01.csv.gz").write_bytes(gzip.compress(b"a") + gzip.compress(b"b" * 3_000_000))
    files = bar_files.file_status(spark, str(tmp_path))
    assert all("content" not in part for part in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1:])
    assert {r["ticker"]: r["problem"] for r in files.collect()} == {"A": None, "B": None}
    packed = (tmp_path / "B-2020-01-01-2020-02-01.csv.gz").read_bytes()
    (tmp_path / "B-2020-01-01-2020-02-01.csv.gz").write_bytes(packed[:-20])
    assert {r["ticker"]: r["problem"] for r in files.collect()} == {"A": None, "B": "the file ends before its data"}


def test_damaged_files_are_reported_not_shortened(spark, tmp_path):
    whole = gzip.compress((HEADER + "2020-01-02,1,2,3,4,5,0,0\n" * 20000).encode())
    (tmp_path / "GOOD-2020-01-01-2020-02-01.csv.gz").write_bytes(whole)
    (tmp_path / "BAD-2020-01-01-2020-02-01.csv.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "TXT-2020-01-01-2020-02-01.csv").write_text(HEADER + "2020-01-02,1,2,3,4,5,0,0\nx,1,2,3,4,5,0,0\n")
    with pytest.raises(Exception):
        bar_files.read_bars_csv(spark, str(tmp_path)).count()
    files = bar_files.file_status(spark, str(tmp_path))
    problems = {r["ticker"]: r["problem"] for r in files.collect()}
    assert problems["GOOD"] is None and problems["TXT"] is None and problems["BAD"]
    good = [r["path"] for r in files.filter("problem IS NULL").collect()]
    listed = spark.createDataFrame([(t,) for t in ("GOOD", "BAD", "TXT", "NONE")], "ticker string")
    status = watchlist.ingest_status(bar_files.read_bars_csv(spark, good), listed, files)
    got = {r["ticker"]: (r["n_rows"], r["n_bad_dates"], r["status"]) for r in status.collect()}
    assert got["GOOD"] == (20000, 0, "loaded") and got["TXT"] == (2, 1, "loaded") and got["NONE"] == (0, 0, "no data")
    assert got["BAD"][0] == 0 and got["BAD"][2].startswith("damaged: ")


def test_ticks_are_hashed_not_sorted(spark):
    ticks = spark.range(1000).selectExpr("id % 7 AS t", "timestamp_ntz'2024-01-01' AS ts", "id", "CAST(id AS DOUBLE) p")
    bars = bars_from_ticks(ticks, F.col("t"), F.col("ts"), F.col("p"), F.col("p"), ["ts", "id"])
    bars.collect()
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_an_order_that_needs_more_digits_is_an_error(spark):
    ticks = spark.range(200).selectExpr("1 AS t", "id")
    with pytest.raises(Exception):
        ticks.select(packed_order(ticks, {"id": 2})).collect()
    with pytest.raises(ValueError):
        packed_order(ticks, {"t": 20, "id": 19})


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_orders_are_right_or_an_error_in_every_mode(spark, ansi):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        one = "timestamp_ntz'2024-01-01' AS ts"
        ticks = spark.range(1).selectExpr("explode(array(1, 50, 12345, -7, NULL)) AS a", "1.5D AS half", "'x' AS name", one)
        order = lambda rows, seq: [r[0] for r in rows.select(packed_order(rows, seq)).collect()]
        fine = ticks.filter("a IS NULL OR a BETWEEN 0 AND 99")
        got = order(fine, {"ts": 17, "a": 2})
        assert [int(x) % 100 for x in got] == [1, 50, 0]
        assert order(ticks.filter("a < 0"), {"a": 5}) == [-7]
        for where, seq in (("a > 99", {"ts": 17, "a": 2}), ("a < 0", {"ts": 17, "a": 2}), ("a = 1", {"half": 3})):
            with pytest.raises(Exception, match="digits of an order"):
                order(ticks.filter(where), seq)
        with pytest.raises(ValueError, match="neither a number nor a time"):
            packed_order(ticks, {"name": 3})
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_round_trip(spark, tmp_path, fmt):
    bars = bars_frame(spark, walk("A", 5) + walk("B-C", 4))
    path = str(tmp_path / "bars")
    bar_files.write_bars(bars, path, fmt)
    back = bar_files.read_bars(spark, path, fmt)
    assert back.exceptAll(bars).count() == 0 and back.count() == 9
    plan = back.filter("ticker = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan


def test_watchlist(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("# ours\naaa\n\n  bbb \nAAA\n")
    listed = watchlist.read_watchlist(spark, str(path))
    assert {r["ticker"] for r in listed.collect()} == {"AAA", "BBB"}
    bars = bars_frame(spark, walk("AAA", 3) + walk("CCC", 2))
    assert watchlist.on_watchlist(bars, listed).count() == 3
    status = {r["ticker"]: (r["n_rows"], r["status"]) for r in watchlist.ingest_status(bars, listed).collect()}
    assert status == {"AAA": (3, "loaded"), "BBB": (0, "no data")}


def test_bars_from_ticks(spark):
    ticks = spark.sql(
        """SELECT 'A' t, timestamp_ntz'2024-01-01 10:00:00' ts, 3 id, 7D p, 1D q UNION ALL
        SELECT 'A', timestamp_ntz'2024-01-01 10:00:00', 2, 5D, 2D UNION ALL
        SELECT 'A', timestamp_ntz'2024-01-01 10:59:59', 1, 6D, 3D UNION ALL
        SELECT 'A', timestamp_ntz'2024-01-01 11:00:00', 1, 9D, 4D"""
    )
    make = lambda i: bars_from_ticks(
        ticks, F.col("t"), F.col("ts"), F.col("p"), F.col("q"), ["ts", "id"], i
    ).orderBy("date").collect()
    hours = [tuple(r)[2:] for r in make("1h")]
    assert hours == [(5.0, 7.0, 5.0, 6.0, 6.0), (9.0, 9.0, 9.0, 9.0, 4.0)]
    assert [tuple(r)[2:] for r in make("1d")] == [(5.0, 9.0, 5.0, 9.0, 10.0)]


def test_dedupe_keeps_the_newest(spark):
    df = spark.createDataFrame(
        [("A", dt.date(2020, 1, 1), 1.0, 1), ("A", dt.date(2020, 1, 1), 2.0, 5), ("A", dt.date(2020, 1, 2), 3.0, 1)],
        "ticker string, date date, Close double, file_no int",
    )
    out = cleaning.dedupe_bars(df, F.col("file_no")).orderBy("date").collect()
    assert [(r["Close"], r["file_no"]) for r in out] == [(2.0, 5), (3.0, 1)]


def test_date_ranges(spark):
    bars = bars_frame(spark, walk("A", 10))
    assert cleaning.date_range(bars, "2001-01-03", "2001-01-05").count() == 3
    assert cleaning.half_open_range(bars, "2001-01-03", "2001-01-05").count() == 2
    assert cleaning.look_back_range(bars, 1, "2001-01-05").count() == 4
    stamped = bars.withColumn("date", F.expr("timestamp(date) + interval 15 hours"))
    assert cleaning.date_range(stamped, "2001-01-03", "2001-01-05").count() == 3


def test_validation_reasons(spark):
    rows = walk("LONG", 26) + walk("SHORT", 5) + walk("GAP", 30)
    rows[40] = (*rows[40][:5], None, rows[40][6])
    got = {r["ticker"]: (r["is_valid"], r["error_message"]) for r in cleaning.validate_bars(bars_frame(spark, rows)).collect()}
    assert got["LONG"] == (True, "")
    assert got["SHORT"] == (False, "5 bars, 26 are needed")
    assert got["GAP"] == (False, "1 bars lack a close or a volume")


def test_bad_dates_are_counted(spark):
    rows = walk("A", 50)
    rows = [(t, None if i < 5 else d, *rest) for i, (t, d, *rest) in enumerate(rows)]
    row = cleaning.validate_bars(bars_frame(spark, rows)).first()
    assert (row["n_rows"], row["n_bad_dates"], row["is_valid"]) == (50, 5, False)
    assert row["error_message"] == "5 bars have no valid date"


def test_overview_of_one_bar(spark):
    row = ticker_overview(bars_frame(spark, walk("A", 1))).first()
    assert row["change"] == 0.0 and row["change_pct"] == 0.0 and row["n_rows"] == 1


def test_title_case(spark):
    df = spark.createDataFrame([("gradient_boosting",)], "m string")
    assert df.select(title_case(F.col("m"))).first()[0] == "Gradient Boosting"


def test_empty_input(spark):
    empty = spark.createDataFrame([], BARS)
    assert cleaning.min_history(empty).count() == 0
    assert cleaning.validate_bars(empty).count() == 0
