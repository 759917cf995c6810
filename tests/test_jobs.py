import datetime as dt

import pytest

from barloom.ml.nightly import nightly_retrain
from barloom.ml.registry import load_model, read_registry
from barloom.streaming.refresh import read_bar_log, refresh_bars

from helpers import walk

HEADER = "date,Open,High,Low,Close,Volume,Dividends,Stock Splits\n"


def write_file(folder, ticker, rows, start="2001-01-01", end="2001-12-31"):
    lines = [f"{r[1]} 00:00:00-05:00," + ",".join(map(str, r[2:])) + ",0.0,0.0" for r in rows]
    (folder / f"{ticker}-{start}-{end}.csv").write_text(HEADER + "\n".join(lines) + "\n")


def test_refresh_is_incremental_and_idempotent(spark, tmp_path):
    raw, table, state = tmp_path / "raw", str(tmp_path / "log"), str(tmp_path / "state")
    raw.mkdir()
    write_file(raw, "A", walk("A", 10, seed=1))
    run = lambda: refresh_bars(spark, str(raw), table, state)
    run()
    assert read_bar_log(spark, table).count() == 10
    run()
    assert read_bar_log(spark, table).count() == 10
    # A later file repeats three days with other prices and adds two.
    later = walk("A", 12, seed=2)[7:]
    write_file(raw, "A", later, "2001-01-08", "2002-01-01")
    run()
    bars = {r["date"]: r["Close"] for r in read_bar_log(spark, table).collect()}
    assert len(bars) == 12
    assert all(abs(bars[r[1]] - r[5]) < 1e-9 for r in later)


def test_a_new_checkpoint_leaves_older_batches_alone(spark, tmp_path):
    raw, table = tmp_path / "raw", str(tmp_path / "log")
    raw.mkdir()
    write_file(raw, "A", walk("A", 10, seed=1))
    refresh_bars(spark, str(raw), table, str(tmp_path / "one"))
    (raw / "A-2001-01-01-2001-12-31.csv").unlink()
    write_file(raw, "B", walk("B", 6, seed=1))
    refresh_bars(spark, str(raw), table, str(tmp_path / "two"))
    got = {r["ticker"]: r["count"] for r in read_bar_log(spark, table).groupBy("ticker").count().collect()}
    assert got == {"A": 10, "B": 6}


@pytest.mark.parametrize("per_ticker", [False, True])
def test_nightly(spark, tmp_path, per_ticker):
    raw = tmp_path / "raw"
    raw.mkdir()
    for k, ticker in enumerate(("AAA", "BBB")):
        write_file(raw, ticker, walk(ticker, 80, seed=k))
    (tmp_path / "list.txt").write_text("BBB\n# later\nAAA\nGONE\n")
    status = nightly_retrain(
        spark, str(raw), str(tmp_path / "list.txt"), str(tmp_path / "out"),
        per_ticker=per_ticker, n_estimators=2, maxDepth=3, as_of=dt.date(2001, 12, 31), run="one",
    )
    training = {r["ticker"]: r["training"] for r in status.collect()}
    assert training == {"AAA": "trained", "BBB": "trained", "GONE": "not trained"}
    uris = {r["model_uri"] for r in read_registry(spark, str(tmp_path / "out" / "registry")).collect()}
    assert all("/models/run=one/" in u for u in uris)
    assert {r["ticker"]: r["status"] for r in status.collect()} == {
        "AAA": "loaded", "BBB": "loaded", "GONE": "no data",
    }
    registry = read_registry(spark, str(tmp_path / "out" / "registry"))
    assert registry.count() == 2
    assert load_model(str(tmp_path / "out" / "models" / "production")) is not None
