"""The nightly job: load the newest bars, train, register, publish."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.ml.registry import (
    PREFERRED_TICKER,
    append_registry,
    load_model,
    read_registry,
    registry_rows,
    save_model,
    select_production,
)
from barloom.ml.training import Trained, train_by_ticker, train_model
from barloom.ml.versions import publish
from barloom.operators.cleaning import look_back_range
from barloom.session import cut_lineage
from barloom.sources.bar_files import file_status, newest_paths, read_bars_csv
from barloom.sources.watchlist import ingest_status, on_watchlist, read_watchlist, watchlist_order

# Effort and history of the nightly run.
NIGHTLY_TREES = 300
LOOK_BACK_MONTHS = 24


def nightly_retrain(
    spark: SparkSession,
    bars_folder: str,
    watchlist_path: str,
    out: str,
    per_ticker: bool = False,
    n_estimators: int = NIGHTLY_TREES,
    prefer: str = PREFERRED_TICKER,
    as_of=None,
    run: str | None = None,
    **options,
) -> DataFrame:
    """Train on the newest file of every listed ticker.

    Returns, per listed ticker, what was loaded (``status``, with damaged files
    and bad dates) and what came of training (``training``, ``reason``).  By
    default one pooled model is trained and registered for every series;
    ``per_ticker`` trains one model per listed ticker instead.  Models go to
    ``{out}/models/run={run}``, so a registry row keeps describing its own
    model; a run that is repeated under the same name replaces itself.  The
    model to serve is copied to a folder of its own below ``{out}/models/production``
    and served from there on; a run that breaks off leaves the old one served.
    """
    run = run or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")
    listed = read_watchlist(spark, watchlist_path)
    order = watchlist_order(spark, watchlist_path)
    paths = newest_paths(spark, bars_folder)
    files = file_status(spark, paths)
    damaged = {r["path"] for r in files.filter("problem IS NOT NULL").select("path").collect()}
    bars = read_bars_csv(spark, [p for p in paths if p not in damaged]).drop("file_name")
    bars = cut_lineage(on_watchlist(bars, listed))
    status = ingest_status(bars, listed, files)
    bars = look_back_range(bars, LOOK_BACK_MONTHS, as_of)
    options = {"n_estimators": n_estimators, **options}

    def keep(name: str, trained: Trained) -> None:
        uri = save_model(trained.model, f"{out}/models/run={run}/{name}")
        append_registry(registry_rows(trained, uri), f"{out}/registry", run, name)

    if per_ticker:
        done = train_by_ticker(bars, order, keep=keep, **options)
        fitted = done.models
        outcome = done.outcome.withColumnRenamed("status", "training")
    else:
        fitted = {"pooled": train_model(bars, **options)}
        keep("pooled", fitted["pooled"])
        used = fitted["pooled"].scored.select("ticker").distinct()
        outcome = used.select("ticker", F.lit("trained").alias("training"), F.lit("").alias("reason"))
    if fitted:
        chosen = select_production(read_registry(spark, f"{out}/registry"), order, prefer).first()
        if chosen is not None:
            model = load_model(chosen["model_uri"])
            publish(spark, f"{out}/models/production", lambda folder: save_model(model, folder))
    left_out = F.lit("too few bars")
    return status.join(outcome, "ticker", "left").withColumns(
        {
            "training": F.coalesce("training", F.lit("not trained")),
            "reason": F.coalesce("reason", left_out),
        }
    )
