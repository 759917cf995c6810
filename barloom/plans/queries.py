"""One registered query per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions.indicators import FEATURE_COLS
from barloom.functions.maths import rounded
from barloom.ml import registry as reg
from barloom.ml import scoring
from barloom.ml.many import score_many, train_many
from barloom.ml.training import (
    feature_importance,
    train_by_ticker,
    train_model,
)
from barloom.operators import backtest as bt
from barloom.operators import cleaning, metrics, reports, training_set, walkforward
from barloom.operators.evaluation import compare_curves, evaluate_curve
from barloom.operators.features import compute_features, latest_features
from barloom.operators.panel import index_bars
from barloom.operators.signals import RULES, rule_curve, rule_position
from barloom.plans.tables import daily_bars, hourly_bars, index_level_bars, kept, table
from barloom.session import shared_folder
from barloom.sources import watchlist as wl
from barloom.sources.ticks import bars_from_ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WATCHLIST = ["Brand#11", "# a comment", "", " brand#23", "Brand#4", "Brand#99"]
BAR_COLS = ["Open", "High", "Low", "Close", "Volume"]
# Unit prices often end exactly halfway between two shorter decimals.
EXACT = 9


def query(fn: Query) -> Query:
    """Register under the function's name, without a leading ``q_``."""
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


# ---------------------------------------------------------------- bars


@query
def bars_daily(spark, sf_dir):
    return rounded(daily_bars(spark, sf_dir), EXACT)


@query
def bars_hourly(spark, sf_dir):
    return rounded(hourly_bars(spark, sf_dir), EXACT)


@query
def bars_index(spark, sf_dir):
    return rounded(index_level_bars(spark, sf_dir), EXACT)


@query
def bars_lookback(spark, sf_dir):
    return rounded(cleaning.look_back_range(daily_bars(spark, sf_dir), months=24), EXACT)


@query
def normalize_bars(spark, sf_dir):
    """Order lines as a provider frame: ``Date`` text with mixed UTC offsets."""
    orders = table(spark, sf_dir, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    offset = F.when(F.col("o_orderkey") % 2 == 0, "-05:00").otherwise("-04:00")
    price = F.col("o_totalprice").cast("string")
    raw = orders.select(
        F.col("o_orderpriority").alias("ticker"),
        F.concat(stamp, offset).alias("Date"),
        *[price.alias(c) for c in ("Open", "High", "Low", "Close")],
        F.col("o_orderkey").cast("string").alias("Volume"),
    )
    return rounded(cleaning.normalize_bars(raw), EXACT)


def _dirty_bars(spark, sf_dir) -> DataFrame:
    """Daily bars as text with gaps, words and NaN in fixed places."""
    day = F.day("date")
    text = {c: F.col(c).cast("string") for c in BAR_COLS}
    text["Close"] = F.when(day == 7, "n/a").when(day == 8, "NaN").otherwise(text["Close"])
    text["Volume"] = F.when(day == 9, F.lit(None)).otherwise(text["Volume"])
    text["High"] = F.when(day == 10, "").otherwise(text["High"])
    return daily_bars(spark, sf_dir).withColumns(text)


@query
def coerce_bars(spark, sf_dir):
    return rounded(cleaning.coerce_bars(_dirty_bars(spark, sf_dir)), EXACT)


@query
def clean_bars(spark, sf_dir):
    return rounded(cleaning.clean_bars(cleaning.coerce_bars(_dirty_bars(spark, sf_dir))), EXACT)


@query
def dedupe_bars(spark, sf_dir):
    """Order lines as repeated bars of a supplier day: the newest line wins."""
    lines = table(spark, sf_dir, "lineitem")
    raw = lines.select(
        F.col("l_suppkey").cast("string").alias("ticker"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_extendedprice").alias("Close"),
        F.col("l_quantity").alias("Volume"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )
    newest = F.struct("l_orderkey", "l_linenumber", "l_partkey", "Close", "Volume")
    return rounded(cleaning.dedupe_bars(raw, newest).select("ticker", "date", "Close", "Volume"), EXACT)


def _user_bars(spark, sf_dir) -> DataFrame:
    """Daily bars per user: series of very different lengths."""
    return bars_from_ticks(
        table(spark, sf_dir, "events"),
        ticker=F.col("user_id").cast("string"),
        ts=F.col("ts"),
        price=F.col("value"),
        size=F.lit(1.0),
        sequence=["ts", "event_id"],
    )


@query
def min_history(spark, sf_dir):
    long = cleaning.min_history(kept(_user_bars(spark, sf_dir)), 5)
    return rounded(long.drop("idx"), EXACT)


@query
def date_range(spark, sf_dir):
    return rounded(cleaning.date_range(hourly_bars(spark, sf_dir), "2024-01-05", "2024-01-20"), EXACT)


@query
def validate_bars(spark, sf_dir):
    dirty = cleaning.coerce_bars(_dirty_bars(spark, sf_dir))
    # Dates that did not parse.
    dirty = dirty.withColumn("date", F.when(F.day("date") != 11, F.col("date")))
    clean = _user_bars(spark, sf_dir)
    return cleaning.validate_bars(dirty.unionByName(clean), 5)


def _watchlist(spark) -> DataFrame:
    return wl.parse_watchlist(spark.createDataFrame([(t,) for t in WATCHLIST], "value string"))


def _upper_bars(spark, sf_dir) -> DataFrame:
    return daily_bars(spark, sf_dir).withColumn("ticker", F.upper("ticker"))


@query
def watchlist_bars(spark, sf_dir):
    return rounded(wl.on_watchlist(_upper_bars(spark, sf_dir), _watchlist(spark)), EXACT)


@query
def ingest_status(spark, sf_dir):
    bars = _upper_bars(spark, sf_dir)
    bars = bars.withColumn("date", F.when(F.day("date") != 11, F.col("date")))
    return wl.ingest_status(bars, _watchlist(spark))


@query
def ticker_overview(spark, sf_dir):
    return rounded(reports.ticker_overview(kept(daily_bars(spark, sf_dir))), EXACT)


# ------------------------------------------------------------ features


def _features(columns: list[str], digits: int = 6, **special: int) -> Query:
    def run(spark, sf_dir):
        df = compute_features(kept(daily_bars(spark, sf_dir)), tuple(columns))
        return rounded(df.select("ticker", "date", *columns), digits, **special)

    return run


FEATURE_GROUPS = {
    "feat_price": FEATURE_COLS[0:9],
    "feat_rsi": ["rsi"],
    "feat_volatility": ["rolling_std_10", "volatility_5", "volatility_10", "volatility_20"],
    "feat_volume": ["volume_sma_10", "volume_zscore", "volume_ratio", "volume_price_trend"],
    "feat_range": ["hl_range", "hl_range_5", "price_position"],
    "feat_macd": ["macd", "macd_signal", "macd_histogram"],
    "feat_bollinger": ["bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_position"],
    "feat_momentum": ["momentum_5", "momentum_10", "roc_5", "roc_10"],
    "feat_ema": [
        "ema_5",
        "ema_10",
        "ema_20",
        "close_to_ema5",
        "close_to_ema10",
        "close_to_ema20",
    ],
    "feat_atr": ["atr_14"],
    "feat_patterns": ["higher_high", "lower_low", "gap_up", "gap_down"],
    "feat_adx": ["adx"],
    "feat_trend": ["trend_strength"],
}
# Columns on the price scale agree to fewer decimals across engines.
PRICE_SCALE = {
    c: 4
    for c in [
        "macd",
        "macd_signal",
        "macd_histogram",
        "ema_5",
        "ema_10",
        "ema_20",
        "bb_middle",
        "bb_upper",
        "bb_lower",
        "sma_5",
        "sma_10",
        "sma_20",
        "rolling_std_10",
        "atr_14",
        "volume_price_trend",
        "volume_sma_10",
    ]
}
for _name, _columns in FEATURE_GROUPS.items():
    QUERIES[_name] = _features(_columns, **PRICE_SCALE)


@query
def label(spark, sf_dir):
    df = compute_features(kept(daily_bars(spark, sf_dir)), ())
    return rounded(df.select("ticker", "date", "next_close", "next_pct_change", "target"), EXACT)


@query
def features_all(spark, sf_dir):
    df = compute_features(kept(daily_bars(spark, sf_dir)))
    return rounded(df.select("ticker", "date", *FEATURE_COLS, "target"), **PRICE_SCALE)


@query
def features_hourly(spark, sf_dir):
    """All features on timestamped bars."""
    df = compute_features(kept(hourly_bars(spark, sf_dir)))
    return rounded(df.select("ticker", "date", *FEATURE_COLS, "target"), **PRICE_SCALE)


@query
def features_from_ticks(spark, sf_dir):
    """All features straight from ticks, which are read once."""
    df = compute_features(hourly_bars(spark, sf_dir), once=True)
    return rounded(df.select("ticker", "date", "idx", "n_bars", *FEATURE_COLS, "target"), **PRICE_SCALE)


def _latest(spark, sf_dir, rows):
    df = latest_features(kept(daily_bars(spark, sf_dir)), rows)
    return rounded(df.select("ticker", "date", *FEATURE_COLS), **PRICE_SCALE)


@query
def q_latest_features(spark, sf_dir):
    return _latest(spark, sf_dir, 1)


@query
def features_tail5(spark, sf_dir):
    return _latest(spark, sf_dir, 5)


# ------------------------------------------------------- training data


@query
def label_distribution(spark, sf_dir):
    return metrics.label_distribution(compute_features(kept(daily_bars(spark, sf_dir)), ()))


@query
def time_split(spark, sf_dir):
    df = training_set.time_split(compute_features(kept(daily_bars(spark, sf_dir)), ()))
    return df.select("ticker", "date", "idx", "n_bars", "is_test", "target")


SCALED = ["pct_change_1", "rsi", "volatility_10", "hl_range", "gap_up", "volume_ratio"]


@query
def scale_features(spark, sf_dir):
    df = training_set.time_split(compute_features(kept(daily_bars(spark, sf_dir)), tuple(SCALED)))
    out = training_set.scale_features(df, tuple(SCALED))
    return rounded(out.select("ticker", "date", "is_test", *SCALED))


@query
def class_weights(spark, sf_dir):
    df = training_set.time_split(compute_features(kept(daily_bars(spark, sf_dir)), ()))
    return rounded(training_set.class_weights(df.filter(~F.col("is_test"))))


@query
def cv_folds(spark, sf_dir):
    df = compute_features(kept(daily_bars(spark, sf_dir)), ())
    return training_set.with_folds(df).select("ticker", "date", "target", "fold")


# ------------------------------------------------------------ backtest


def _curve(spark, sf_dir, rules=("sma_cross",)):
    return rule_curve(kept(index_level_bars(spark, sf_dir)), rules)


@query
def strategy_returns(spark, sf_dir):
    df = _curve(spark, sf_dir)
    return rounded(df.select("ticker", "date", "position", "price", "price_return", "returns"))


@query
def equity_curve(spark, sf_dir):
    df = _curve(spark, sf_dir)
    return rounded(df.select("ticker", "date", "returns", "cumulative_returns", "capital"))


@query
def perf_metrics(spark, sf_dir):
    return rounded(bt.perf_metrics(_curve(spark, sf_dir)))


@query
def buy_and_hold(spark, sf_dir):
    return rounded(_curve(spark, sf_dir).select("ticker", "date", "buy_and_hold"))


@query
def drawdown_series(spark, sf_dir):
    df = _curve(spark, sf_dir)
    percent = (F.col("drawdown") * F.lit(100.0)).alias("drawdown_pct")
    return rounded(df.select("ticker", "date", "running_max", percent))


@query
def returns_histogram(spark, sf_dir):
    curve = rule_curve(kept(index_level_bars(spark, sf_dir)), ("sma_cross",), extremes=True)
    return rounded(metrics.returns_histogram(curve))


@query
def signals_join(spark, sf_dir):
    """Signals arrive as a table of their own and are bound by key."""
    bars = kept(index_level_bars(spark, sf_dir))
    features = compute_features(bars, ("rsi",))
    # Positions in the series come along, so that nothing is numbered again.
    position = rule_position("rsi_high").alias("position")
    signals = features.select("ticker", "date", "idx", "n_bars", position)
    prices = bars.select("ticker", "date", F.col("Close").alias("price"))
    curve = bt.backtest_signals(bt.join_signals(prices, signals))
    return rounded(curve.select("ticker", "date", "position", "price", "returns", "capital"))


@query
def backtest_rule(spark, sf_dir):
    """Date filter, features, signal, returns and both kinds of metrics."""
    bars = kept(cleaning.date_range(index_level_bars(spark, sf_dir), "2024-01-03", "2024-01-25"))
    return rounded(evaluate_curve(rule_curve(bars, ("macd_trend",))))


@query
def compare_signals(spark, sf_dir):
    return rounded(compare_curves(_curve(spark, sf_dir, tuple(RULES))))


@query
def comparison_display(spark, sf_dir):
    return reports.comparison_display(compare_curves(_curve(spark, sf_dir, tuple(RULES))))


@query
def walk_forward_windows(spark, sf_dir):
    placed = index_bars(kept(index_level_bars(spark, sf_dir)))
    rows = walkforward.walk_forward_windows(placed)
    return rows.select("ticker", "date", "idx", "window_id")


@query
def walk_forward_bounds(spark, sf_dir):
    return walkforward.window_bounds(index_bars(kept(index_level_bars(spark, sf_dir))))


@query
def walk_forward_rule(spark, sf_dir):
    return rounded(walkforward.walk_forward_rule(kept(index_level_bars(spark, sf_dir)), "sma_cross"))


@query
def walk_forward_status(spark, sf_dir):
    dirty = kept(cleaning.coerce_bars(_dirty_bars(spark, sf_dir)))
    return walkforward.walk_forward_status(dirty, train=120, test=40, step=20)


# ------------------------------------------------------ classification


def _scored(spark, sf_dir):
    df = compute_features(kept(index_level_bars(spark, sf_dir)), ("rsi",))
    return df.withColumns(
        {
            "prob_up": F.round(F.col("rsi") / F.lit(100.0), 4),
            "prediction": rule_position("rsi_high"),
        }
    )


@query
def class_metrics(spark, sf_dir):
    return rounded(metrics.class_metrics(_scored(spark, sf_dir), score="prob_up"))


@query
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(_scored(spark, sf_dir)))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_scored(spark, sf_dir))


@query
def confusion_rows(spark, sf_dir):
    return metrics.confusion_rows(_scored(spark, sf_dir))


@query
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(_scored(spark, sf_dir)))


# ------------------------------------------- registry and predictions


def rule_registry(spark, sf_dir) -> DataFrame:
    """Registry rows of the rule signals, evaluated like trained models."""
    curve = training_set.time_split(_curve(spark, sf_dir, tuple(RULES)))
    keys = ("ticker", "model")
    test = F.col("is_test")
    hit = (F.col("target") == F.col("position")).cast("double")
    sums = curve.groupBy(*keys).agg(
        *bt.perf_sums(),
        F.avg(F.when(test, hit)).alias("accuracy"),
        F.avg(F.when(~test, hit)).alias("train_accuracy"),
        F.count_if(~test).alias("train_size"),
        F.count_if(test).alias("test_size"),
        F.max(F.when(~test, F.col("date"))).alias("training_date"),
    )
    # One pass over the curve gives the sizes and the figures of the map.
    return sums.select(
        "ticker",
        F.col("model").alias("model_type"),
        "accuracy",
        "train_accuracy",
        "train_size",
        "test_size",
        F.lit(len(FEATURE_COLS)).alias("feature_count"),
        "training_date",
        reg.figures_map(bt.perf_figures()).alias("backtest_metrics"),
    )


@query
def rule_registry_rows(spark, sf_dir):
    df = rule_registry(spark, sf_dir)
    sharpe = F.element_at("backtest_metrics", "sharpe_ratio").alias("sharpe_ratio")
    columns = [c for c in df.columns if c != "backtest_metrics"]
    return rounded(df.select(*columns, sharpe))


@query
def model_info(spark, sf_dir):
    df = rule_registry(spark, sf_dir)
    # One model without a recorded type: the default shows.
    known = F.when(F.col("model_type") != "rsi_high", F.col("model_type"))
    return rounded(reg.model_info(df.withColumn("model_type", known).drop("training_date")))


@query
def production_model(spark, sf_dir):
    df = reg.select_production(
        rule_registry(spark, sf_dir), ["nobody", "purchase", "click", "view"], prefer="view"
    )
    return rounded(df.select("ticker", "model_type", "accuracy", "train_size", "test_size"))


@query
def registry_compare(spark, sf_dir):
    return rounded(reg.registry_compare(rule_registry(spark, sf_dir)))


@query
def quality_gate(spark, sf_dir):
    return rounded(reg.quality_gate(rule_registry(spark, sf_dir), 0.55, 0.60, -2.0))


def _history(spark, sf_dir) -> DataFrame:
    """Predictions for every bar, with the RSI as a deterministic score."""
    labelled = scoring.label_predictions(_scored(spark, sf_dir))
    return reg.prediction_records(
        labelled, F.lit("rsi"), F.lit(0.5), F.col("date").cast("timestamp")
    )


@query
def history_summary(spark, sf_dir):
    return rounded(reports.history_summary(_history(spark, sf_dir)))


@query
def history_display(spark, sf_dir):
    return reports.history_display(_history(spark, sf_dir))


@query
def prediction_log(spark, sf_dir):
    """A log that got its first days, then all days, and all days once more after a failure."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    records = kept(_history(spark, sf_dir))
    for some in (records.filter("date < '2024-01-10'"), records, records):
        reg.merge_history(some, path)
    reg.compact_history(spark, path)
    columns = ("ticker", "date", "current_price", "prediction", "probability", "model_ticker")
    return rounded(reg.read_history(spark, path).select(*columns), EXACT)


# -------------------------------------------------------------- models

_FITTED: dict[tuple, object] = {}


def _trained(spark, sf_dir, model_type="random_forest"):
    """Train once per session and input; the queries below share the model."""
    key = (spark.sparkContext.applicationId, sf_dir, model_type)
    if key not in _FITTED:
        bars = kept(index_level_bars(spark, sf_dir))
        _FITTED[key] = train_model(bars, model_type)
    return _FITTED[key]


def _trained_together(spark, sf_dir, *model_types):
    """Models of several types, trained at the same time: the jobs of one alone leave cores idle."""
    train = inheritable_thread_target(spark)(lambda kind: _trained(spark, sf_dir, kind))
    with ThreadPool(len(model_types)) as pool:
        return pool.map(train, model_types, chunksize=1)


def _train_query(model_type: str) -> Query:
    def run(spark, sf_dir):
        trained = _trained(spark, sf_dir, model_type)
        return trained.evaluation().withColumn("model_type", F.lit(model_type))

    return run


QUERIES["rf_train"] = _train_query("random_forest")
QUERIES["gbt_train"] = _train_query("gradient_boosting")
QUERIES["xgb_like_train"] = _train_query("xgboost")


def _tuned(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, "tuned")
    if key not in _FITTED:
        _FITTED[key] = train_model(kept(index_level_bars(spark, sf_dir)), tune=True)
    return _FITTED[key]


@query
def tune_rf(spark, sf_dir):
    """A tuned model, through training: the trials, and what the winner scores on its test rows."""
    trained = _tuned(spark, sf_dir)
    held = trained.evaluation(by=()).filter("is_test").select(F.col("accuracy").alias("held_out"))
    return trained.trials.join(F.broadcast(held))  # one row


@query
def train_eval(spark, sf_dir):
    return _trained(spark, sf_dir).report()


@query
def q_train_by_ticker(spark, sf_dir):
    """A model for every series there is, and one that is not there."""
    bars = kept(index_level_bars(spark, sf_dir))
    tickers = [r["ticker"] for r in bars.select("ticker").distinct().orderBy("ticker").collect()]
    done = train_by_ticker(bars, [*tickers, "nobody"])
    out = None
    for trained in done.models.values():
        one = trained.evaluation().filter("is_test").drop("is_test")
        out = one if out is None else out.unionByName(one)
    return done.outcome.join(out, "ticker", "left") if out is not None else done.outcome


def _many(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, "many")
    if key not in _FITTED:
        _FITTED[key] = train_many(kept(index_level_bars(spark, sf_dir)))
    return _FITTED[key]


@query
def q_train_many(spark, sf_dir):
    """A model for every series in one pass: what came of each, and how its test rows were met."""
    done = _many(spark, sf_dir)
    held = metrics.class_metrics(done.scored.filter("is_test"), ("ticker",), score="prob_up")
    return done.outcome.join(held, "ticker", "left")


@query
def predict_many(spark, sf_dir):
    """Direction for the bar after the last one, by the model of each series."""
    done = _many(spark, sf_dir)
    rows = latest_features(kept(index_level_bars(spark, sf_dir)), 1, done.columns)
    return scoring.label_predictions(score_many(rows, done.models, done.columns, done.model_type))


@query
def score_all(spark, sf_dir):
    return _trained(spark, sf_dir).scored.select(
        "ticker", "date", "target", "is_test", "prediction", "prob_up"
    )


@query
def predict_next_day(spark, sf_dir):
    return scoring.predict_next_day(
        kept(index_level_bars(spark, sf_dir)), _trained(spark, sf_dir).model
    )


@query
def q_feature_importance(spark, sf_dir):
    return feature_importance(_trained(spark, sf_dir).model)


@query
def backtest_model(spark, sf_dir):
    tables = scoring.backtest_model(
        kept(index_level_bars(spark, sf_dir)),
        _trained(spark, sf_dir).model,
        "2024-01-03",
        "2024-01-25",
    )
    return tables["performance"].join(tables["classification"], "ticker")


@query
def backtest_holdout(spark, sf_dir):
    return _trained(spark, sf_dir).holdout_metrics()


@query
def walk_forward_model(spark, sf_dir):
    return scoring.walk_forward_model(
        kept(index_level_bars(spark, sf_dir)), _trained(spark, sf_dir).model
    )


@query
def compare_models(spark, sf_dir):
    forest, boosting = _trained_together(spark, sf_dir, "random_forest", "gradient_boosting")
    models = {"forest": forest.model, "boosting": boosting.model}
    return scoring.compare_models(kept(index_level_bars(spark, sf_dir)), models)


@query
def model_roundtrip(spark, sf_dir):
    """Save, load, and score with the loaded model."""
    uri = reg.save_model(
        _trained(spark, sf_dir).model, f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    )
    model = reg.load_model(uri)
    return scoring.predict_next_day(kept(index_level_bars(spark, sf_dir)), model)


@query
def model_registry(spark, sf_dir):
    return reg.registry_rows(_trained(spark, sf_dir))


# ------------------------- what SQL can say about the fitted models
# The queries above return what the models say. These return what must hold of
# it whatever the trees look like: which rows were scored, how they split, and
# that the figures are consistent with each other.


def _probability_facts() -> list:
    p, predicted = F.col("prob_up"), F.col("prediction")
    return [
        F.count_if(p.between(0.0, 1.0)).alias("n_probabilities"),
        F.count_if(predicted == F.when(p > 0.5, 1).otherwise(0)).alias("n_consistent"),
    ]


@query
def tune_rf_facts(spark, sf_dir):
    """The search judged every trial on every training row, and marked the best of all its points."""
    trials = _tuned(spark, sf_dir).trials
    highest = trials.agg(F.max("accuracy").alias("highest"))
    return trials.join(F.broadcast(highest)).agg(  # one row
        F.count(F.lit(1)).alias("n_trials"),
        F.count_distinct(F.to_json("params")).alias("n_points"),
        F.max("n_rows").alias("n_rows"),
        (F.min("n_rows") == F.max("n_rows")).alias("same_rows"),
        F.count_if("best").alias("n_best"),
        F.bool_and(~F.col("best") | (F.col("accuracy") == F.col("highest"))).alias("best_is_highest"),
        F.bool_and(F.col("accuracy").between(0.0, 1.0)).alias("accuracy_holds"),
    )


@query
def train_many_facts(spark, sf_dir):
    """Every series was trained, and each of its rows scored once."""
    done = _many(spark, sf_dir)
    rows = done.scored.groupBy("ticker", "is_test").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum("target").alias("n_up"),
        *_probability_facts(),
    )
    trees = done.models.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_trees"))
    return rows.join(done.outcome, "ticker").join(trees, "ticker")


@query
def predict_many_facts(spark, sf_dir):
    rows = predict_many(spark, sf_dir)
    up = F.col("prediction") == "Up"
    holds = (F.col("prob_up") > 0.5) == up
    return rounded(rows.select("ticker", "date", "current_price", holds.alias("probability_holds")), EXACT)


@query
def xgb_like_facts(spark, sf_dir):
    """Second-order boosting scored every row and saved and loaded model agree."""
    trained = _trained(spark, sf_dir, "xgboost")
    uri = reg.save_model(trained.model, f"{shared_folder(spark)}/models-{uuid.uuid4().hex}")
    again = scoring.score(trained.scored.drop("prediction", "prob_up"), reg.load_model(uri))
    rows = again.withColumnRenamed("prob_up", "again").select("ticker", "date", "again").join(trained.scored, ["ticker", "date"])
    return rows.groupBy("ticker", "is_test").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("target").alias("n_up"),
        *_probability_facts(),
        F.count_if(F.col("again") == F.col("prob_up")).alias("n_same"),
    )


@query
def score_all_facts(spark, sf_dir):
    rows = _trained(spark, sf_dir).scored
    return rows.groupBy("ticker", "is_test").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum("target").alias("n_up"),
        *_probability_facts(),
    )


@query
def evaluation_facts(spark, sf_dir):
    """Rows and positives behind the figures of every kind of model."""
    out, kinds = None, ("random_forest", "gradient_boosting")
    for kind, trained in zip(kinds, _trained_together(spark, sf_dir, *kinds)):
        figures = trained.evaluation()
        hits = F.col("tp") + F.col("tn")
        rows = hits + F.col("fp") + F.col("fn")
        one = figures.select(
            F.lit(kind).alias("model_type"),
            "ticker",
            "is_test",
            rows.alias("n_rows"),
            (F.col("tp") + F.col("fn")).alias("n_up"),
            (F.abs(F.col("accuracy") - hits / rows) < 1e-9).alias("accuracy_holds"),
            F.col("roc_auc").between(0.0, 1.0).alias("auc_holds"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query
def train_eval_facts(spark, sf_dir):
    report = _trained(spark, sf_dir).report()
    return report.select(
        "ticker",
        "label",
        "support",
        F.greatest("precision", "recall", "f1_score").between(0.0, 1.0).alias("figures_hold"),
    )


@query
def predict_next_day_facts(spark, sf_dir):
    said = predict_next_day(spark, sf_dir)
    sure = F.greatest("prob_up", "prob_down")
    return rounded(
        said.select(
            "ticker",
            "date",
            "current_price",
            (F.col("prob_up") + F.col("prob_down")).alias("whole"),
            (F.abs(F.col("probability") - sure) < 1e-9).alias("probability_holds"),
        ),
        EXACT,
    )


@query
def feature_importance_facts(spark, sf_dir):
    every = feature_importance(_trained(spark, sf_dir).model, None)
    return rounded(
        every.agg(
            F.countDistinct("feature").alias("n_features"),
            F.sum("importance").alias("whole"),
            F.count_if(F.col("importance") < 0).alias("n_negative"),
        )
    )


@query
def backtest_holdout_facts(spark, sf_dir):
    curve = _trained(spark, sf_dir).holdout_curve()
    return rounded(
        curve.groupBy("ticker").agg(
            F.count(F.lit(1)).alias("n_days"),
            F.count("returns").alias("n_returns"),
            F.min("date").alias("first_date"),
            F.max_by("buy_and_hold", "idx").alias("buy_and_hold"),
            F.count_if(F.col("drawdown") > 0).alias("n_wrong_drawdowns"),
        )
    )


@query
def walk_forward_model_facts(spark, sf_dir):
    windows = walk_forward_model(spark, sf_dir)
    return windows.select(
        "ticker",
        "window_id",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_rows"),
        (F.col("tp") + F.col("fn")).alias("n_up"),
    )


@query
def compare_models_facts(spark, sf_dir):
    both = compare_models(spark, sf_dir)
    return both.select(
        "ticker", "model", F.col("accuracy").between(0.0, 1.0).alias("accuracy_holds")
    )


@query
def model_registry_facts(spark, sf_dir):
    rows = model_registry(spark, sf_dir)
    return rows.select(
        "ticker",
        "model_type",
        "train_size",
        "test_size",
        "feature_count",
        "n_estimators",
        "random_state",
        F.size("top_features").alias("n_top_features"),
        F.size("backtest_metrics").alias("n_figures"),
    )
