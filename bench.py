"""Headline queries on the given tables; prints one JSON line.

Each query is built, planned and executed in full (all rows, all columns, no
output); the better of two runs counts, so that start-up and code generation
do not drown the query.  Queries that fit a model count as they first run, with
the fit; ``predict_next_day`` scores with the model fitted before.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.plans.queries import QUERIES  # noqa: E402
from barloom.session import local_session  # noqa: E402

HEADLINE = [
    "bars_daily",
    "bars_hourly",
    "feat_price",
    "feat_macd",
    "feat_adx",
    "features_all",
    "latest_features",
    "scale_features",
    "perf_metrics",
    "equity_curve",
    "compare_signals",
    "walk_forward_rule",
    "class_metrics",
    "roc_auc",
    "rf_train",
    "predict_next_day",
    "gbt_train",
]
FITS = ("rf_train", "gbt_train")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "12g"))
    times = {}
    for name in names:
        runs = []
        for _ in range(1 if name in FITS else 2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(f"{name}: " + " ".join(f"{r:.2f}" for r in runs), file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
