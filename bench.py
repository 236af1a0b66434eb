"""Times the stages and reports on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every stage is measured from the stored table before it; `clean` starts at the raw tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))


def main() -> None:
    from pyspark.sql import functions as F

    from hourloom import build_session
    from hourloom.operators import cleaning as C
    from hourloom.operators import explore as X
    from hourloom.operators import features as FE
    from hourloom.operators import folds as FO
    from hourloom.operators import forecasters as FC
    from hourloom.operators import metrics as M
    from hourloom.operators import regression as R
    from hourloom.operators import reports as RP
    from hourloom.operators import trees as TR
    from hourloom.plans.catalog import Stages
    from hourloom.session import materialize

    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    s = Stages(spark, SF_DIR)
    took: dict[str, float] = {}

    def timed(name, build):
        start = time.perf_counter()
        out = build()
        took[name] = round(time.perf_counter() - start, 3)
        return out

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    s.raw.limit(1).count()  # start the executors before the clock
    hourly = timed("hourly_readings", lambda: materialize(C.hourly_readings(s.raw), "hourly"))
    annotated = timed(
        "clean", lambda: materialize(C.clean_annotated(hourly, s.weather), "annotated")
    )
    clean = C.clean_columns(annotated)
    timed("reconciliation", lambda: drain(C.reconciliation(hourly, annotated)))
    timed("validation", lambda: drain(C.validation_report(clean)))
    features = timed("features", lambda: materialize(FE.build_features(clean), "features"))
    folds = timed("folds", lambda: FO.make_folds(features))
    naive = timed(
        "backtest_baselines",
        lambda: materialize(FC.run_backtest(["naive", "snaive"], features, folds), "results"),
    )
    linear = timed(
        "backtest_regressions",
        lambda: materialize(FC.run_backtest(["sarima", "prophet"], features, folds), "results"),
    )
    results = naive.unionByName(linear)
    timed("guards", lambda: drain(FC.forecast_violations(linear.where("model = 'sarima'"), features, folds)))
    timed("summary", lambda: drain(M.summarize(results)))
    timed("significance", lambda: drain(RP.significance_table(results)))
    timed("error_tables", lambda: drain(RP.error_tables(naive.where("model = 'naive'"))))
    timed("sequence_windows", lambda: drain(FE.sequence_windows(features)))
    timed("standardisation", lambda: drain(R.standardisation(features, folds)))
    timed("describe", lambda: drain(X.describe(clean)))
    # Every lead of every series at the shipped settings, for the last fold: one fit in 52 of the whole backtest.
    last = folds.join(folds.groupBy("series").agg(F.max("fold").alias("fold")), ["series", "fold"])
    store = timed("tree_store", lambda: TR.training_store(features))
    timed("tree_fits_last_fold", lambda: TR.fold_fits(features, last, store=store))
    timed("acf", lambda: drain(X.acf(clean)))
    timed("decompose", lambda: drain(X.decompose(X.daily_mean(clean))))
    timed("monthly_peak", lambda: drain(X.monthly_peak(clean)))
    timed("yearly_change", lambda: drain(X.yearly_change(clean)))
    spark.stop()
    print(json.dumps({
        "metric": "pipeline_seconds",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
