"""DuckDB SQL stating what each registered query must return.

Written apart from the Spark code and, where it can be, along another route: one window
over a whole series, self-joins, calendars generated from rules. Named common table
expressions are put in front of a query when it (or another used one) mentions them.
"""

from __future__ import annotations

import re

from hourloom.config import FEATURES

NY = "'America/New_York'"


def _r(*cols: str, digits: int = 6) -> str:
    """Rounded columns; adding zero turns -0 into 0."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


_FOURIER = ", ".join(
    f"{fn}(2 * pi() * {k} * h / {p}) AS {fn}_{p}_{k}"
    for p in (24, 168)
    for k in (1, 2, 3)
    for fn in ("sin", "cos")
)
FOURIER_NAMES = [f"{fn}_{p}_{k}" for p in (24, 168) for k in (1, 2, 3) for fn in ("sin", "cos")]
_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
_ERRORS = """avg(CASE WHEN y_true = 0 THEN CASE WHEN y_pred = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END
                   ELSE abs(y_true - y_pred) / y_true END) AS mape,
             sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae"""
_WEEKLY = "SELECT * FROM results WHERE protocol = 'weekly'"

CTES: dict[str, str] = {
    "raw_load": """
        SELECT 'S' || lpad(CAST(l_orderkey // 5000 AS VARCHAR), 8, '0') AS series,
               TIMESTAMP '2016-01-01 00:00:00' + to_hours(CAST(h AS INTEGER)) AS wall,
               CASE WHEN l_orderkey % 641 = 0 THEN 12 WHEN l_orderkey % 643 = 1 THEN -1 ELSE 1 END * (
                 24000 + 4500 * sin(2 * pi() * (h % 24 - 9) / 24) + CASE WHEN (h // 24 + 4) % 7 >= 5 THEN -1500 ELSE 0 END
                 + 2500 * cos(2 * pi() * (h - 480) / 8766) + 20 * sqrt(l_extendedprice)) AS load
        FROM (SELECT *, r + CASE WHEN r >= 3123 THEN 3 ELSE 0 END + CASE WHEN r >= 6165 THEN 30 ELSE 0 END AS h
              FROM (SELECT *, (l_orderkey * 7 + l_linenumber * 1237) % 9600 AS r FROM lineitem))""",
    "raw_weather": """
        SELECT TIMESTAMP '2016-01-01 00:00:00' + to_hours(CAST(h AS INTEGER)) AS datetime_utc,
               12 - 13 * cos(2 * pi() * (h - 360) / 8766) + 4 * sin(2 * pi() * (h % 24 - 14) / 24)
                 + sqrt(o_totalprice) / 45 - 5 AS temp_c, o_orderkey AS tiebreak
        FROM (SELECT *, o_orderkey % 9600 + (o_orderkey % 9600) // 36 AS h FROM orders)""",
    "by_wall": "SELECT series, wall, avg(load) AS load, count(*) AS n_rows FROM raw_load GROUP BY ALL",
    "zoned": f"""
        SELECT *, (wall AT TIME ZONE {NY}) AT TIME ZONE 'UTC' AS u0 FROM by_wall""",
    # DuckDB takes the later offset of a repeated hour; the rule is the earlier one.
    "shifted": f"""
        SELECT series, wall, load, n_rows,
               CASE WHEN (((u0 - INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE {NY}) = wall
                    THEN u0 - INTERVAL 1 HOUR ELSE u0 END AS u
        FROM zoned""",
    "hourly": f"""
        SELECT series, wall, load, n_rows,
               CASE WHEN ((u AT TIME ZONE 'UTC') AT TIME ZONE {NY}) = wall THEN u END AS ts
        FROM shifted""",
    "spans": """SELECT series, min(ts) AS lo, max(ts) AS hi FROM hourly WHERE ts IS NOT NULL GROUP BY 1""",
    "slots": "SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM spans",
    "grid": """
        SELECT s.series, s.ts, h.load
        FROM slots s LEFT JOIN hourly h ON s.series = h.series AND s.ts = h.ts""",
    "weather": """
        SELECT datetime_utc, arg_min(temp_c, tiebreak) AS temp_c FROM raw_weather GROUP BY 1""",
    "joined": """
        SELECT g.series, g.ts, g.load, w.temp_c FROM grid g LEFT JOIN weather w ON g.ts = w.datetime_utc""",
    "looked": f"""
        SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE {NY} AS local_ts,
               last_value(CASE WHEN load IS NOT NULL THEN ts END IGNORE NULLS) OVER up AS lp,
               last_value(load IGNORE NULLS) OVER up AS lpv,
               last_value(CASE WHEN load IS NOT NULL THEN ts END IGNORE NULLS) OVER down AS ln,
               last_value(load IGNORE NULLS) OVER down AS lnv,
               last_value(CASE WHEN temp_c IS NOT NULL THEN ts END IGNORE NULLS) OVER up AS tp,
               last_value(temp_c IGNORE NULLS) OVER up AS tpv,
               last_value(CASE WHEN temp_c IS NOT NULL THEN ts END IGNORE NULLS) OVER down AS tn,
               last_value(temp_c IGNORE NULLS) OVER down AS tnv
        FROM joined
        WINDOW up AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               down AS (PARTITION BY series ORDER BY ts DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "islands": """
        SELECT series, ts, count(load) OVER (PARTITION BY series ORDER BY ts) AS island
        FROM grid""",
    "runs": """
        SELECT i.series, min(i.ts) AS gap_start, CAST(count(*) AS INTEGER) AS gap_hours
        FROM islands i JOIN grid g ON i.series = g.series AND i.ts = g.ts
        WHERE g.load IS NULL GROUP BY i.series, i.island""",
    "filled": """
        SELECT k.series, k.ts, local_ts,
               CASE WHEN load IS NOT NULL THEN load
                    WHEN lpv IS NOT NULL AND lnv IS NOT NULL THEN lpv + (lnv - lpv)
                      * (date_diff('hour', lp, k.ts) / date_diff('hour', lp, ln)::DOUBLE)
                    ELSE coalesce(lpv, lnv) END AS load,
               CASE WHEN temp_c IS NOT NULL THEN temp_c
                    WHEN tpv IS NOT NULL AND tnv IS NOT NULL THEN tpv + (tnv - tpv)
                      * (date_diff('hour', tp, k.ts) / date_diff('hour', tp, tn)::DOUBLE)
                    ELSE coalesce(tpv, tnv) END AS temp_c,
               CAST(load IS NULL AS BIGINT) AS imputed,
               CAST(temp_c IS NULL AS BIGINT) AS temp_imputed,
               CASE WHEN load IS NULL THEN r.gap_hours ELSE 0 END AS gap_hours
        FROM looked k LEFT JOIN runs r ON r.series = k.series AND k.ts >= r.gap_start
             AND k.ts < r.gap_start + to_hours(r.gap_hours)""",
    "bad_dates": """
        SELECT DISTINCT series, CAST(local_ts AS DATE) AS d FROM filled WHERE gap_hours > 6""",
    "quarantined": """
        SELECT f.*, CAST(b.d IS NOT NULL AS BIGINT) AS bad_day
        FROM filled f LEFT JOIN bad_dates b ON f.series = b.series AND CAST(f.local_ts AS DATE) = b.d""",
    "medians": """
        SELECT series, month(local_ts) AS m, hour(local_ts) AS h, median(load) AS med, count(*) AS n
        FROM quarantined GROUP BY ALL""",
    "bands": """
        SELECT q.series, m, h, any_value(med) AS med, median(abs(q.load - med)) AS mad, any_value(n) AS n
        FROM quarantined q JOIN medians c ON q.series = c.series AND month(q.local_ts) = m AND hour(q.local_ts) = h
        GROUP BY 1, 2, 3""",
    "annotated": """
        SELECT q.series, q.ts, q.local_ts, q.gap_hours, q.temp_c, q.imputed, q.bad_day, q.temp_imputed,
               CAST(load < med - 5 * mad OR load > med + 5 * mad OR load <= 0 AS BIGINT) AS clipped,
               greatest(least(load, med + 5 * mad), med - 5 * mad) AS load
        FROM quarantined q JOIN bands b ON q.series = b.series AND month(q.local_ts) = m AND hour(q.local_ts) = h""",
    "clean": """
        SELECT series, ts, load, temp_c, imputed, clipped, bad_day, temp_imputed, local_ts FROM annotated""",
    # Federal holidays as a calendar: fixed dates with their weekend shift, and nth weekdays.
    "years": "SELECT unnest(generate_series(2014, 2020)) AS y",
    "fixed_holidays": """
        SELECT make_date(y, m, d) AS d FROM years, (VALUES (1, 1), (7, 4), (11, 11), (12, 25)) v(m, d)""",
    "monday_holidays": """
        SELECT (SELECT list(x ORDER BY x)[nth] FROM
                  (SELECT CAST(unnest(generate_series(make_date(y, m, 1), make_date(y, m, 28) + 3, INTERVAL 1 DAY)) AS DATE) AS x)
                WHERE isodow(x) = w AND month(x) = m) AS d
        FROM years, (VALUES (1, 1, 3), (2, 1, 3), (5, 1, -1), (9, 1, 1), (10, 1, 2), (11, 4, 4)) v(m, w, nth)""",
    "holidays": """
        SELECT d FROM fixed_holidays
        UNION SELECT d - 1 FROM fixed_holidays WHERE isodow(d) = 6
        UNION SELECT d + 1 FROM fixed_holidays WHERE isodow(d) = 7
        UNION SELECT d FROM monday_holidays""",
    "lagged": """
        SELECT *, lag(load, 24) OVER w AS lag_24, lag(load, 48) OVER w AS lag_48,
               lag(load, 168) OVER w AS lag_168, lag(temp_c, 24) OVER w AS temp_lag24,
               CASE WHEN count(*) OVER w24 = 24 THEN avg(load) OVER w24 END AS m24,
               CASE WHEN count(*) OVER w24 = 24 THEN stddev_samp(load) OVER w24 END AS s24,
               CASE WHEN count(*) OVER w168 = 168 THEN avg(load) OVER w168 END AS m168,
               CASE WHEN count(*) OVER w168 = 168 THEN max(load) OVER w168 END AS x168,
               date_trunc('day', ts - INTERVAL 5 HOUR) + INTERVAL 4 HOUR AS cutoff_ts
        FROM clean
        WINDOW w AS (PARTITION BY series ORDER BY ts),
               w24 AS (PARTITION BY series ORDER BY ts ROWS 23 PRECEDING),
               w168 AS (PARTITION BY series ORDER BY ts ROWS 167 PRECEDING)""",
    "features": """
        SELECT a.series, a.ts, a.lag_24, a.lag_48, a.lag_168,
               c.m24 AS roll24_mean, c.s24 AS roll24_std, c.m168 AS roll168_mean, c.x168 AS roll168_max,
               sin(2 * pi() * hour(a.local_ts) / 24) AS hour_sin, cos(2 * pi() * hour(a.local_ts) / 24) AS hour_cos,
               sin(2 * pi() * (isodow(a.local_ts) - 1) / 7) AS dow_sin,
               cos(2 * pi() * (isodow(a.local_ts) - 1) / 7) AS dow_cos,
               sin(2 * pi() * month(a.local_ts) / 12) AS month_sin, cos(2 * pi() * month(a.local_ts) / 12) AS month_cos,
               CAST(isodow(a.local_ts) >= 6 AS INTEGER) AS is_weekend,
               CAST(CAST(a.local_ts AS DATE) IN (SELECT d FROM holidays) AS INTEGER) AS is_holiday,
               a.temp_c AS temp, a.temp_lag24, greatest(18 - a.temp_c, 0) AS hdd, greatest(a.temp_c - 24, 0) AS cdd,
               a.load AS y, a.cutoff_ts, CAST(date_diff('hour', a.cutoff_ts, a.ts) AS INTEGER) AS lead,
               CAST(a.ts - INTERVAL 5 HOUR AS DATE) AS op_date, a.bad_day,
               CAST(hour(a.local_ts) AS INTEGER) AS local_hour, CAST(month(a.local_ts) AS INTEGER) AS local_month,
               CAST(a.local_ts AS DATE) AS local_date
        FROM lagged a LEFT JOIN lagged c ON a.series = c.series AND a.cutoff_ts = c.ts""",
    "eligible": f"""
        SELECT series, op_date FROM features GROUP BY ALL
        HAVING count(*) = 24 AND max(bad_day) = 0 AND bool_and({_PRESENT})""",
    "candidates": """
        SELECT series, CAST(max(op_date) - CAST(7 * i AS INTEGER) AS DATE) AS op_date
        FROM eligible, generate_series(0, 51) t(i) GROUP BY series, i""",
    "folds": """
        SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY op_date) AS INTEGER) AS fold,
               op_date AS target_date, CAST(op_date AS TIMESTAMP) + INTERVAL 4 HOUR AS cutoff
        FROM candidates SEMI JOIN eligible USING (series, op_date)""",
    "dense_candidates": """
        SELECT series, CAST(max(op_date) - CAST(2 * i AS INTEGER) AS DATE) AS op_date
        FROM eligible, generate_series(0, 181) t(i) GROUP BY series, i""",
    "dense_folds": """
        SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY op_date) AS INTEGER) AS fold,
               op_date AS target_date, CAST(op_date AS TIMESTAMP) + INTERVAL 4 HOUR AS cutoff
        FROM dense_candidates SEMI JOIN eligible USING (series, op_date)""",
    "all_folds": """
        SELECT 'weekly' AS protocol, * FROM folds UNION ALL SELECT 'dense', * FROM dense_folds""",
    "results": """
        SELECT f.series, m.model, protocol, fold, target_date, f.ts, f.lead, f.local_hour AS hour,
               f.local_month AS month, f.is_weekend, f.y AS y_true, p.y AS y_pred
        FROM all_folds d JOIN features f ON f.series = d.series AND f.op_date = d.target_date
        CROSS JOIN (VALUES ('naive', 24), ('snaive', 168)) m(model, back)
        LEFT JOIN features p ON p.series = f.series AND p.ts = f.ts - to_hours(m.back)""",
    "maes": """
        SELECT series, model, fold, avg(abs(y_true - y_pred)) AS fold_mae, count(*) AS n_rows
        FROM results WHERE protocol = 'weekly' GROUP BY ALL""",
    "diffs": """
        SELECT series, p.a AS model_a, p.b AS model_b, fold, x.fold_mae AS ma, y.fold_mae AS mb,
               x.fold_mae - y.fold_mae AS d
        FROM (VALUES ('naive', 'snaive'), ('snaive', 'naive'), ('naive', 'naive')) p(a, b)
        JOIN maes x ON x.model = p.a JOIN maes y USING (series, fold) WHERE y.model = p.b""",
    "ranked": """
        SELECT x.series, x.model_a, x.model_b, x.fold, any_value(x.d) AS d,
               count(*) FILTER (abs(o.d) < abs(x.d)) + (count(*) FILTER (abs(o.d) = abs(x.d)) + 1) / 2.0 AS rk,
               count(*) FILTER (abs(o.d) = abs(x.d)) AS ties
        FROM diffs x JOIN diffs o ON o.series = x.series AND o.model_a = x.model_a AND o.model_b = x.model_b
        WHERE x.d <> 0 AND o.d <> 0 GROUP BY ALL""",
    "signed": """
        SELECT series, model_a, model_b, count(*) AS n,
               least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS w,
               sum(ties * ties - 1) AS tt
        FROM ranked GROUP BY ALL""",
    "comparison": """
        SELECT series, model_a, model_b, avg(ma) AS mae_a, avg(mb) AS mae_b, avg(d) AS mean_diff,
               count(*) FILTER (d < 0) AS a_wins_folds, count(*) AS n_folds,
               CAST(coalesce(any_value(w), 0) AS DOUBLE) AS wilcoxon_stat,
               coalesce((any_value(w) - any_value(n) * (any_value(n) + 1) / 4.0)
                 / sqrt((any_value(n) * (any_value(n) + 1) * (2 * any_value(n) + 1) - any_value(tt) / 2.0) / 24), 0) AS z
        FROM diffs LEFT JOIN signed USING (series, model_a, model_b) GROUP BY ALL""",
    "daily": """
        SELECT series, CAST(ts AS DATE) AS day, avg(load) AS load FROM clean GROUP BY ALL""",
}

QUERIES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    QUERIES[name] = sql


def render(sql: str) -> str:
    """Put the needed expressions in front of a query."""
    need: list[str] = []

    def visit(text: str) -> None:
        for cte in CTES:
            if cte not in need and re.search(rf"(\b(FROM|JOIN)|,)\s*{cte}\b", text):
                visit(CTES[cte])
                if cte not in need:
                    need.append(cte)

    visit(sql)
    # Two tables of the driver share no name with the expressions, so order is all that matters.
    head = ", ".join(f"{c} AS MATERIALIZED ({CTES[c].strip()})" for c in need)
    own = re.match(r"\s*WITH RECURSIVE\b", sql)
    if own and need:
        return f"WITH RECURSIVE {head}, {sql[own.end():]}"
    return f"WITH {head} {sql}" if need else sql


# ---------------------------------------------------------------- sources
oracle("a1_load_csv", f"SELECT series, wall, {_r('load')} FROM raw_load")
oracle("a2_weather_csv", f"SELECT datetime_utc, {_r('temp_c')} FROM raw_weather")
oracle("a3_weather_json", f"""
    SELECT datetime_utc, {_r('temp_c')} FROM (
      SELECT TIMESTAMP '2016-01-01' + to_hours(CAST((l_orderkey * 7 + l_linenumber * 1237) % 9600 AS INTEGER)) AS datetime_utc,
             first(l_quantity / 2 - 5 ORDER BY l_orderkey, l_linenumber, l_quantity) AS temp_c
      FROM lineitem GROUP BY 1)""")
oracle("a4_weather_window", """
    SELECT CAST(min(wall) - INTERVAL 1 DAY AS DATE) AS start_date, CAST(max(wall) + INTERVAL 1 DAY AS DATE) AS end_date
    FROM raw_load""")
oracle("a5_request_chunks", """
    SELECT greatest(s, make_date(y, 1, 1)) AS chunk_start, least(e, make_date(y + 1, 12, 31)) AS chunk_end
    FROM (SELECT CAST(min(wall) - INTERVAL 1 DAY AS DATE) AS s, CAST(max(wall) + INTERVAL 1 DAY AS DATE) AS e FROM raw_load),
         (SELECT unnest(generate_series(1990, 2040)) AS y)
    WHERE y >= year(s) AND y <= year(e) AND (y - year(s)) % 2 = 0""")
oracle("a6_raw_profile", f"""
    SELECT source, n_rows, first_date, last_date, {_r('min_value', 'max_value')} FROM (
      SELECT 'load' AS source, count(*) AS n_rows, CAST(min(wall) AS DATE) AS first_date, CAST(max(wall) AS DATE) AS last_date,
             min(load) AS min_value, max(load) AS max_value FROM raw_load
      UNION ALL SELECT 'weather', count(*), CAST(min(datetime_utc) AS DATE), CAST(max(datetime_utc) AS DATE),
             min(temp_c), max(temp_c) FROM raw_weather)""")
_CLEAN = f"SELECT series, ts, {_r('load', 'temp_c')}, imputed, clipped, bad_day, temp_imputed FROM clean"
_RESULT_COLS = f"series, model, protocol, fold, target_date, ts, lead, hour, month, is_weekend, {_r('y_true', 'y_pred')}"
_SUMMARY = f"""
    SELECT series, model, {_r('mape', 'rmse')}, round(mase, 6) + 0.0 AS mase, {_r('mae')}, n_folds, n_points FROM (
      SELECT series, model, {_ERRORS}, count(DISTINCT fold) AS n_folds, count(*) AS n_points
      FROM results WHERE protocol = 'weekly' GROUP BY ALL)
    JOIN (SELECT m.series, m.model, sum(m.fold_mae) / sum(r.fold_mae) AS mase
          FROM maes m JOIN maes r ON r.series = m.series AND r.fold = m.fold AND r.model = 'snaive' GROUP BY ALL)
      USING (series, model)"""
oracle("a7_parquet_round_trip", _CLEAN)
oracle("a8_result_store", f"SELECT {_RESULT_COLS} FROM results WHERE protocol = 'dense' AND model = 'naive'")
oracle("a9_summary_csv", _SUMMARY)

# ---------------------------------------------------------------- cleaning
oracle("b1_average_duplicates", f"SELECT series, wall, {_r('load')}, n_rows FROM by_wall")
oracle("b2_localize", f"SELECT series, wall, ts, {_r('load')} FROM hourly")
oracle("b3_utc_merge", f"SELECT series, ts, {_r('load')} FROM hourly WHERE ts IS NOT NULL")
oracle("b4_regular_grid", f"SELECT series, ts, {_r('load')} FROM grid")
oracle("b5_gap_runs", "SELECT * FROM runs")
oracle("b6_interpolate", f"SELECT series, ts, {_r('load', 'temp_c')} FROM filled")
oracle("b7_imputed_flag", "SELECT series, ts, imputed FROM filled")
oracle("b8_quarantine", "SELECT series, ts, gap_hours, bad_day FROM quarantined")
oracle("b9_month_hour_mad", f"""
    SELECT series, CAST(m AS INTEGER) AS local_month, CAST(h AS INTEGER) AS local_hour,
           round(med, 6) AS median, {_r('mad')}, n FROM bands""")
oracle("b10_winsorize", f"SELECT series, ts, {_r('load')}, clipped FROM annotated")
oracle("b11_weather_first", f"SELECT datetime_utc, {_r('temp_c')} FROM weather")
oracle("b12_attach_weather", f"SELECT series, ts, {_r('temp_c')}, temp_imputed FROM filled")
oracle("b13_validate", """
    SELECT series, count(*) AS n_rows, count(*) FILTER (load IS NULL) AS load_null,
           count(*) FILTER (load NOT BETWEEN 10000 AND 65000) AS load_range,
           count(*) FILTER (temp_c IS NULL) AS temp_null,
           count(*) FILTER (temp_c NOT BETWEEN -40 AND 50) AS temp_range,
           count(*) FILTER (NOT (imputed IN (0, 1) AND clipped IN (0, 1) AND bad_day IN (0, 1) AND temp_imputed IN (0, 1))) AS flag_domain,
           count(*) - count(DISTINCT ts) AS duplicate_ts
    FROM clean GROUP BY 1""")
oracle("b14_continuity", """
    SELECT series, count(*) FILTER (step IS NOT NULL AND step <> INTERVAL 1 HOUR) AS grid_holes
    FROM (SELECT series, ts - lag(ts) OVER (PARTITION BY series ORDER BY ts) AS step FROM clean) GROUP BY 1""")
oracle("b15_reconciliation", """
    SELECT series, step, rule, CAST(rows_affected AS BIGINT) AS rows_affected, note FROM (
      SELECT series, sum(n_rows) AS raw, count(*) AS walls, count(*) FILTER (ts IS NULL) AS skipped FROM hourly GROUP BY 1)
    JOIN (
      SELECT series, count(*) AS final, sum(imputed) AS created, count(*) FILTER (gap_hours BETWEEN 1 AND 6) AS short_hours,
             count(*) FILTER (gap_hours > 6) AS long_hours, max(gap_hours) FILTER (gap_hours BETWEEN 1 AND 6) AS short_max,
             sum(bad_day) AS bad_rows, count(DISTINCT CAST(local_ts AS DATE)) FILTER (bad_day = 1) AS bad_dates,
             sum(clipped) AS clipped, count(*) FILTER (temp_imputed = 0) AS matched
      FROM annotated GROUP BY 1) USING (series),
    LATERAL (VALUES
      (0, '0. Raw rows read', raw, 'raw load'),
      (1, '1. DST fall-back / duplicate stamps', raw - walls, format('averaged; {:,} -> {:,} rows', CAST(raw AS BIGINT), walls)),
      (2, '1. DST spring-forward stamps', skipped, 'non-existent local time, dropped'),
      (3, '2. Reindex to full hourly grid', created, format('{:,} slots, missing hours created as null', final)),
      (4, '3. Short gaps (<=6h) interpolated', short_hours, format('max {}h', coalesce(short_max, 0))),
      (5, '3. Long gaps (>6h) -> bad_day', bad_rows, format('{}h missing, {} local days quarantined', long_hours, bad_dates)),
      (6, '4. Outliers winsorized', clipped, 'outside the band or not positive'),
      (7, '5. Weather joined', matched, format('{} hours interpolated', final - matched)),
      (8, '5. Validation', final, 'passed')) v(step, rule, rows_affected, note)""")
oracle("b16_clean", _CLEAN)
oracle("b17_clean_profile", f"""
    SELECT series, n_rows, usable_rows, first_utc, last_utc, first_local, last_local,
           {_r('load_mean', 'load_min', 'load_max', 'temp_c_mean', 'temp_c_min', 'temp_c_max')},
           CAST(imputed AS BIGINT) AS imputed, CAST(clipped AS BIGINT) AS clipped, CAST(bad_day AS BIGINT) AS bad_day FROM (
      SELECT series, count(*) AS n_rows, count(*) FILTER (bad_day = 0) AS usable_rows, min(ts) AS first_utc, max(ts) AS last_utc,
             arg_min(local_ts, ts) AS first_local, arg_max(local_ts, ts) AS last_local,
             avg(load) AS load_mean, min(load) AS load_min, max(load) AS load_max,
             avg(temp_c) AS temp_c_mean, min(temp_c) AS temp_c_min, max(temp_c) AS temp_c_max,
             sum(imputed) AS imputed, sum(clipped) AS clipped, sum(bad_day) AS bad_day
      FROM clean GROUP BY 1)""")

# ---------------------------------------------------------------- features
oracle("c1_op_day_start", """
    SELECT series, ts, date_trunc('day', ts - INTERVAL 5 HOUR) + INTERVAL 5 HOUR AS op_day_start FROM clean""")
oracle("c2_cutoff", "SELECT series, ts, cutoff_ts FROM lagged")
oracle("c3_op_date", "SELECT series, ts, CAST(ts - INTERVAL 5 HOUR AS DATE) AS op_date FROM clean")
oracle("c4_target_hours", """
    SELECT series, op_date, unnest(generate_series(CAST(op_date AS TIMESTAMP) + INTERVAL 5 HOUR,
             CAST(op_date AS TIMESTAMP) + INTERVAL 28 HOUR, INTERVAL 1 HOUR)) AS ts
    FROM (SELECT DISTINCT series, op_date FROM features)""")
oracle("c5_cutoff_of_op_date", """
    SELECT DISTINCT series, op_date, CAST(op_date AS TIMESTAMP) + INTERVAL 4 HOUR AS cutoff FROM features""")
oracle("c6_lead", "SELECT series, ts, CAST(date_diff('hour', cutoff_ts, ts) AS INTEGER) AS lead FROM lagged")
oracle("c7_lags", f"SELECT series, ts, {_r('lag_24', 'lag_48', 'lag_168')} FROM lagged")
oracle("c8_rolling", f"SELECT series, ts, {_r('roll24_mean', 'roll24_std', 'roll168_mean', 'roll168_max')} FROM features")
oracle("c9_cyclical", f"SELECT series, ts, {_r('hour_sin', 'hour_cos', 'dow_sin', 'dow_cos', 'month_sin', 'month_cos')} FROM features")
oracle("c10_weekend", "SELECT series, ts, is_weekend FROM features")
oracle("c11_holiday", "SELECT series, ts, local_date, is_holiday FROM features")
oracle("c12_weather_features", f"SELECT series, ts, {_r('temp', 'temp_lag24', 'hdd', 'cdd')} FROM features")
oracle("c13_bookkeeping", "SELECT series, ts, local_hour, local_month, local_date, bad_day FROM features")
_REAL = [c for c in FEATURES if c not in ("is_weekend", "is_holiday")]
oracle("c14_features", f"""
    SELECT series, ts, {_r(*_REAL)}, is_weekend, is_holiday, {_r('y')}, cutoff_ts, lead, op_date, bad_day,
           local_hour, local_month, local_date FROM features""")
oracle("c15_usable", f"SELECT series, ts FROM features WHERE bad_day = 0 AND {_PRESENT}")
oracle("c16_feature_profile", f"""
    SELECT series, count(*) AS n_rows, count(*) FILTER (bad_day = 0 AND {_PRESENT}) AS usable_rows,
           min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT op_date) AS op_dates FROM features GROUP BY 1""")
oracle("c17_leakage_contract", """
    SELECT series, fold, feature, CASE WHEN feature LIKE 'roll%' THEN cutoff
             ELSE cutoff + to_hours(24 - back) END AS last_read,
           feature IN ('temp', 'hdd', 'cdd') AS exempt,
           feature NOT LIKE 'roll%' AND 24 - back > 0 AND feature NOT IN ('temp', 'hdd', 'cdd') AS violation
    FROM folds, (VALUES ('lag_24', 24), ('lag_48', 48), ('lag_168', 168), ('roll24_mean', 0), ('roll24_std', 0),
      ('roll168_mean', 0), ('roll168_max', 0), ('temp_lag24', 24), ('temp', 0), ('hdd', 0), ('cdd', 0)) v(feature, back)""")
oracle("c18_fourier", f"""
    SELECT series, ts, {_r(*FOURIER_NAMES)} FROM (
      SELECT series, ts, {_FOURIER} FROM (SELECT series, ts, date_diff('hour', TIMESTAMP '2000-01-01', ts) AS h FROM clean))""")
_EXOG = "hour_sin, hour_cos, dow_sin, dow_cos, temp, is_holiday"
CTES["seq_days"] = """
    SELECT series, op_date, min(ts) AS first FROM features WHERE bad_day = 0 GROUP BY ALL
    HAVING count(*) = 24 AND count(y) = 24"""
CTES["seq_history"] = """
    SELECT d.series, d.op_date, count(f.y) AS n,
           sum(f.y * (date_diff('hour', d.first, f.ts) + 169)) AS s
    FROM seq_days d JOIN features f ON f.series = d.series AND f.ts < d.first AND f.ts >= d.first - INTERVAL 168 HOUR
    GROUP BY ALL"""
CTES["seq_target"] = """
    SELECT d.series, d.op_date, sum(f.y * lead) AS t,
           sum(hour_sin * (6 * lead - 5) + hour_cos * (6 * lead - 4) + dow_sin * (6 * lead - 3)
             + dow_cos * (6 * lead - 2) + temp * (6 * lead - 1) + is_holiday * (6 * lead)) AS e
    FROM seq_days d JOIN features f ON f.series = d.series AND f.op_date = d.op_date GROUP BY ALL"""
oracle("c19_sequence_windows", """
    SELECT series, op_date, CAST(168 AS INTEGER) AS n_sequence, CAST(144 AS INTEGER) AS n_exog, CAST(24 AS INTEGER) AS n_target,
           round(s, 1) + 0.0 AS sequence_sum, round(e, 6) + 0.0 AS exog_sum, round(t, 1) + 0.0 AS target_sum
    FROM seq_history JOIN seq_target USING (series, op_date) WHERE n = 168""")
oracle("c20_masked_target", "SELECT series, ts, CASE WHEN bad_day = 0 THEN round(y, 6) + 0.0 END AS y FROM features")
oracle("c21_capped_window", """
    SELECT d.series, fold, CAST(count(*) AS BIGINT) AS n_train, CAST(count(*) FILTER (bad_day = 0) AS BIGINT) AS n_known
    FROM folds d JOIN features f ON f.series = d.series AND f.ts <= cutoff AND f.ts >= cutoff - to_hours(4383)
    GROUP BY ALL""")
oracle("c21_default_windows", " UNION ALL ".join(f"""
    SELECT d.series, fold, '{_m}' AS model, CAST(count(*) AS BIGINT) AS n_train, CAST(count(*) FILTER (bad_day = 0) AS BIGINT) AS n_known
    FROM folds d JOIN features f ON f.series = d.series AND f.ts <= cutoff AND f.ts >= cutoff - to_hours({_h})
    GROUP BY ALL""" for _m, _h in (("sarima", 17532), ("prophet", 26298), ("lstm", 52596), ("lgbm", 24 * 36525))))
CTES["seq_fold_days"] = """
    SELECT d.series, d.fold, s.op_date, s.first FROM folds d
    JOIN (SELECT * FROM seq_days JOIN seq_history USING (series, op_date) WHERE n = 168) s
      ON s.series = d.series AND s.first + INTERVAL 23 HOUR <= d.cutoff
     AND s.first - INTERVAL 168 HOUR >= d.cutoff - to_minutes(394470)"""
oracle("c22_standardisation", """
    SELECT series, fold, pos, n, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std FROM (
      SELECT d.series, fold, CAST(0 AS INTEGER) AS pos, count(*) AS n, avg(y) AS mean, stddev_pop(y) + 1e-8 AS std
      FROM seq_fold_days d JOIN features f ON f.series = d.series AND f.op_date = d.op_date GROUP BY ALL
      UNION ALL
      SELECT d.series, fold, CAST(6 * (lead - 1) + v.i AS INTEGER), count(*), avg(v.x), stddev_pop(v.x) + 1e-8
      FROM seq_fold_days d JOIN features f ON f.series = d.series AND f.op_date = d.op_date,
      LATERAL (VALUES (1, hour_sin), (2, hour_cos), (3, dow_sin), (4, dow_cos), (5, temp), (6, CAST(is_holiday AS DOUBLE))) v(i, x)
      GROUP BY ALL)""")

# ---------------------------------------------------------------- folds and backtest
oracle("d1_eligible_dates", "SELECT * FROM eligible")
oracle("d2_folds", "SELECT * FROM folds")
oracle("d3_skipped_dates", """
    SELECT series, op_date FROM (
      SELECT series, CAST(max(op_date) - CAST(i AS INTEGER) AS DATE) AS op_date FROM eligible, generate_series(0, 363) t(i) GROUP BY series, i)
    ANTI JOIN eligible USING (series, op_date)""")
oracle("d4_weekday_coverage", """
    SELECT series, count(*) AS n_folds, count(DISTINCT isodow(target_date)) AS n_weekdays,
           count(DISTINCT isodow(target_date)) = 1 AS single_weekday FROM folds GROUP BY 1""")
oracle("d5_dense_folds", "SELECT * FROM dense_folds")
oracle("d6_fold_invariants", """
    SELECT series, count(*) AS n_folds, 0::BIGINT AS wrong_length, 0::BIGINT AS not_after_cutoff, 0::BIGINT AS overlap,
           0::BIGINT AS wrong_growth, 0::BIGINT AS off_step FROM folds GROUP BY 1""")
oracle("d7_training_slice", """
    SELECT d.series, fold, count(*) AS n_train, max(ts) AS last_ts, round(sum(y), 1) AS sum_y
    FROM folds d JOIN features f ON f.series = d.series AND f.ts <= d.cutoff GROUP BY ALL""")
oracle("d8_target_slice", f"""
    SELECT f.series, fold, ts, lead, {_r(*_REAL)}, is_weekend, is_holiday
    FROM folds d JOIN features f ON f.series = d.series AND f.op_date = d.target_date""")
for _n, _m in (("d9_naive", "naive"), ("d10_seasonal_naive", "snaive")):
    oracle(_n, f"SELECT series, fold, ts, {_r('y_pred')} FROM results WHERE protocol = 'weekly' AND model = '{_m}'")
oracle("d11_missing_history", """
    SELECT series, fold, count(*) FILTER (y_pred IS NULL) AS n_missing, count(*) AS n_rows
    FROM results WHERE protocol = 'weekly' AND model = 'snaive' GROUP BY ALL""")
oracle("d13_holdout", f"""
    SELECT series, lead, ts, CASE WHEN least(90, n // 5) >= 10 THEN r <= least(90, n // 5) ELSE false END AS is_validation
    FROM (SELECT series, lead, ts, count(*) OVER (PARTITION BY series, lead) AS n,
                 row_number() OVER (PARTITION BY series, lead ORDER BY ts DESC) AS r
          FROM features WHERE bad_day = 0 AND {_PRESENT})""")
CTES["lead_rows"] = f"""
    SELECT f.series, fold, lead, count(*) AS n
    FROM folds d JOIN features f ON f.series = d.series AND f.ts <= d.cutoff WHERE bad_day = 0 AND {_PRESENT} GROUP BY ALL"""
oracle("d12_training_sizes", """
    SELECT r.series, r.fold, r.lead, d.cutoff + to_hours(CAST(r.lead AS INTEGER)) AS ts,
           CAST(n - v AS INTEGER) AS n_train, CAST(v AS INTEGER) AS n_valid
    FROM (SELECT *, CASE WHEN least(90, n // 5) >= 10 THEN least(90, n // 5) ELSE 0 END AS v FROM lead_rows) r
    JOIN folds d ON d.series = r.series AND d.fold = r.fold""")
oracle("a10_artifact_round_trip", f"""
    SELECT series, 2 AS artifact_version, 'lgbm' AS model, trained_through, 42 AS seed, n_models, n_train, n_valid, history_rows
    FROM (SELECT series, max(ts) AS trained_through, count(*) AS history_rows FROM clean GROUP BY 1)
    JOIN (SELECT series, count(*) AS n_models, CAST(sum(n - v) AS BIGINT) AS n_train, CAST(sum(v) AS BIGINT) AS n_valid
          FROM (SELECT series, lead, count(*) AS n, CASE WHEN least(90, count(*) // 5) >= 10 THEN least(90, count(*) // 5) ELSE 0 END AS v
                FROM features WHERE bad_day = 0 AND {_PRESENT} GROUP BY ALL) GROUP BY 1) USING (series)""")
oracle("d24_forecast_replay", """
    SELECT f.series, model, count(*) AS n_hours, 0::BIGINT AS moved_hours
    FROM (SELECT series, max(target_date) AS op_date FROM folds GROUP BY 1) d JOIN features f ON f.series = d.series AND f.op_date = d.op_date
    CROSS JOIN (SELECT unnest(['naive', 'snaive', 'prophet', 'lgbm']) AS model) GROUP BY ALL""")
oracle("d25_permutation", f"""
    SELECT series, count(y) AS n, round(sum(y), 1) AS sum_y, {_r('min_y', 'max_y')}
    FROM (SELECT *, min(y) OVER (PARTITION BY series) AS min_y, max(y) OVER (PARTITION BY series) AS max_y FROM features) GROUP BY series, min_y, max_y""")
CTES["cut_marks"] = """
    SELECT DISTINCT series, m FROM (SELECT series, cutoff AS m FROM folds
      UNION ALL SELECT series, cutoff - to_hours(17532) - INTERVAL 1 MICROSECOND FROM folds)"""
CTES["known_rows"] = """
    SELECT series, ts, CASE WHEN bad_day = 0 THEN y END AS y, date_diff('hour', TIMESTAMP '2000-01-01', ts) AS h FROM features"""
CTES["known_lags"] = """
    SELECT *, lag(y, 1) OVER (PARTITION BY series ORDER BY ts) AS y1, lag(y, 2) OVER (PARTITION BY series ORDER BY ts) AS y2,
           (SELECT count(*) FROM cut_marks c WHERE c.series = k.series AND c.m < k.ts) AS seg
    FROM known_rows k"""
oracle("d15_harmonic_moments", """
    SELECT series, CAST(seg AS INTEGER) AS seg, CAST(count(y) AS BIGINT) AS n, round(sum(y), 3) + 0.0 AS sum_y,
           round(sum(y * sin(2 * pi() * h / 24)), 3) + 0.0 AS y_sin24,
           round(sum(y * cos(2 * pi() * 3 * h / 168)), 3) + 0.0 AS y_cos168,
           CAST(count(y + y1 + y2) AS BIGINT) AS n_lagged,
           round(sum(y * y1 + 0 * y2) / 1000000, 3) + 0.0 AS y_y1, round(sum(y * y2 + 0 * y1) / 1000000, 3) + 0.0 AS y_y2
    FROM known_lags k WHERE seg > 0 AND EXISTS (SELECT 1 FROM cut_marks c WHERE c.series = k.series AND c.m >= k.ts)
    GROUP BY series, seg""")
oracle("d17_guards", f"""
    SELECT p.series, p.fold, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high,
           CAST(count(y_pred) - 24 AS BIGINT) AS missing_points, CAST(count(*) FILTER (NOT isfinite(y_pred)) AS BIGINT) AS non_finite,
           count(*) FILTER (y_pred < low OR y_pred > high) AS implausible
    FROM ({_WEEKLY}) p JOIN (
      SELECT d.series, fold, min(y) * 0.25 AS low, max(y) * 4 AS high
      FROM folds d JOIN features f ON f.series = d.series AND f.ts <= d.cutoff GROUP BY ALL) b
    ON p.series = b.series AND p.fold = b.fold WHERE p.model = 'naive' GROUP BY p.series, p.fold, low, high""")
oracle("d18_backtest", f"SELECT {_RESULT_COLS} FROM results WHERE protocol = 'weekly' AND model = 'snaive'")
oracle("d19_multi_model", f"SELECT {_RESULT_COLS} FROM results WHERE protocol = 'weekly'")
CTES["servable"] = f"""
    SELECT series, op_date FROM features GROUP BY ALL HAVING count(*) = 24 AND count(*) FILTER ({_PRESENT}) > 0"""
CTES["coverage"] = """
    SELECT e.series, trained_through, first_date, last_date
    FROM (SELECT series, max(ts) AS trained_through FROM features GROUP BY 1) e
    LEFT JOIN (SELECT series, min(op_date) AS first_date, max(op_date) AS last_date FROM servable GROUP BY 1) USING (series)"""
CTES["requests"] = """
    SELECT 'S' || lpad(CAST(o_orderkey // 5000 AS VARCHAR), 8, '0') AS series,
           CASE WHEN o_orderkey % 50 = 0 THEN o_orderpriority ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS date
    FROM orders UNION SELECT series, strftime(op_date, '%Y-%m-%d') FROM features"""
oracle("d22_forecast_dates", f"""
    SELECT q.series, q.date, CASE WHEN s.op_date IS NULL THEN 422 ELSE 200 END AS status,
           CASE WHEN TRY_CAST(q.date AS DATE) IS NULL THEN q.date || ' is not a date'
                WHEN s.op_date IS NULL THEN q.date || ' has no forecast: days with all inputs lie between '
                  || coalesce(CAST(first_date AS VARCHAR), 'none') || ' and ' || coalesce(CAST(last_date AS VARCHAR), 'none') END AS detail,
           'naive' AS model, trained_through,
           CASE WHEN s.op_date IS NOT NULL THEN strftime(f.ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS ts,
           CASE WHEN s.op_date IS NOT NULL THEN round_even(f.lag_24, 1) END AS mw
    FROM requests q LEFT JOIN coverage c ON c.series = q.series
    LEFT JOIN servable s ON s.series = q.series AND s.op_date = TRY_CAST(q.date AS DATE)
    LEFT JOIN features f ON f.series = s.series AND f.op_date = s.op_date""")
oracle("d23_coverage", "SELECT series, 'ok' AS status, 'naive' AS model, trained_through, first_date, last_date FROM coverage")
# The replay's answer is known beforehand: no load feature moves, and exactly the three exempt ones do.
oracle("d24_leakage_replay", """
    SELECT series, column_name, feature, CASE WHEN column_name = 'load' THEN 0::BIGINT ELSE moved END AS changed_hours
    FROM (SELECT series, max(cutoff) AS cutoff, max(target_date) AS target_date FROM folds GROUP BY 1) d,
      LATERAL (SELECT count(*) AS n, count(*) FILTER (f.hdd > 0) AS cold, count(*) FILTER (true) AS hot
               FROM features f WHERE f.series = d.series AND f.op_date = d.target_date) x,
      (VALUES ('load'), ('temp_c')) c(column_name),
      LATERAL (VALUES """ + ", ".join(
    f"('{c}', " + {"temp": "n", "hdd": "cold", "cdd": "hot"}.get(c, "0::BIGINT") + ")" for c in FEATURES
) + ") v(feature, moved)")

# ---------------------------------------------------------------- metrics and reports
_BASE = f"SELECT series, model, {_ERRORS}, count(*) AS n FROM results WHERE protocol = 'weekly' GROUP BY ALL"
for _n, _c in (("e1_mape", "mape"), ("e2_rmse", "rmse"), ("e3_mae", "mae")):
    oracle(_n, f"SELECT series, model, {_r(_c)} FROM ({_BASE})")
oracle("e4_fold_maes", f"SELECT series, model, fold, {_r('fold_mae')}, n_rows FROM maes")
oracle("e5_mase", """
    SELECT m.series, m.model, round(sum(m.fold_mae) / sum(r.fold_mae), 6) AS mase
    FROM maes m JOIN maes r ON r.series = m.series AND r.fold = m.fold AND r.model = 'snaive' GROUP BY ALL""")
oracle("e6_summarize", _SUMMARY)
oracle("e7_signed_rank", f"""
    SELECT series, model_a, model_b, {_r('mae_a', 'mae_b', 'mean_diff')}, a_wins_folds, n_folds, 0::BIGINT AS unmatched_folds,
           {_r('wilcoxon_stat', 'z')}, abs(z) > 1.959963984540054 AS significant_at_05 FROM comparison""")
CTES["maes12"] = """
    SELECT m.* FROM maes m JOIN folds d ON d.series = m.series AND d.fold = m.fold
    JOIN (SELECT series, max(op_date) AS last FROM eligible GROUP BY 1) e ON e.series = m.series
    WHERE d.target_date >= e.last - INTERVAL 77 DAY"""
for _n in ("diffs", "ranked", "signed", "comparison"):
    CTES[f"{_n}12"] = re.sub(r"\b(maes|diffs|ranked|signed)\b", r"\g<1>12", CTES[_n])
# The two-sided tail of the normal distribution by Simpson's rule, and of the exact one by counting the sets of ranks with each sum.
_NORMAL_P = """(SELECT greatest(0, 1 - sqrt(2 / pi()) * abs(z) / 6000 * sum(
    CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-((i * abs(z) / 2000) ** 2) / 2))) FROM generate_series(0, 2000) g(i))"""
_EXACT_P = """(SELECT least(1.0, 2 * sum(c) FILTER (s <= wilcoxon_stat) / sum(c)) FROM (
    WITH RECURSIVE ways AS (
        SELECT 0 AS k, 0 AS s, 1::DOUBLE AS c
        UNION ALL SELECT k + 1, s + b * (k + 1), sum(c) FROM ways CROSS JOIN (VALUES (0), (1)) v(b) WHERE k < 50 GROUP BY k, s + b * (k + 1))
    SELECT * FROM ways) w WHERE w.k = n_folds)"""
for _n, _t in (("e7_p_values", ""), ("e7_exact_p_values", "12")):
    oracle(_n, f"""
        SELECT series, model_a, model_b, {_r('mae_a', 'mae_b', 'mean_diff')}, a_wins_folds, n_folds, 0::BIGINT AS unmatched_folds,
               {_r('wilcoxon_stat', 'z')}, exact, round(p, 6) + 0.0 AS p_value, p < 0.05 AS significant_at_05
        FROM (SELECT *, CASE WHEN n = 0 THEN 1.0 WHEN exact THEN {_EXACT_P} ELSE {_NORMAL_P} END AS p
              FROM (SELECT c.*, coalesce(s.n, 0) AS n, c.n_folds <= 50 AND coalesce(s.tt, 0) = 0 AND coalesce(s.n, 0) = c.n_folds AS exact
                    FROM comparison{_t} c LEFT JOIN signed{_t} s ON s.series = c.series AND s.model_a = c.model_a AND s.model_b = c.model_b))""")
oracle("e8_grouped_errors", f"""
    SELECT series, lead, {_r('mape', 'rmse', 'mae')}, n FROM (
      SELECT series, lead, {_ERRORS}, count(*) AS n FROM results WHERE protocol = 'weekly' AND model = 'naive' GROUP BY ALL)""")
oracle("e9_build_summary", _SUMMARY)
oracle("e10_diagnostic", f"SELECT {_RESULT_COLS} FROM results WHERE model = 'naive' AND protocol = 'dense'")
_DENSE = "SELECT *, CASE WHEN is_weekend = 1 THEN 'weekend' ELSE 'weekday' END AS day_type FROM results WHERE model = 'naive' AND protocol = 'dense'"
CTES["error_groups"] = f"""
    SELECT series, 'by_hour' AS "table", hour, NULL::VARCHAR AS day_type, NULL::INTEGER AS month, {_ERRORS}, count(*) AS n FROM ({_DENSE}) GROUP BY series, hour
    UNION ALL SELECT series, 'by_day_type', NULL, day_type, NULL, {_ERRORS}, count(*) FROM ({_DENSE}) GROUP BY series, day_type
    UNION ALL SELECT series, 'by_month', NULL, NULL, month, {_ERRORS}, count(*) FROM ({_DENSE}) GROUP BY series, month"""
oracle("e11_error_tables", f"""
    SELECT series, "table", coalesce(CAST(hour AS VARCHAR), day_type, CAST(month AS VARCHAR)) AS level,
           {_r('mape', 'rmse', 'mae')}, n FROM error_groups""")
oracle("e12_findings", f"""
    SELECT series, worst_hour, best_hour, {_r('worst_hour_mape', 'best_hour_mape')}, worst_month, best_month,
           {_r('worst_month_mape', 'best_month_mape', 'weekday_mape', 'weekend_mape')},
           round(worst_hour_mape / nullif(best_hour_mape, 0), 6) + 0.0 AS hour_ratio,
           round(abs(weekend_mape - weekday_mape) / nullif(least(weekend_mape, weekday_mape), 0), 6) + 0.0 AS day_type_gap,
           CASE WHEN abs(weekend_mape - weekday_mape) / nullif(least(weekend_mape, weekday_mape), 0) IS NULL THEN 'not measured'
                WHEN abs(weekend_mape - weekday_mape) / least(weekend_mape, weekday_mape) < 0.05 THEN 'day type barely matters'
                WHEN weekend_mape > weekday_mape THEN 'weekends are harder' ELSE 'weekdays are harder' END AS day_type_verdict
    FROM (SELECT series,
      first(hour ORDER BY mape DESC, hour) FILTER ("table" = 'by_hour') AS worst_hour,
      first(hour ORDER BY mape, hour) FILTER ("table" = 'by_hour') AS best_hour,
      max(mape) FILTER ("table" = 'by_hour') AS worst_hour_mape, min(mape) FILTER ("table" = 'by_hour') AS best_hour_mape,
      first(month ORDER BY mape DESC, month) FILTER ("table" = 'by_month') AS worst_month,
      first(month ORDER BY mape, month) FILTER ("table" = 'by_month') AS best_month,
      max(mape) FILTER ("table" = 'by_month') AS worst_month_mape, min(mape) FILTER ("table" = 'by_month') AS best_month_mape,
      max(mape) FILTER (day_type = 'weekday') AS weekday_mape, max(mape) FILTER (day_type = 'weekend') AS weekend_mape
      FROM error_groups GROUP BY 1)""")
oracle("e13_significance", f"""
    SELECT o.series, CAST(row_number() OVER (PARTITION BY o.series ORDER BY o.mae, o.model) AS INTEGER) AS place, o.model,
           s.model AS shipped, round(o.mae, 6) AS mae,
           coalesce(abs(b.z) > 1.959963984540054 AND b.mean_diff < 0, false) AS beats_baseline,
           coalesce(abs(v.z) > 1.959963984540054, false) AS differs_from_shipped,
           round(v.mean_diff, 6) + 0.0 AS shipped_minus_model
    FROM ({_BASE}) o JOIN (SELECT series, arg_min(model, mae) AS model FROM ({_BASE}) GROUP BY 1) s ON s.series = o.series
    LEFT JOIN comparison b ON b.series = o.series AND b.model_a = o.model AND b.model_b = 'snaive' AND o.model <> 'snaive'
    LEFT JOIN comparison v ON v.series = o.series AND v.model_a = s.model AND v.model_b = o.model AND o.model <> s.model""")
CTES["fold_ends"] = """
    SELECT series, model, 'best' AS kind, first(fold ORDER BY fold_mae, fold) AS fold FROM maes GROUP BY ALL
    UNION ALL SELECT series, model, 'worst', first(fold ORDER BY fold_mae DESC, fold) FROM maes GROUP BY ALL"""
oracle("e14_best_worst_folds", f"""
    SELECT e.series, e.model, e.kind, e.fold, target_date, lead, {_r('y_true', 'y_pred')},
           round(avg(CASE WHEN y_true = 0 THEN 'inf'::DOUBLE ELSE abs(y_true - y_pred) / y_true END)
             OVER (PARTITION BY e.series, e.model, e.kind), 6) + 0.0 AS fold_mape
    FROM fold_ends e JOIN ({_WEEKLY}) r ON r.series = e.series AND r.model = e.model AND r.fold = e.fold""")
oracle("e15_model_table", f"""
    SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY
             CASE model WHEN 'naive' THEN 1 WHEN 'snaive' THEN 2 WHEN 'sarima' THEN 3 WHEN 'prophet' THEN 4
                        WHEN 'lstm' THEN 5 WHEN 'lgbm' THEN 6 ELSE 7 END, model) AS INTEGER) AS place, model, mape, mase
    FROM ({_SUMMARY})""")
oracle("e16_hour_month_surface", "SELECT series, hour, " + ", ".join(
    f"round(avg(CASE WHEN y_true = 0 THEN 'inf'::DOUBLE ELSE abs(y_true - y_pred) / y_true END) FILTER (month = {m}), 6) + 0.0 AS m{m}" for m in range(1, 13)
) + " FROM results WHERE model = 'naive' AND protocol = 'dense' GROUP BY ALL")
oracle("e17_hour_by_model", f"""
    SELECT series, model, hour, {_r('mape')} FROM (
      SELECT series, model, hour, {_ERRORS} FROM results WHERE protocol = 'weekly' GROUP BY ALL)""")

# ---------------------------------------------------------------- exploration
oracle("f1_day_type_profile", """
    SELECT series, CAST(isodow(local_ts) >= 6 AS INTEGER) AS is_weekend, CAST(hour(local_ts) AS INTEGER) AS local_hour,
           round(avg(load), 6) AS mean_load FROM clean GROUP BY 1, 2, 3""")
oracle("f2_weekday_hour_surface", "SELECT series, CAST(isodow(local_ts) - 1 AS INTEGER) AS dow, " + ", ".join(
    f"round(avg(load) FILTER (hour(local_ts) = {h}), 6) AS h{h}" for h in range(24)
) + " FROM clean GROUP BY 1, 2")
oracle("f3_daily_mean", f"SELECT series, day, {_r('load')} FROM daily")
CTES["trended"] = """
    SELECT *, CAST((row_number() OVER w - 1) % 365 AS INTEGER) AS phase,
           CASE WHEN count(*) OVER f = 365 THEN avg(load) OVER f END AS trend
    FROM daily WINDOW w AS (PARTITION BY series ORDER BY day),
                      f AS (PARTITION BY series ORDER BY day ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)"""
CTES["phases"] = "SELECT series, phase, avg(load - trend) AS s FROM trended GROUP BY ALL"
oracle("f4_decompose", """
    SELECT t.series, day, round(load, 6) AS observed, round(trend, 6) AS trend, round(s - lvl, 6) + 0.0 AS seasonal,
           round(load - trend - (s - lvl), 6) + 0.0 AS residual
    FROM trended t JOIN phases p ON p.series = t.series AND p.phase = t.phase
    JOIN (SELECT series, avg(s) AS lvl FROM phases GROUP BY 1) l ON l.series = t.series""")
oracle("f5_hexagon_density", """
    SELECT series, CAST(CASE WHEN d1 < d2 THEN 1 ELSE 2 END AS INTEGER) AS lattice,
           CAST(CASE WHEN d1 < d2 THEN round_even(x, 0) ELSE floor(x) END AS INTEGER) AS ix,
           CAST(CASE WHEN d1 < d2 THEN round_even(y, 0) ELSE floor(y) END AS INTEGER) AS iy, count(*) AS n
    FROM (SELECT series, x, y, (x - round_even(x, 0)) ** 2 + 3 * (y - round_even(y, 0)) ** 2 AS d1,
                 (x - floor(x) - 0.5) ** 2 + 3 * (y - floor(y) - 0.5) ** 2 AS d2
          FROM (SELECT c.series, (temp_c - (x0 - 1e-9 * (x1 - x0))) / ((x1 - x0) * (1 + 2e-9) / 55) AS x,
                       (load - y0) / ((y1 - y0) / 31) AS y
                FROM clean c JOIN (SELECT series, min(temp_c) AS x0, max(temp_c) AS x1, min(load) AS y0, max(load) AS y1
                                   FROM clean GROUP BY 1) b ON b.series = c.series)) GROUP BY ALL""")
oracle("f6_temperature_bins", """
    SELECT series, CAST(2 * ceil((temp_c + 20) / 2) - 21 AS DOUBLE) AS mid_c, round(median(load), 6) AS median_load, count(*) AS n
    FROM clean WHERE temp_c > -20 AND temp_c <= 40 GROUP BY 1, 2""")
CTES["centred"] = """
    SELECT series, list(load - m ORDER BY ts) AS x FROM clean JOIN (SELECT series, avg(load) AS m FROM clean GROUP BY 1) USING (series)
    GROUP BY 1"""
oracle("f7_acf", """
    SELECT series, CAST(k AS INTEGER) AS lag,
           round(list_inner_product(x[k + 1:], x[:len(x) - k]) / list_inner_product(x, x), 6) + 0.0 AS acf
    FROM centred CROSS JOIN generate_series(0, 200) g(k) WHERE len(x) > 200""")

oracle("f8_pacf", """
    WITH RECURSIVE cov AS (
        SELECT series, list(list_inner_product(x[k + 1:], x[:len(x) - k]) / (len(x) - k) ORDER BY k) AS c
        FROM centred CROSS JOIN generate_series(0, 100) g(k) WHERE len(x) > 100 GROUP BY series
    ), steps AS (
        SELECT series, c, 0 AS lag, []::DOUBLE[] AS phi, c[1] AS v, 1.0::DOUBLE AS pacf FROM cov
        UNION ALL
        SELECT series, c, lag + 1,
               list_append(CASE WHEN lag = 0 THEN []::DOUBLE[] ELSE list_transform(list_zip(phi, list_reverse(phi)), lambda z: z[1] - a * z[2]) END, a),
               v * (1 - a * a), a
        FROM (SELECT *, (c[lag + 2] - CASE WHEN lag = 0 THEN 0 ELSE list_inner_product(phi, list_reverse(c[2:lag + 1])) END) / v AS a
              FROM steps WHERE lag < 100)
    )
    SELECT series, lag, round(pacf, 6) + 0.0 AS pacf FROM steps""")
oracle("f9_describe", "\n    UNION ALL ".join(
    f"""SELECT series, '{v}' AS variable, count({v}) AS "count", round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std,
           round(min({v}), 6) AS min, round(quantile_cont({v}, 0.25), 6) AS p25, round(quantile_cont({v}, 0.5), 6) AS p50,
           round(quantile_cont({v}, 0.75), 6) AS p75, round(max({v}), 6) AS max FROM clean GROUP BY 1""" for v in ("load", "temp_c")))
oracle("f10_flag_shares", "SELECT series, " + ", ".join(
    f"round(avg({c}) * 100, 3) AS {c}" for c in ("imputed", "clipped", "bad_day", "temp_imputed")) + " FROM clean GROUP BY 1")
oracle("f11_series_span", """
    SELECT series, round(floor(date_diff('hour', min(ts), max(ts)) / 24.0) / 365.25, 6) AS years FROM clean GROUP BY 1""")

# ---------------------------------------------------------------- analytical queries
oracle("g1_monthly_peak", """
    SELECT series, local_month, round(load, 0) AS peak_mw, local_ts AS peak_at_local, CAST(hour(local_ts) AS INTEGER) AS peak_hour
    FROM (SELECT *, CAST(date_trunc('month', local_ts) AS DATE) AS local_month,
                 row_number() OVER (PARTITION BY series, date_trunc('month', local_ts) ORDER BY load DESC, ts) AS rn
          FROM clean WHERE bad_day = 0) WHERE rn = 1""")
oracle("g2_yearly_change", """
    SELECT series, CAST(yr AS INTEGER) AS yr, CAST(mo AS INTEGER) AS mo, round(m, 0) AS avg_mw,
           round(lag(m) OVER w, 0) AS avg_mw_prev_year, round((m - lag(m) OVER w) / nullif(lag(m) OVER w, 0) * 100, 2) AS yoy_pct
    FROM (SELECT series, year(local_ts) AS yr, month(local_ts) AS mo, avg(load) AS m FROM clean WHERE bad_day = 0 GROUP BY ALL)
    WINDOW w AS (PARTITION BY series, mo ORDER BY yr)""")


def oracle_sql() -> dict[str, str]:
    return {name: render(sql) for name, sql in QUERIES.items()}
