"""Metric, aggregation, ranking, resampling and join queries."""

from __future__ import annotations

from undertow.plans.dialect import Catalog

#: The forecasters of ``model``.
MODELS = ("naive", "seasonal_naive", "drift", "mean", "moving_average", "ols_trend", "panel_blend", "panel_naive")
REPS = 2000
STRATUM_REPS = 20000


def rows(c: Catalog) -> None:
    q = lambda name, sql: c.add(name, sql, query=True)
    q("a1_accuracy", "SELECT model_id, dataset, window_id, $EXACT(mase) AS mase, $EXACT(mae) AS mae FROM accuracy")
    c.add("treated_error", """SELECT f.model_id, f.window_id, f.capability_id, t.level, abs((c.yhat + t.gain * f.unit_hat) - (c.y + t.gain * f.unit)) AS e, c.scale FROM unit_fcst f JOIN treatment t ON f.window_id = t.window_id AND f.capability_id = t.capability_id AND f.level = t.level
        JOIN cell c ON c.model_id = f.model_id AND c.window_id = f.window_id AND c.channel_idx = f.channel_idx AND c.step = f.step WHERE f.observed""")
    q("a1_treatment_accuracy", "SELECT model_id, window_id, capability_id, level, $EXACT(avg(e / scale)) AS mase, $EXACT(avg(e)) AS mae FROM treated_error GROUP BY model_id, window_id, capability_id, level")
    q("a2_masked_accuracy", "SELECT model_id, window_id, count(CASE WHEN observed THEN 1 END) AS observed_cells, $EXACT(avg(CASE WHEN observed THEN abs(yhat - y) / scale END)) AS mase FROM cell GROUP BY model_id, window_id HAVING count(CASE WHEN observed THEN 1 END) > 0")
    q("a3_paired_effect", "SELECT model_id, window_id, capability_id, level, $EXACT(sse) AS sse, $EXACT(sst) AS sst, $EXACT(ssf) AS ssf, cells FROM effect")
    q("a4_effect_status", "SELECT model_id, window_id, capability_id, level, status FROM effect")
    q("a5_effect_ratios", "SELECT model_id, window_id, capability_id, level, $EXACT(nrmse) AS nrmse, $EXACT(amplitude_ratio) AS amplitude_ratio FROM effect")
    q("a6_effect_correlation", "SELECT model_id, window_id, capability_id, level, $EXACT(correlation) AS correlation FROM effect")
    # Decay over the steps that were observed. A peak is the first step that reaches the largest value, but for rounding.
    c.add("decay", "SELECT model_id, window_id, capability_id, level, step, sqrt(avg(unit * unit / (mase * mase))) AS truth, sqrt(avg(unit_hat * unit_hat / (mase * mase))) AS forecast FROM unit_fcst WHERE observed GROUP BY model_id, window_id, capability_id, level, step")
    c.add("peak", "SELECT *, max(truth) OVER (PARTITION BY model_id, window_id, capability_id, level) AS truth_peak, max(forecast) OVER (PARTITION BY model_id, window_id, capability_id, level) AS forecast_peak FROM decay")
    c.add("peak_at", "SELECT model_id, window_id, capability_id, level, min(CASE WHEN truth >= truth_peak * (1 - 1e-12) THEN step END) AS truth_at, min(CASE WHEN forecast >= forecast_peak * (1 - 1e-12) THEN step END) AS forecast_at FROM peak GROUP BY model_id, window_id, capability_id, level")
    c.add("halving", """SELECT p.model_id, p.window_id, p.capability_id, p.level, max(p.truth_peak) AS truth_peak, min(CASE WHEN p.step >= k.truth_at AND p.truth <= 0.5 * p.truth_peak * (1 + 1e-12) THEN p.step END) - max(k.truth_at) AS truth_half, min(CASE WHEN p.forecast_peak > 1e-12 AND p.step >= k.forecast_at AND p.forecast <= 0.5 * p.forecast_peak * (1 + 1e-12) THEN p.step END) - max(k.forecast_at) AS forecast_half,
        sqrt(sum((CASE WHEN p.forecast_peak > 1e-12 THEN p.forecast / p.forecast_peak ELSE 0 END - p.truth / nullif(p.truth_peak, 0)) * (CASE WHEN p.forecast_peak > 1e-12 THEN p.forecast / p.forecast_peak ELSE 0 END - p.truth / nullif(p.truth_peak, 0))) / greatest(sum(p.truth * p.truth / nullif(p.truth_peak * p.truth_peak, 0)), 1e-12)) AS shape_nrmse
        FROM peak p JOIN peak_at k ON p.model_id = k.model_id AND p.window_id = k.window_id AND p.capability_id = k.capability_id AND p.level = k.level GROUP BY p.model_id, p.window_id, p.capability_id, p.level""")
    q("a7_decay_profile", "SELECT model_id, window_id, capability_id, level, $EXACT(CASE WHEN truth_peak > 1e-12 THEN shape_nrmse END) AS shape_nrmse FROM halving")
    # The law scores half-lives of nonlinear persistence only; the measured ones of the others are shown beside that status.
    q("a8_half_life", "SELECT model_id, window_id, capability_id, level, CASE WHEN capability_id <> 'nonlinear_persistence' THEN 'not_applicable' ELSE measured END AS status, measured, truth_half AS truth_half_life, forecast_half AS forecast_half_life, abs(forecast_half - truth_half) AS absolute_error FROM (SELECT *, CASE WHEN truth_peak <= 1e-12 THEN 'unavailable_zero_truth_profile' WHEN truth_half IS NULL THEN 'censored_truth_not_halved_in_horizon' WHEN forecast_half IS NULL THEN 'censored_forecast_not_halved_in_horizon' ELSE 'scored' END AS measured FROM halving) q")
    # Ablation: the assessed channel of a treated window forecast with the panel, and by the same model from that channel alone,
    # where half of nothing else is left and the channel's own forecast decides. Models that never read siblings have no row.
    c.add("ablation", """SELECT f.model_id, f.window_id, f.capability_id, t.level, f.mase AS scale, c.y + t.gain * f.unit AS y, c.y AS baseline, c.yhat + t.gain * f.unit_hat AS full_hat, o.yhat + t.gain * CASE f.model_id WHEN 'panel_blend' THEN f.unit_seasonal ELSE f.unit_last END AS ablated_hat
        FROM unit_fcst f JOIN treatment t ON f.window_id = t.window_id AND f.capability_id = t.capability_id AND f.level = t.level JOIN ablation_plan a ON f.window_id = a.window_id AND f.capability_id = a.capability_id AND f.channel_idx = a.assessed AND a.d > 1
        JOIN cell c ON c.model_id = f.model_id AND c.window_id = f.window_id AND c.channel_idx = f.channel_idx AND c.step = f.step
        JOIN fcst o ON o.model_id = CASE f.model_id WHEN 'panel_blend' THEN 'seasonal_naive' ELSE 'naive' END AND o.window_id = f.window_id AND o.channel_idx = f.channel_idx AND o.step = f.step WHERE f.observed AND f.model_id IN ('panel_blend', 'panel_naive')""")
    c.add("ablation_row", "SELECT model_id, window_id, capability_id, level, avg(abs(full_hat - y) / scale) AS full_mase, avg(abs(ablated_hat - y) / scale) AS ablated_mase, sqrt(avg((ablated_hat - full_hat) * (ablated_hat - full_hat))) AS change_rms, greatest(sqrt(avg((y - baseline) * (y - baseline))), 1e-8) AS effect_rms FROM ablation GROUP BY model_id, window_id, capability_id, level")
    q("a9_input_ablation", "SELECT model_id, window_id, capability_id, level, $EXACT(full_mase) AS full_mase, $EXACT(ablated_mase) AS ablated_mase, $EXACT(ablated_mase - full_mase) AS degradation, $EXACT(change_rms) AS change_rms, $EXACT(change_rms / effect_rms) AS response_ratio FROM ablation_row")
    q("a10_exposure", "SELECT window_id, covariate_dim, future_dim, model_id, target_mode = 'native_multivariate' AS saw_siblings, covariate_mode IN ('native_known_future', 'native_history_only', 'paired_known_future_only') AS saw_covariates FROM adapted")
    q("a11_ui_metrics", "SELECT model_id, window_id, channel_idx, $EXACT(avg(abs(yhat - y))) AS mae, $EXACT(avg(abs(yhat - y)) / greatest(max(scale), 1e-12)) AS scaled_mae FROM cell WHERE observed GROUP BY model_id, window_id, channel_idx")
    q("a12_prediction_presence", "SELECT m.model_id, w.window_id FROM model m CROSS JOIN win w JOIN (SELECT DISTINCT model_id, window_id FROM fcst WHERE model_id <> 'drift') f ON f.model_id = m.model_id AND f.window_id = w.window_id")


def aggregates(c: Catalog) -> None:
    q = lambda name, sql: c.add(name, sql, query=True)
    c.add("scored", "SELECT model_id, 'official_baseline' AS kind, cast(NULL AS string) AS capability_id, 0 AS level, mase, mae FROM accuracy UNION ALL SELECT model_id, 'capability_treatment', capability_id, level, avg(e / scale), avg(e) FROM treated_error GROUP BY model_id, window_id, capability_id, level")
    q("r1_accuracy_summary", "SELECT model_id, kind, capability_id, level, count(*) AS official_instance_count, $EXACT(avg(mase)) AS mase_mean, $EXACT(avg(mae)) AS mae_mean FROM scored GROUP BY model_id, kind, capability_id, level")
    q("r2_official_accuracy", "SELECT model_id, count(*) AS official_instance_count, $EXACT(avg(mase)) AS official_mase_mean FROM accuracy GROUP BY model_id")
    q("r3_effect_summary", "SELECT model_id, capability_id, level, candidates, scored, low_signal, unobserved, $EXACT(cast(scored AS double) / candidates) AS coverage, $EXACT(pooled_nrmse) AS pooled_nrmse, $EXACT(mean_nrmse) AS mean_nrmse, $EXACT(pooled_amplitude) AS pooled_amplitude, $EXACT(mean_correlation) AS mean_correlation FROM effect_summary")
    q("r4_ablation_summary", "SELECT model_id, capability_id, level, count(*) AS rows_, $EXACT(avg(full_mase)) AS full_mase, $EXACT(avg(ablated_mase)) AS ablated_mase, $EXACT(avg(ablated_mase - full_mase)) AS degradation, $EXACT(avg(change_rms / effect_rms)) AS response_ratio FROM ablation_row GROUP BY model_id, capability_id, level")
    q("r5_partial_merge", "SELECT model_id, cast(sum(n) AS bigint) AS n, $EXACT(sum(s) / sum(n)) AS mase_mean FROM (SELECT model_id, dataset, count(*) AS n, sum(mase) AS s FROM accuracy GROUP BY model_id, dataset) q GROUP BY model_id")
    q("r6_availability_reasons", "SELECT capability_id, coalesce(reason, 'available') AS reason, count(*) AS windows FROM group_state GROUP BY capability_id, coalesce(reason, 'available')")
    c.add("capability_mean", "SELECT model_id, capability_id, avg(pooled_nrmse) AS nrmse, count(DISTINCT level) AS levels FROM effect_summary WHERE pooled_nrmse IS NOT NULL GROUP BY model_id, capability_id")
    q("r7_macro_means", "SELECT model_id, $EXACT(avg(nrmse)) AS macro_nrmse, count(*) AS capabilities FROM capability_mean GROUP BY model_id")
    q("r8_inventory", "SELECT count(DISTINCT dataset) AS tasks, count(DISTINCT window_id) AS windows, count(DISTINCT model_id) AS models, count(*) AS predictions, min(cells) AS min_cells, max(cells) AS max_cells, bool_and(mase IS NOT NULL) AS complete FROM accuracy")
    q("r9_availability_coverage", "SELECT g.capability_id, count(*) AS windows, count(CASE WHEN g.available THEN 1 END) AS available_windows, count(DISTINCT CASE WHEN g.available THEN w.dataset END) AS available_tasks, $EXACT(avg(CASE WHEN g.available THEN cast(1 AS double) ELSE cast(0 AS double) END)) AS share FROM group_state g JOIN win w ON g.window_id = w.window_id GROUP BY g.capability_id")
    q("r10_accuracy_diagnostics", "SELECT model_id, $EXACT(median(mase)) AS median_mase, $EXACT(max(mase)) AS max_mase, max_by(task_id, mase) AS worst_task, $EXACT((sum(mase) - max(mase)) / nullif(count(*) - 1, 0)) AS mean_without_worst FROM task_accuracy GROUP BY model_id")
    q("r11_level_average", "SELECT model_id, capability_id, $EXACT(nrmse) AS nrmse, levels = 5 AS complete FROM capability_mean")
    q("r12_task_equal", "SELECT model_id, capability_id, count(*) AS tasks, $EXACT(avg(nrmse)) AS nrmse, $EXACT(avg(amplitude)) AS amplitude FROM (SELECT model_id, capability_id, dataset, sqrt(sum(sse) / nullif(sum(sst), 0)) AS nrmse, sqrt(sum(ssf) / nullif(sum(sst), 0)) AS amplitude FROM effect WHERE status = 'scored' GROUP BY model_id, capability_id, dataset) q GROUP BY model_id, capability_id")
    q("r13_rank_parts", "SELECT model_id, count(DISTINCT part) AS parts, count(DISTINCT part) = 4 AS complete, cast(sum(n) AS bigint) AS rows_, $EXACT(sum(s) / sum(n)) AS mean FROM (SELECT model_id, step % 4 AS part, count(*) AS n, sum(abs(yhat - y)) AS s FROM cell WHERE observed GROUP BY model_id, step % 4) q GROUP BY model_id")
    q("r14_ablation_tasks", "SELECT model_id, capability_id, count(*) AS tasks, $EXACT(avg(d)) AS mean_, $EXACT(median(d)) AS median_, $EXACT(avg(CASE WHEN d > 1e-12 THEN cast(1 AS double) ELSE cast(0 AS double) END)) AS positive_fraction FROM (SELECT r.model_id, r.capability_id, w.dataset, avg(r.ablated_mase - r.full_mase) AS d FROM ablation_row r JOIN win w ON r.window_id = w.window_id GROUP BY r.model_id, r.capability_id, w.dataset) q GROUP BY model_id, capability_id")
    q("r15_leave_one_out", "SELECT model_id, $EXACT(min(v)) AS lowest, $EXACT(max(v)) AS highest FROM (SELECT model_id, (sum(mase) OVER (PARTITION BY model_id) - mase) / nullif(count(*) OVER (PARTITION BY model_id) - 1, 0) AS v FROM task_accuracy) q GROUP BY model_id")
    q("r16_record_availability", "SELECT dataset, capability_id, bool_and(available) AS every_window, bool_or(available) AS any_window, count(*) AS windows FROM (SELECT w.dataset, g.capability_id, g.available FROM group_state g JOIN win w ON g.window_id = w.window_id) q GROUP BY dataset, capability_id")
    q("r17_distinct", "SELECT dataset, count(DISTINCT model_id) AS models, count(DISTINCT window_id) AS windows FROM accuracy GROUP BY dataset")
    q("r18_rollup", "SELECT model_id, dataset, count(*) AS n, $EXACT(avg(mase)) AS mase FROM accuracy GROUP BY ROLLUP (model_id, dataset)")


def ranks(c: Catalog) -> None:
    q = lambda name, sql: c.add(name, sql, query=True)
    c.add("effect_rank", "SELECT capability_id, level, model_id, round(pooled_nrmse, 9) AS v, cast(row_number() OVER (PARTITION BY capability_id, level ORDER BY round(pooled_nrmse, 9), model_id) AS bigint) AS place FROM effect_summary WHERE pooled_nrmse IS NOT NULL")
    q("k1_effect_rank", "SELECT capability_id, level, model_id, place FROM effect_rank")
    q("k2_attribution_rank", "SELECT capability_id, level, model_id, cast(row_number() OVER (PARTITION BY capability_id, level ORDER BY d DESC, model_id) AS bigint) AS place FROM (SELECT model_id, capability_id, level, round(avg(ablated_mase - full_mase), 9) AS d FROM ablation_row GROUP BY model_id, capability_id, level) q")
    c.add("task_rank", "SELECT task_id, model_id, round(mase, 9) AS v, cast(rank() OVER (PARTITION BY task_id ORDER BY round(mase, 9)) AS bigint) AS place FROM task_accuracy")
    q("k3_competition_rank", "SELECT task_id, model_id, place FROM task_rank")
    c.add("mean_rank", "SELECT task_id, model_id, v, place + (count(*) OVER (PARTITION BY task_id, v) - 1) / cast(2 AS double) AS r FROM task_rank")
    q("k4_average_rank", "SELECT task_id, model_id, r AS average_rank FROM mean_rank")
    q("k4_tolerant_rank", "SELECT task_id, model_id, avg(cast(n AS double)) OVER (PARTITION BY task_id, island) AS average_rank FROM (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY task_id ORDER BY n) <= 1e-12 THEN 0 ELSE 1 END AS fresh FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY v, model_id) AS n FROM task_rank) q) q) q")
    c.add("winner", "SELECT capability_id, level, model_id, v, lead(v) OVER (PARTITION BY capability_id, level ORDER BY place) AS next_v, place FROM effect_rank")
    q("k5_cell_winners", "SELECT capability_id, level, model_id, $EXACT(next_v - v) AS margin FROM winner WHERE place = 1")
    q("k5_modal_winner", "SELECT capability_id, model_id, wins FROM (SELECT capability_id, model_id, count(*) AS wins, row_number() OVER (PARTITION BY capability_id ORDER BY count(*) DESC, model_id) AS n FROM winner WHERE place = 1 GROUP BY capability_id, model_id) q WHERE n = 1")
    c.add("two_ranks", "SELECT e.model_id, rank() OVER (ORDER BY e.nrmse) AS derived, rank() OVER (ORDER BY a.mase) AS official FROM (SELECT model_id, round(avg(nrmse), 9) AS nrmse FROM capability_mean GROUP BY model_id) e JOIN (SELECT model_id, round(avg(mase), 9) AS mase FROM accuracy GROUP BY model_id) a ON e.model_id = a.model_id")
    q("k6_rank_shift", "SELECT model_id, cast(official - derived AS bigint) AS shift FROM two_ranks")
    q("k7_winner_concordance", "SELECT e.capability_id, e.model_id AS effect_winner, t.model_id AS accuracy_winner, e.model_id = t.model_id AS concordant FROM (SELECT capability_id, model_id, row_number() OVER (PARTITION BY capability_id ORDER BY round(nrmse, 9), model_id) AS n FROM capability_mean) e JOIN (SELECT capability_id, model_id, row_number() OVER (PARTITION BY capability_id ORDER BY round(avg(mase), 9), model_id) AS n FROM scored WHERE capability_id IS NOT NULL GROUP BY capability_id, model_id) t ON e.capability_id = t.capability_id WHERE e.n = 1 AND t.n = 1")
    c.add("checkpoint", "SELECT concat(w.dataset, '|', a.model_id) AS run, w.w AS step, avg(a.mase) AS value, avg(a.mae) AS other FROM accuracy a JOIN win w ON a.window_id = w.window_id GROUP BY concat(w.dataset, '|', a.model_id), w.w")
    q("k8_best_checkpoint", "SELECT run, min(CASE WHEN n = 1 THEN step END) AS best_step, $EXACT(min(CASE WHEN n = 1 THEN value END)) AS best, max_by(step, CASE WHEN step > 0 THEN -n END) AS best_nonzero_step, max(step) AS final_step FROM (SELECT run, step, value, row_number() OVER (PARTITION BY run ORDER BY round(value, 9), step) AS n FROM checkpoint) q GROUP BY run")
    q("k9_pareto", "SELECT a.run, a.step FROM checkpoint a WHERE NOT EXISTS (SELECT 1 FROM checkpoint b WHERE b.run = a.run AND b.value <= a.value AND b.other <= a.other AND (b.value < a.value OR b.other < a.other))")
    q("k10_adjacent_gaps", "SELECT model_id, lead(model_id) OVER (ORDER BY v, model_id) AS next_model, $EXACT(lead(v) OVER (ORDER BY v, model_id) - v) AS gap FROM (SELECT model_id, round(avg(mase), 9) AS v FROM accuracy GROUP BY model_id) q")
    q("k11_candidate_pools", "SELECT window_id, channel_idx, bin, cast(place AS bigint) AS place, place <= 8 AS in_8, place <= 4 AS in_4, place <= 3 AS in_3 FROM (SELECT window_id, channel_idx, bin, row_number() OVER (PARTITION BY window_id, channel_idx ORDER BY power DESC, bin) AS place FROM power) q WHERE place <= 12")
    q("k12_head_tail", "SELECT run, $EXACT(avg(CASE WHEN a <= 10 THEN value END)) AS head, $EXACT(avg(CASE WHEN z <= 10 THEN value END)) AS tail FROM (SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY step) AS a, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS z FROM checkpoint) q GROUP BY run")
    q("k13_window_functions", "SELECT window_id, channel_idx, t, $EXACT(sum(value) OVER (PARTITION BY window_id, channel_idx ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS running, $EXACT(value - lag(value, 7) OVER (PARTITION BY window_id, channel_idx ORDER BY t)) AS diff FROM hist")
    q("k14_output_order", "SELECT model_id, kind, capability_id, level, cast(row_number() OVER (ORDER BY model_id, kind, coalesce(capability_id, 'None'), level) AS bigint) AS position FROM (SELECT DISTINCT model_id, kind, capability_id, level FROM scored) q")


def resampling(c: Catalog) -> None:
    q = lambda name, sql: c.add(name, sql, query=True)
    c.add("task_index", "SELECT task_id, cast(row_number() OVER (ORDER BY task_id) - 1 AS bigint) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT task_id FROM task_accuracy) q")
    c.add("resample", f"SELECT i.rep, i.i AS slot, cast(floor($U(concat('boot|', cast(i.rep AS string), '|', cast(i.i AS string))) * i.n) AS bigint) AS pick FROM (SELECT *, $SEQ(0, {REPS - 1}) AS rep FROM task_index) i")
    c.add("boot", "SELECT a.model_id, r.rep, avg(a.mase) AS v FROM resample r JOIN task_index i ON r.pick = i.i JOIN task_accuracy a ON a.task_id = i.task_id GROUP BY a.model_id, r.rep")
    c.add("boot_ci", "SELECT model_id, $PCT(v, 0.025) AS lo, $PCT(v, 0.975) AS hi FROM boot GROUP BY model_id")
    q("b1_bootstrap_ci", "SELECT model_id, $EXACT(lo) AS lo, $EXACT(hi) AS hi FROM boot_ci")
    q("b2_suite_rows", "SELECT a.model_id, count(*) AS tasks, $EXACT(avg(a.mase)) AS mean, $EXACT(max(c.lo)) AS lo, $EXACT(max(c.hi)) AS hi FROM task_accuracy a JOIN boot_ci c ON a.model_id = c.model_id GROUP BY a.model_id")
    c.add("pair", "SELECT l.model_id AS left_model, r.model_id AS right_model, l.task_id, l.mase - r.mase AS d FROM task_accuracy l JOIN task_accuracy r ON l.task_id = r.task_id AND l.model_id < r.model_id")
    c.add("pair_ci", "SELECT left_model, right_model, $PCT(v, 0.025) AS lo, $PCT(v, 0.975) AS hi FROM (SELECT p.left_model, p.right_model, r.rep, avg(p.d) AS v FROM resample r JOIN task_index i ON r.pick = i.i JOIN pair p ON p.task_id = i.task_id GROUP BY p.left_model, p.right_model, r.rep) q GROUP BY left_model, right_model")
    q("b3_paired_models", "SELECT p.left_model, p.right_model, count(*) AS tasks, $EXACT(avg(p.d)) AS difference, $EXACT(max(c.lo)) AS lo, $EXACT(max(c.hi)) AS hi FROM pair p JOIN pair_ci c ON p.left_model = c.left_model AND p.right_model = c.right_model GROUP BY p.left_model, p.right_model")
    c.add("stratum", "SELECT model_id, capability_id, window_id, sum(sse) AS sse, sum(sst) AS sst FROM effect WHERE status = 'scored' GROUP BY model_id, capability_id, window_id")
    c.add("stratum_index", "SELECT capability_id, window_id, cast(row_number() OVER (PARTITION BY capability_id ORDER BY window_id) - 1 AS bigint) AS i, count(*) OVER (PARTITION BY capability_id) AS n FROM (SELECT DISTINCT capability_id, window_id FROM stratum) q")
    c.add("stratum_draw", f"SELECT s.rep, s.capability_id, cast(floor($U(concat(s.capability_id, '|', cast(s.rep AS string), '|', cast(s.i AS string))) * s.n) AS bigint) AS pick FROM (SELECT *, $SEQ(0, {STRATUM_REPS - 1}) AS rep FROM stratum_index) s")
    # One row for a window with a column for each model: a draw is joined once, not once for each model.
    wide = ", ".join(f"max(CASE WHEN model_id = '{m}' THEN sqrt(sse / nullif(sst, 0)) END) AS {m}" for m in MODELS)
    means = lambda of: ", ".join(f"avg({of}{m}) AS {m}" for m in MODELS)
    c.add("stratum_wide", f"SELECT capability_id, window_id, {wide} FROM stratum GROUP BY capability_id, window_id")
    c.add("stratum_means", f"SELECT rep, {means('')} FROM (SELECT d.rep, d.capability_id, {means('s.')} FROM stratum_draw d JOIN stratum_index i ON d.capability_id = i.capability_id AND d.pick = i.i JOIN stratum_wide s ON s.capability_id = i.capability_id AND s.window_id = i.window_id GROUP BY d.rep, d.capability_id) q GROUP BY rep")
    c.add("stratum_boot", "SELECT m.model_id, b.rep, CASE m.model_id " + " ".join(f"WHEN '{m}' THEN b.{m}" for m in MODELS) + " END AS v FROM stratum_means b CROSS JOIN model m")
    q("b4_stratified_bootstrap", "SELECT model_id, $EXACT(avg(v)) AS mean, $EXACT($PCT(v, 0.025)) AS lo, $EXACT($PCT(v, 0.975)) AS hi FROM stratum_boot GROUP BY model_id")
    q("b5_significance", "SELECT model_id, count(CASE WHEN verdict = 'win' THEN 1 END) AS wins, count(CASE WHEN verdict = 'loss' THEN 1 END) AS losses, count(CASE WHEN verdict = 'ns' THEN 1 END) AS ns FROM (SELECT left_model AS model_id, CASE WHEN hi < 0 THEN 'win' WHEN lo > 0 THEN 'loss' ELSE 'ns' END AS verdict FROM pair_ci UNION ALL SELECT right_model, CASE WHEN lo > 0 THEN 'win' WHEN hi < 0 THEN 'loss' ELSE 'ns' END FROM pair_ci) q GROUP BY model_id")
    q("b6_paired_strata", "SELECT l.model_id AS left_model, r.model_id AS right_model, $EXACT($PCT(l.v - r.v, 0.025)) AS lo, $EXACT($PCT(l.v - r.v, 0.975)) AS hi FROM stratum_boot l JOIN stratum_boot r ON l.rep = r.rep AND l.model_id < r.model_id GROUP BY l.model_id, r.model_id")
    q("b7_describe", "SELECT model_id, count(*) AS n, $EXACT(avg(mase)) AS mean, $EXACT(coalesce(stddev_samp(mase), 0)) AS sd, $EXACT(coalesce(stddev_samp(mase), 0) / nullif(avg(mase), 0)) AS cv, $EXACT(median(mase)) AS median_, $EXACT(max(mase) - min(mase)) AS range_, $EXACT($PCT(mase, 0.25)) AS q25, $EXACT($PCT(mase, 0.75)) AS q75, $EXACT(CASE WHEN count(*) = 10 THEN 2.2621571627409915 * stddev_samp(mase) / sqrt(cast(10 AS double)) END) AS t_half FROM task_accuracy GROUP BY model_id")
    q("b8_threshold_direction", "SELECT model_id, $EXACT(avg(CASE WHEN mase < 1 THEN cast(1 AS double) ELSE cast(0 AS double) END)) AS desired_rate, bool_and(mase < 1) OR bool_and(mase >= 1) AS unanimous FROM task_accuracy GROUP BY model_id")
    q("b9_variance_ratio", "SELECT a.model_id, $EXACT(stddev_samp(a.mase) / nullif(max(c.hi - c.lo) / (2 * 1.96), 0)) AS ratio, CASE WHEN max(c.hi) < 1 THEN 'below' WHEN min(c.lo) > 1 THEN 'above' ELSE 'includes' END AS relation FROM task_accuracy a JOIN boot_ci c ON a.model_id = c.model_id GROUP BY a.model_id")
    c.add("rank_pair", "SELECT x.model_id AS m, l.task_id AS a, r.task_id AS b, l.r AS x, r.r AS y, l.v AS xv, r.v AS yv FROM (SELECT DISTINCT model_id FROM mean_rank) x JOIN mean_rank l ON l.model_id = x.model_id JOIN mean_rank r ON r.model_id = x.model_id AND l.task_id < r.task_id")
    q("b10_spearman", "SELECT a, b, $EXACT(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)) AS spearman, $EXACT(covar_pop(xv, yv) / nullif(stddev_pop(xv) * stddev_pop(yv), 0)) AS pearson FROM rank_pair GROUP BY a, b")
    q("b10_kendall", "SELECT p.a, p.b, $EXACT(sum(sign(p.x - o.x) * sign(p.y - o.y)) / nullif(sqrt(sum(abs(sign(p.x - o.x))) * sum(abs(sign(p.y - o.y)))), 0)) AS tau FROM rank_pair p JOIN rank_pair o ON p.a = o.a AND p.b = o.b AND p.m < o.m GROUP BY p.a, p.b")
    q("b11_kendall_w", "SELECT max(n) AS models, max(k) AS tasks, $EXACT(12 * sum((s - mean_s) * (s - mean_s)) / (max(k) * max(k) * (cast(max(n) AS double) * max(n) * max(n) - max(n)))) AS w FROM (SELECT s, k, avg(s) OVER () AS mean_s, count(*) OVER () AS n FROM (SELECT model_id, sum(r) AS s, count(*) AS k FROM mean_rank GROUP BY model_id) q) q")
    q("b12_rank_similarity", "SELECT a, count(*) AS others, $EXACT(min(s)) AS lowest, $EXACT(avg(s)) AS mean FROM (SELECT a, b, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS s FROM rank_pair GROUP BY a, b) q GROUP BY a")
    q("b13_relative_change", "SELECT run, step, $EXACT(value - base) AS absolute, $EXACT((base - value) / nullif(base, 0) * 100) AS gain_percent, value < base AS improved FROM (SELECT run, step, value, first_value(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS base FROM checkpoint) q")
    q("b14_seed_transfer", "SELECT a.step, count(*) AS runs, $EXACT(avg(a.value - b.value)) AS mean_change, count(CASE WHEN a.value < b.value THEN 1 END) AS improved FROM checkpoint a JOIN checkpoint b ON a.run = b.run AND b.step = 0 WHERE a.step > 0 GROUP BY a.step")
    c.add("structure", """SELECT window_id, 'trend' AS capability_id, concat(cast(kind AS string), '|', cast(knot AS string), '|', cast(phase AS string)) AS shape FROM trend_shape UNION ALL SELECT window_id, 'regime_switching', concat(cast(kind AS string), '|', cast(width AS string)) FROM regime_shape
        UNION ALL SELECT window_id, 'predictable_intermittency', concat(cast(kind AS string), '|', cast(width AS string), '|', cast(cast(round(jitter * 100) AS bigint) AS string)) FROM event_shape""")
    q("b15_structure_uniqueness", "SELECT capability_id, count(*) AS windows, count(DISTINCT shape) AS unique_shapes, $EXACT(cast(count(DISTINCT shape) AS double) / count(*)) AS rate FROM structure GROUP BY capability_id")
    q("b16_percentiles", "SELECT event_type, $EXACT($PCT(value, 0.5)) AS p50, $EXACT($PCT(value, 0.95)) AS p95, $EXACT(count(*) / cast(30 AS double)) AS per_day FROM events GROUP BY event_type")
    q("b17_band_quantiles", "SELECT dataset, step, $EXACT($PCT(yhat, 0.1)) AS lo, $EXACT($PCT(yhat, 0.9)) AS hi FROM cell GROUP BY dataset, step")
    q("b18_identities", "SELECT 'treatments' AS identity_, (SELECT count(*) FROM treatment) = 5 * (SELECT count(*) FROM (SELECT DISTINCT window_id, capability_id FROM treatment) q) AS holds UNION ALL SELECT 'macro', abs((SELECT avg(nrmse) FROM capability_mean) - (SELECT avg(v) FROM (SELECT avg(nrmse) AS v FROM capability_mean GROUP BY model_id) q)) <= 1e-9")


def joins(c: Catalog) -> None:
    q = lambda name, sql: c.add(name, sql, query=True)
    q("j1_prediction_lookup", "SELECT f.model_id, u.window_id, count(*) AS cells, $EXACT(avg(abs(f.yhat - u.value))) AS mae FROM fut u JOIN fcst f ON u.window_id = f.window_id AND u.channel_idx = f.channel_idx AND u.step = f.step GROUP BY f.model_id, u.window_id")
    q("j2_treatment_baseline", "SELECT t.window_id, t.capability_id, t.level, a.model_id, $EXACT(a.mase) AS baseline_mase FROM treatment t JOIN accuracy a ON t.window_id = a.window_id")
    q("j3_ablation_chain", "SELECT b.model_id, b.window_id, b.capability_id, count(*) AS levels, $EXACT(max(b.ablated_mase - a.mase)) AS gap FROM ablation_row b JOIN treatment t ON b.window_id = t.window_id AND b.capability_id = t.capability_id AND b.level = t.level JOIN accuracy a ON a.window_id = b.window_id AND a.model_id = b.model_id GROUP BY b.model_id, b.window_id, b.capability_id")
    q("j4_merge_leftovers", "SELECT coalesce(w.window_id, c.window_id) AS window_id, count(c.sample_id) AS contracts, w.window_id IS NULL AS stray FROM win w FULL OUTER JOIN contract c ON w.window_id = c.window_id GROUP BY coalesce(w.window_id, c.window_id), w.window_id IS NULL")
    q("j5_common_tasks", "SELECT left_model, right_model, count(*) AS common FROM pair GROUP BY left_model, right_model")
    q("j6_full_outer", "SELECT coalesce(a.dataset, b.dataset) AS dataset, a.dataset IS NOT NULL AS in_panel, b.dataset IS NOT NULL AS in_plan FROM (SELECT DISTINCT dataset FROM panel) a FULL OUTER JOIN (SELECT DISTINCT dataset FROM win WHERE dataset <> 'lineitem_daily' UNION SELECT 'other') b ON a.dataset = b.dataset")
    q("j7_left_enrichment", "SELECT e.dataset, e.n, t.windows FROM extent e LEFT JOIN (SELECT * FROM task WHERE freq = 'H') t ON e.dataset = t.dataset")
    q("j8_semi", "SELECT dataset_id FROM registry r WHERE EXISTS (SELECT 1 FROM long_config l WHERE l.config_id = r.config_id)")
    q("j9_anti", "SELECT dataset_id FROM registry r WHERE NOT EXISTS (SELECT 1 FROM long_config l WHERE l.config_id = r.config_id)")
    q("j10_theta", "SELECT a.run, a.step, count(*) AS dominated_by FROM checkpoint a JOIN checkpoint b ON a.run = b.run AND b.value < a.value AND b.other < a.other GROUP BY a.run, a.step")
    q("j11_range", "SELECT w.window_id, k.ctx, count(*) AS cells FROM win w JOIN (SELECT 24 AS ctx UNION ALL SELECT 96) k ON w.origin > k.ctx JOIN panel p ON p.dataset = w.dataset AND p.channel_idx = 0 AND p.t >= w.origin - k.ctx AND p.t < w.origin GROUP BY w.window_id, k.ctx")
    q("j12_set_operations", "SELECT 'both' AS part, task_id FROM (SELECT task_id FROM task_rank WHERE model_id = 'naive' AND place <= 3 INTERSECT SELECT task_id FROM task_rank WHERE model_id = 'drift' AND place <= 3) q UNION ALL SELECT 'only', task_id FROM (SELECT task_id FROM task_rank WHERE model_id = 'naive' AND place <= 3 EXCEPT SELECT task_id FROM task_rank WHERE model_id = 'drift' AND place <= 3) q")
    q("j13_ordered_dedup", "SELECT event_type, first_event FROM (SELECT event_type, event_id AS first_event, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) q WHERE n = 1")
    q("j14_pivot", "SELECT task_id, " + ", ".join(f"$EXACT(max(CASE WHEN model_id = '{m}' THEN mase END)) AS {m}" for m in MODELS) + " FROM task_accuracy GROUP BY task_id")
    q("j15_explorer", "SELECT t.dataset, t.capability_id, count(DISTINCT t.window_id) AS windows, count(DISTINCT t.level) AS levels, min(t.window_id) AS first_window, count(e.model_id) AS effects, $EXACT(avg(e.nrmse)) AS nrmse FROM treatment t LEFT JOIN effect e ON t.window_id = e.window_id AND t.capability_id = e.capability_id AND t.level = e.level GROUP BY t.dataset, t.capability_id")
    q("x1_hourly_events", "SELECT event_type, $HOUR(ts) AS hour, count(*) AS n, $EXACT(sum(value)) AS total FROM events GROUP BY event_type, $HOUR(ts)")
