"""Relations that other queries read: panels, windows, scales, forecasts, treatments and metric rows.

Cell form throughout: one row for each channel and step, so that masks, sums and scales are plain aggregates that
Spark runs partially before it shuffles.
"""

from __future__ import annotations

from undertow.plans.dialect import Catalog


def install(c: Catalog) -> None:
    # Panels: dense calendars over three tables of events.
    c.add("raw", """SELECT 'events_hourly' AS dataset, 'H' AS freq, event_type AS channel, $HOUR(ts) AS ts, sum(value) AS value FROM events GROUP BY event_type, $HOUR(ts)
        UNION ALL SELECT 'orders_daily', 'D', o_orderpriority, $DAY(o_orderdate), sum(o_totalprice) FROM orders GROUP BY o_orderpriority, $DAY(o_orderdate)
        UNION ALL SELECT 'lineitem_daily', 'D', concat(l_returnflag, l_linestatus), $DAY(l_shipdate), sum(l_quantity) FROM lineitem GROUP BY concat(l_returnflag, l_linestatus), $DAY(l_shipdate)""")
    c.add("span", "SELECT dataset, freq, min(ts) AS lo, max(ts) AS hi FROM raw GROUP BY dataset, freq")
    c.add("extent", "SELECT dataset, freq, lo, CASE WHEN freq = 'H' THEN $HOURS(lo, hi) ELSE $DAYS(lo, hi) END + 1 AS n FROM span")
    c.add("channels", "SELECT DISTINCT dataset, channel FROM raw")
    c.add("chan", "SELECT dataset, channel, cast(row_number() OVER (PARTITION BY dataset ORDER BY channel) - 1 AS bigint) AS channel_idx FROM channels")
    c.add("grid", "SELECT e.dataset, e.freq, k.channel, k.channel_idx, $SEQ(0, n - 1) AS t FROM extent e JOIN chan k ON e.dataset = k.dataset")
    c.add("obs", "SELECT r.dataset, r.channel, CASE WHEN r.freq = 'H' THEN $HOURS(lo, ts) ELSE $DAYS(lo, ts) END AS t, r.value FROM raw r JOIN extent e ON r.dataset = e.dataset")
    c.add("panel_sparse", "SELECT g.dataset, g.freq, g.channel, g.channel_idx, g.t, o.value FROM grid g LEFT JOIN obs o ON g.dataset = o.dataset AND g.channel = o.channel AND g.t = o.t")
    c.add("panel", "SELECT dataset, freq, channel, channel_idx, t, coalesce(value, cast(0 AS double)) AS value FROM panel_sparse")
    # Tasks and rolling-origin windows. Horizons by frequency and term, seasonal lags.
    c.add("horizon", "SELECT * FROM (VALUES ('M', 12, 18), ('W', 8, 13), ('D', 30, 14), ('H', 48, 48), ('T', 48, NULL), ('S', 60, NULL), ('A', NULL, 6), ('Q', NULL, 8)) AS v(freq, base, m4_base)")
    c.add("term", "SELECT * FROM (VALUES ('short', 1), ('medium', 10), ('long', 15)) AS v(term, multiplier)")
    c.add("task", """SELECT e.dataset, e.freq, e.n, h.base AS h, CASE e.freq WHEN 'H' THEN 24 WHEN 'D' THEN 7 ELSE 1 END AS m,
        cast(least(greatest(1, ceil(cast(0.1 AS double) * e.n / h.base)), 20) AS bigint) AS windows FROM extent e JOIN horizon h ON e.freq = h.freq""")
    c.add("win", """SELECT dataset, freq, n, h, m, w, n - h * windows + w * h AS origin, concat(dataset, '__w', lpad(cast(w AS string), 2, '0'), '__o', cast(n - h * windows + w * h AS string)) AS window_id
        FROM (SELECT *, $SEQ(0, windows - 1) AS w FROM task) q WHERE n - h * windows + w * h > 0""")
    c.add("hist", "SELECT w.window_id, w.dataset, w.origin, w.h, w.m, p.channel_idx, p.t, p.value FROM win w JOIN panel p ON w.dataset = p.dataset AND p.t < w.origin")
    c.add("fut", "SELECT w.window_id, w.dataset, w.h, w.m, p.channel_idx, p.t - w.origin AS step, p.value, s.value IS NOT NULL AS observed FROM win w JOIN panel p ON w.dataset = p.dataset AND p.t >= w.origin AND p.t < w.origin + w.h JOIN panel_sparse s ON p.dataset = s.dataset AND p.channel = s.channel AND p.t = s.t")

    # Scales, from history only.
    c.add("mase_scale", """SELECT window_id, dataset, channel_idx, CASE WHEN sm > 1e-8 THEN sm WHEN s1 > 1e-8 THEN s1 ELSE cast(1 AS double) END AS scale FROM (
        SELECT window_id, dataset, channel_idx, avg(abs(value - prev_m)) AS sm, avg(abs(value - prev_1)) AS s1 FROM (
        SELECT window_id, dataset, channel_idx, value, CASE WHEN m = 24 THEN lag(value, 24) OVER (PARTITION BY window_id, channel_idx ORDER BY t) WHEN m = 7 THEN lag(value, 7) OVER (PARTITION BY window_id, channel_idx ORDER BY t) ELSE lag(value, 1) OVER (PARTITION BY window_id, channel_idx ORDER BY t) END AS prev_m,
        lag(value, 1) OVER (PARTITION BY window_id, channel_idx ORDER BY t) AS prev_1 FROM hist) q GROUP BY window_id, dataset, channel_idx) q""")
    c.add("channel_scale", """SELECT window_id, dataset, channel_idx, center, CASE WHEN sd > 1e-8 THEN sd WHEN sdd > 1e-8 THEN sdd ELSE cast(1 AS double) END AS scale FROM (
        SELECT window_id, dataset, channel_idx, avg(value) AS center, stddev_pop(value) AS sd, stddev_pop(d) AS sdd FROM (
        SELECT window_id, dataset, channel_idx, value, value - lag(value) OVER (PARTITION BY window_id, channel_idx ORDER BY t) AS d FROM hist) q GROUP BY window_id, dataset, channel_idx) q""")

    # Statistical forecasters: what each needs of a history, then its value at each step.
    c.add("fit", """SELECT window_id, dataset, channel_idx, min(origin) AS origin, min(h) AS h, min(m) AS m, max(CASE WHEN t = origin - 1 THEN value END) AS last_value, max(CASE WHEN t = 0 THEN value END) AS first_value, avg(value) AS mean_value,
        avg(CASE WHEN t >= origin - m THEN value END) AS recent, regr_slope(value, cast(t AS double)) AS slope, regr_intercept(value, cast(t AS double)) AS intercept FROM hist GROUP BY window_id, dataset, channel_idx""")
    c.add("steps", "SELECT *, $SEQ(0, h - 1) AS step FROM fit")
    c.add("model", "SELECT * FROM (VALUES ('naive'), ('seasonal_naive'), ('drift'), ('mean'), ('moving_average'), ('ols_trend'), ('panel_blend'), ('panel_naive')) AS v(model_id)")
    # The last two read the whole panel: half of a channel's own forecast, half of what its siblings' deviations, each in its own scale, say.
    c.add("own", """SELECT s.window_id, s.dataset, s.channel_idx, s.step, s.origin, s.last_value, s.first_value, s.mean_value, s.recent, s.slope, s.intercept, p.value AS seasonal, k.scale, (p.value - s.mean_value) / k.scale AS zs, (s.last_value - s.mean_value) / k.scale AS zl
        FROM steps s JOIN panel p ON s.dataset = p.dataset AND s.channel_idx = p.channel_idx AND p.t = s.origin - s.m + s.step % s.m JOIN channel_scale k ON s.window_id = k.window_id AND s.channel_idx = k.channel_idx""")
    c.add("sibling", """SELECT *, coalesce((sum(zs) OVER (PARTITION BY window_id, step) - zs) / nullif(count(*) OVER (PARTITION BY window_id, step) - 1, 0), zs) AS others_s, coalesce((sum(zl) OVER (PARTITION BY window_id, step) - zl) / nullif(count(*) OVER (PARTITION BY window_id, step) - 1, 0), zl) AS others_l FROM own""")
    c.add("fcst", """SELECT d.model_id, s.window_id, s.dataset, s.channel_idx, s.step, CASE d.model_id WHEN 'naive' THEN s.last_value WHEN 'seasonal_naive' THEN s.seasonal
        WHEN 'drift' THEN s.last_value + (s.step + 1) * (s.last_value - s.first_value) / greatest(s.origin - 1, 1) WHEN 'mean' THEN s.mean_value WHEN 'moving_average' THEN s.recent WHEN 'ols_trend' THEN s.intercept + s.slope * (s.origin + s.step)
        WHEN 'panel_blend' THEN 0.5 * s.seasonal + 0.5 * (s.mean_value + s.scale * s.others_s) ELSE 0.5 * s.last_value + 0.5 * (s.mean_value + s.scale * s.others_l) END AS yhat FROM sibling s CROSS JOIN model d""")
    c.add("cell", "SELECT f.model_id, f.dataset, f.window_id, f.channel_idx, f.step, f.yhat, u.value AS y, u.observed, s.scale FROM fcst f JOIN fut u ON f.window_id = u.window_id AND f.channel_idx = u.channel_idx AND f.step = u.step JOIN mase_scale s ON f.window_id = s.window_id AND f.channel_idx = s.channel_idx")
    # Only observed cells count; a window without any has no accuracy row.
    c.add("accuracy", "SELECT model_id, dataset, window_id, avg(abs(yhat - y) / scale) AS mase, avg(abs(yhat - y)) AS mae, count(*) AS cells FROM cell WHERE observed GROUP BY model_id, dataset, window_id")
    c.add("task_accuracy", "SELECT model_id, concat(dataset, '__c', cast(channel_idx AS string)) AS task_id, avg(abs(yhat - y) / scale) AS mase FROM cell WHERE observed GROUP BY model_id, concat(dataset, '__c', cast(channel_idx AS string))")

    # Treatments. A unit treatment is a direction for each affected channel (in units of the channel's scale) times a
    # profile over time, so that all statistics of a treated panel follow from those of one series for each level.
    # Dose bands, bands of change locations and of event gaps.
    c.add("band", """SELECT * FROM (VALUES ('trend', 1, 0.10, 0.15), ('trend', 2, 0.17, 0.22), ('trend', 3, 0.25, 0.32), ('trend', 4, 0.36, 0.46), ('trend', 5, 0.50, 0.65),
        ('regime_switching', 1, 0.20, 0.32), ('regime_switching', 2, 0.38, 0.50), ('regime_switching', 3, 0.56, 0.66), ('regime_switching', 4, 0.72, 0.82), ('regime_switching', 5, 0.87, 0.94),
        ('predictable_intermittency', 1, 0.10, 0.18), ('predictable_intermittency', 2, 0.22, 0.30), ('predictable_intermittency', 3, 0.34, 0.44), ('predictable_intermittency', 4, 0.50, 0.64), ('predictable_intermittency', 5, 0.72, 0.92)) AS v(capability_id, level, lo, hi)""")
    c.add("capability", "SELECT DISTINCT capability_id FROM band")
    c.add("direction", "SELECT p.window_id, p.channel_idx, regr_slope((p.value - s.center) / s.scale, cast(p.t AS double) / (p.origin - 1)) AS whole, regr_slope(CASE WHEN p.t < floor(p.origin / 2) THEN (p.value - s.center) / s.scale END, cast(p.t AS double) / (p.origin - 1)) AS first_half, regr_slope(CASE WHEN p.t >= floor(p.origin / 2) THEN (p.value - s.center) / s.scale END, cast(p.t AS double) / (p.origin - 1)) AS second_half FROM hist p JOIN channel_scale s ON p.window_id = s.window_id AND p.channel_idx = s.channel_idx GROUP BY p.window_id, p.channel_idx")
    c.add("trend_sign", "SELECT window_id, channel_idx, whole, CASE WHEN abs(whole) >= 0.05 AND sign(whole) = sign(first_half) AND sign(whole) = sign(second_half) THEN cast(sign(whole) AS double) ELSE cast(0 AS double) END AS dir FROM direction")
    # A trend goes on as the history goes; other directions are drawn. Affected channels are a drawn subset, one at least.
    c.add("candidate", "SELECT d.window_id, k.capability_id, d.channel_idx, CASE WHEN k.capability_id = 'trend' THEN d.dir WHEN $U(concat(d.window_id, '|', k.capability_id, '|sign|', cast(d.channel_idx AS string))) < 0.5 THEN cast(-1 AS double) ELSE cast(1 AS double) END AS dir FROM trend_sign d CROSS JOIN capability k")
    c.add("ranked", "SELECT window_id, capability_id, channel_idx, dir, row_number() OVER (PARTITION BY window_id, capability_id ORDER BY $U(concat(window_id, '|', capability_id, '|pick|', cast(channel_idx AS string))), channel_idx) AS place, count(*) OVER (PARTITION BY window_id, capability_id) AS n FROM candidate WHERE dir <> 0")
    c.add("affected", "SELECT window_id, capability_id, channel_idx, dir, sum(dir) OVER (PARTITION BY window_id, capability_id) AS total FROM ranked WHERE place <= 1 + floor($U(concat(window_id, '|', capability_id, '|size')) * n)")
    c.add("loading", """SELECT l.window_id, s.dataset, l.capability_id, l.channel_idx, l.dir, s.scale, a.scale AS mase, k.d, coalesce((l.total - l.dir) / nullif(k.d - 1, 0), l.dir) AS others FROM affected l JOIN channel_scale s ON l.window_id = s.window_id AND l.channel_idx = s.channel_idx
        JOIN mase_scale a ON l.window_id = a.window_id AND l.channel_idx = a.channel_idx JOIN (SELECT window_id, count(*) AS d FROM channel_scale GROUP BY window_id) k ON l.window_id = k.window_id""")
    u = lambda what: f"$U(concat(window_id, '|{what}'))"
    c.add("trend_shape", f"""SELECT window_id, dataset, origin, h, m, cast(floor({u('trend|type')} * 4) AS bigint) AS kind, 0.10 + 0.35 * {u('trend|onset')} AS onset, 0.65 + 0.9 * {u('trend|power')} AS curve, knot, cast(floor({u('trend|phase')} * knot) AS bigint) AS phase,
        0.35 + 1.3 * {u('trend|m0')} AS m0, 0.35 + 1.3 * {u('trend|m1')} AS m1, 0.35 + 1.3 * {u('trend|m2')} AS m2 FROM (SELECT *, shortest + cast(floor({u('trend|knot')} * (longest - shortest + 1)) AS bigint) AS knot FROM (
        SELECT *, greatest(8, least(longest, cast(floor(origin / 8) AS bigint))) AS shortest FROM (SELECT *, greatest(8, least(cast(floor(origin / 3) AS bigint), cast(h AS bigint))) AS longest FROM win WHERE origin >= 16) q) q) q""")
    c.add("trend_profile", """SELECT window_id, dataset, origin, h, m, t, CASE kind WHEN 0 THEN rel WHEN 1 THEN greatest(0, t - onset * (origin - 1)) / (origin - 1) WHEN 2 THEN power(rel, curve) ELSE coalesce(sum(slope) OVER (PARTITION BY window_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS v
        FROM (SELECT *, cast(t AS double) / (origin - 1) AS rel, CASE floor((t + phase) / knot) % 3 WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END / (origin - 1) AS slope FROM (SELECT *, $SEQ(0, origin + h - 1) AS t FROM trend_shape) q) q""")
    c.add("recency", "SELECT w.window_id, b.capability_id, b.level, b.lo + (b.hi - b.lo) * $U(concat(w.window_id, '|', b.capability_id, '|', cast(b.level AS string))) AS coordinate FROM win w CROSS JOIN band b")
    c.add("regime_shape", f"SELECT window_id, dataset, origin, h, m, cast(floor({u('regime|type')} * 3) AS bigint) AS kind, 2 + cast(floor({u('regime|width')} * (greatest(3, least(floor(origin / 10), 64)) - 1)) AS bigint) AS width FROM win WHERE origin >= 40")
    c.add("regime_profile", """SELECT window_id, dataset, origin, h, m, level, t, CASE kind WHEN 0 THEN CASE WHEN t >= change THEN cast(1 AS double) ELSE cast(0 AS double) END WHEN 1 THEN p ELSE p * p * (3 - 2 * p) END AS v FROM (SELECT *, least(greatest((t - change) / cast(width AS double), 0), 1) AS p FROM (
        SELECT s.*, r.level, cast(least(greatest(round(r.coordinate * s.origin), 8), s.origin - 8) AS bigint) AS change, $SEQ(0, s.origin + s.h - 1) AS t FROM regime_shape s JOIN recency r ON s.window_id = r.window_id AND r.capability_id = 'regime_switching') q) q""")
    # Events: gaps that alternate by a jitter, before and after the last event of the history, which is a drawn lag before its end.
    c.add("event_shape", f"""SELECT window_id, dataset, origin, h, m, longest, 1 + cast(floor({u('event|width')} * (least(5, longest) - 1)) AS bigint) AS width, cast(floor({u('event|shape')} * 3) AS bigint) AS kind, 0.12 * {u('event|jitter')} AS jitter
        FROM (SELECT *, least(cast(h AS bigint), greatest(3, cast(floor((origin - 1) / 3) AS bigint))) AS longest FROM win WHERE origin >= 24) q WHERE longest >= 8""")
    c.add("event_gap", """SELECT *, greatest(width + 1, gap + shift) AS a, greatest(width + 1, gap - shift) AS b FROM (SELECT *, least(greatest(0, cast(round(jitter * gap) AS bigint)), cast(floor(gap / 4) AS bigint)) AS shift FROM (
        SELECT s.*, r.level, least(greatest(cast(round(r.coordinate * s.longest) AS bigint), s.width + 1), s.longest) AS gap FROM event_shape s JOIN recency r ON s.window_id = r.window_id AND r.capability_id = 'predictable_intermittency') q) q""")
    c.add("event_lag", "SELECT *, origin - 1 - lag AS tip FROM (SELECT *, $SEQ(0, least(gap, cast(h AS bigint)) - 1) AS lag FROM event_gap) q WHERE origin - 1 - lag - a - b >= 0")
    place = "CASE WHEN oa < width THEN oa WHEN ob < width THEN ob END"
    offsets = "((({0} - tip) % (a + b)) + a + b) % (a + b) AS oa, ((({0} - tip + CASE WHEN {0} < tip THEN a ELSE -a END) % (a + b)) + a + b) % (a + b) AS ob"
    c.add("seen_step", "SELECT window_id, step FROM fut WHERE observed GROUP BY window_id, step")
    c.add("event_plan", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id, level ORDER BY $U(concat(window_id, '|event|', cast(level AS string), '|', cast(lag AS string))), lag) AS place FROM event_lag e WHERE EXISTS (
        SELECT 1 FROM (SELECT window_id, level, lag, {place} AS o FROM (SELECT e.window_id, e.level, e.lag, e.width, {offsets.format('(e.origin + s.step)')} FROM event_lag e JOIN seen_step s ON e.window_id = s.window_id) q) x WHERE x.o IS NOT NULL AND x.window_id = e.window_id AND x.level = e.level AND x.lag = e.lag)) q WHERE place = 1""")
    c.add("event_profile", f"""SELECT window_id, dataset, origin, h, m, level, t, CASE WHEN o IS NULL OR t - o < 0 THEN cast(0 AS double) WHEN kind = 0 OR width = 1 THEN cast(1 AS double) WHEN kind = 1 THEN 1 - abs(o - 0.5 * (width - 1)) / greatest(1.0, 0.5 * (width - 1) + 1) ELSE exp(-ln(2.0) * o / greatest(1.0, 0.5 * width)) END AS v
        FROM (SELECT *, {place} AS o FROM (SELECT *, {offsets.format('t')} FROM (SELECT *, $SEQ(0, origin + h - 1) AS t FROM event_plan) q) q) q""")
    c.add("profile", """SELECT p.window_id, p.dataset, 'trend' AS capability_id, b.level, p.origin, p.h, p.m, p.t, p.v FROM trend_profile p CROSS JOIN band b WHERE b.capability_id = 'trend'
        UNION ALL SELECT window_id, dataset, 'regime_switching', level, origin, h, m, t, v FROM regime_profile UNION ALL SELECT window_id, dataset, 'predictable_intermittency', level, origin, h, m, t, v FROM event_profile""")
    c.add("profile_fit", """SELECT window_id, dataset, capability_id, level, min(origin) AS origin, min(h) AS h, min(m) AS m, max(CASE WHEN t = origin - 1 THEN v END) AS last_value, max(CASE WHEN t = 0 THEN v END) AS first_value, avg(CASE WHEN t < origin THEN v END) AS mean_value, avg(CASE WHEN t >= origin - m AND t < origin THEN v END) AS recent,
        regr_slope(CASE WHEN t < origin THEN v END, cast(t AS double)) AS slope, regr_intercept(CASE WHEN t < origin THEN v END, cast(t AS double)) AS intercept, sqrt(avg(CASE WHEN t < origin THEN v * v END)) AS distance FROM profile GROUP BY window_id, dataset, capability_id, level""")
    c.add("unit_cell", """SELECT l.window_id, l.dataset, l.capability_id, p.level, l.channel_idx, p.t - p.origin AS step, p.origin - p.m + (p.t - p.origin) % p.m AS season_t, l.scale * l.dir * p.v AS unit, u.observed, l.mase, l.scale, l.dir, l.others FROM profile p JOIN loading l ON p.window_id = l.window_id AND p.capability_id = l.capability_id
        JOIN fut u ON u.window_id = p.window_id AND u.channel_idx = l.channel_idx AND u.step = p.t - p.origin WHERE p.t >= p.origin""")
    c.add("unit_future", "SELECT window_id, capability_id, level, count(CASE WHEN observed THEN 1 END) AS cells, sqrt(avg(CASE WHEN observed THEN unit * unit END)) AS raw_rms, sqrt(avg(CASE WHEN observed THEN unit * unit / (mase * mase) END)) AS future_rms FROM unit_cell GROUP BY window_id, capability_id, level")
    # Model contexts. Distances are over the last cells of a history that each context sees.
    c.add("context", "SELECT * FROM (VALUES ('tirex2', 2048), ('Timer-4.0', 8192), ('Chronos-2', 8192), ('Timer-3.5', 11520), ('timesfm2.5', 15360), ('moirai2', 16384), ('toto2.0', 16384)) AS v(model_id, max_context)")
    c.add("context_distance", """SELECT p.window_id, p.capability_id, p.level, k.ctx, sqrt(avg(p.v * p.v)) AS macro FROM profile p
        JOIN (SELECT DISTINCT w.window_id, least(w.origin, x.max_context) AS ctx FROM win w CROSS JOIN (SELECT max_context FROM context UNION SELECT 512) x) k ON p.window_id = k.window_id AND p.t >= p.origin - k.ctx AND p.t < p.origin GROUP BY p.window_id, p.capability_id, p.level, k.ctx""")
    c.add("dose_interval", """SELECT f.window_id, f.capability_id, f.level, f.distance, greatest(b.lo, 0.10 * f.distance / nullif(min(d.macro), 0)) AS lo, least(b.hi, 2.0 * f.distance / nullif(max(d.macro), 0)) AS hi FROM profile_fit f JOIN band b ON f.capability_id = b.capability_id AND f.level = b.level
        JOIN context_distance d ON f.window_id = d.window_id AND f.capability_id = d.capability_id AND f.level = d.level JOIN (SELECT DISTINCT window_id FROM loading WHERE capability_id = 'trend') l ON f.window_id = l.window_id WHERE f.capability_id = 'trend' GROUP BY f.window_id, f.capability_id, f.level, f.distance, b.lo, b.hi""")
    c.add("trend_dose", "SELECT window_id, level, lo, hi, distance, bool_and(lo <= hi + 1e-12) OVER (PARTITION BY window_id) AS feasible FROM dose_interval")
    # One gain for all levels of a window, so that the weakest is seen; the next number up, as the bound itself may round below.
    c.add("shared_gain", """SELECT f.window_id, f.capability_id, min(f.distance) AS weakest, min(u.future_rms) AS weakest_future, greatest(1.0, 0.10 / nullif(min(f.distance), 0), CASE WHEN f.capability_id = 'predictable_intermittency' THEN 0.05 / nullif(min(u.future_rms), 0) ELSE 0.0 END) * CASE WHEN f.capability_id = 'predictable_intermittency' THEN 1.0000000000000002 ELSE 1.0 END AS gain
        FROM profile_fit f JOIN unit_future u ON f.window_id = u.window_id AND f.capability_id = u.capability_id AND f.level = u.level WHERE f.capability_id <> 'trend' GROUP BY f.window_id, f.capability_id HAVING count(*) = 5 AND min(f.distance) > 1e-10""")
    c.add("treatment", """SELECT f.window_id, f.dataset, f.capability_id, f.level, t.lo + (t.hi - t.lo) * $U(concat(f.window_id, '|trend|', cast(f.level AS string))) AS coordinate, f.distance, u.cells, u.future_rms, (t.lo + (t.hi - t.lo) * $U(concat(f.window_id, '|trend|', cast(f.level AS string)))) / nullif(f.distance, 0) AS gain
        FROM profile_fit f JOIN trend_dose t ON f.window_id = t.window_id AND f.level = t.level JOIN unit_future u ON f.window_id = u.window_id AND f.capability_id = u.capability_id AND f.level = u.level WHERE f.capability_id = 'trend' AND t.feasible
        UNION ALL SELECT f.window_id, f.dataset, f.capability_id, f.level, r.coordinate, f.distance, u.cells, u.future_rms, g.gain FROM profile_fit f JOIN shared_gain g ON f.window_id = g.window_id AND f.capability_id = g.capability_id JOIN recency r ON f.window_id = r.window_id AND f.capability_id = r.capability_id AND f.level = r.level
        JOIN unit_future u ON f.window_id = u.window_id AND f.capability_id = u.capability_id AND f.level = u.level WHERE g.capability_id = 'regime_switching' OR g.weakest_future > 1e-12""")
    c.add("structure_reason", """SELECT w.window_id, k.capability_id, CASE WHEN k.capability_id = 'trend' THEN CASE WHEN w.origin < 16 THEN 'history_too_short_for_trend' WHEN l.window_id IS NULL THEN 'history_trend_direction_not_stable' WHEN t.window_id IS NULL THEN 'trend_structure_has_no_feasible_dose' END
        WHEN k.capability_id = 'regime_switching' THEN CASE WHEN w.origin < 40 THEN 'history_too_short_for_five_regime_locations' WHEN t.window_id IS NULL THEN 'regime_switching_weakest_level_not_visible' END
        ELSE CASE WHEN w.origin < 24 THEN 'history_too_short_for_predictable_intermittency' WHEN least(w.h, greatest(3, floor((w.origin - 1) / 3))) < 8 THEN 'history_or_horizon_too_short_for_five_sparse_levels' WHEN coalesce(e.n, 0) < 5 THEN 'no_observed_scheduled_future_event' WHEN t.window_id IS NULL THEN 'future_mechanism_effect_not_observable' END END AS reason
        FROM win w CROSS JOIN capability k LEFT JOIN (SELECT DISTINCT window_id, capability_id FROM affected) l ON w.window_id = l.window_id AND k.capability_id = l.capability_id LEFT JOIN (SELECT DISTINCT window_id, capability_id FROM treatment) t ON w.window_id = t.window_id AND k.capability_id = t.capability_id
        LEFT JOIN (SELECT window_id, count(*) AS n FROM event_plan GROUP BY window_id) e ON w.window_id = e.window_id""")
    # The forecasters are linear, so the forecast of a treated history is the baseline's plus gain times that of the unit treatment.
    blend = "0.5 * c.dir * {0} + 0.5 * (c.dir * f.mean_value + c.others * ({0} - f.mean_value))"
    c.add("unit_fcst", f"""SELECT d.model_id, c.window_id, c.dataset, c.capability_id, c.level, c.channel_idx, c.step, c.unit, c.observed, c.mase, c.scale * c.dir * p.v AS unit_seasonal, c.scale * c.dir * f.last_value AS unit_last, c.scale * CASE d.model_id WHEN 'panel_blend' THEN {blend.format('p.v')} WHEN 'panel_naive' THEN {blend.format('f.last_value')} ELSE c.dir * CASE d.model_id WHEN 'naive' THEN f.last_value WHEN 'seasonal_naive' THEN p.v
        WHEN 'drift' THEN f.last_value + (c.step + 1) * (f.last_value - f.first_value) / greatest(f.origin - 1, 1) WHEN 'mean' THEN f.mean_value WHEN 'moving_average' THEN f.recent ELSE f.intercept + f.slope * (f.origin + c.step) END END AS unit_hat
        FROM unit_cell c JOIN profile_fit f ON c.window_id = f.window_id AND c.capability_id = f.capability_id AND c.level = f.level JOIN profile p ON p.window_id = c.window_id AND p.capability_id = c.capability_id AND p.level = c.level AND p.t = c.season_t CROSS JOIN model d""")
    seen = "CASE WHEN observed THEN {} END"
    c.add("effect_unit", f"""SELECT model_id, window_id, dataset, capability_id, level, count({seen.format(1)}) AS cells, coalesce(sum({seen.format('(unit_hat - unit) * (unit_hat - unit) / (mase * mase)')}), 0) AS sse, coalesce(sum({seen.format('unit * unit / (mase * mase)')}), 0) AS sst, coalesce(sum({seen.format('unit_hat * unit_hat / (mase * mase)')}), 0) AS ssf,
        stddev_pop({seen.format('unit / mase')}) AS su, stddev_pop({seen.format('unit_hat / mase')}) AS sv, covar_pop({seen.format('unit / mase')}, {seen.format('unit_hat / mase')}) AS cov FROM unit_fcst GROUP BY model_id, window_id, dataset, capability_id, level""")
    c.add("effect", """SELECT model_id, dataset, window_id, capability_id, level, coordinate, sse, sst, ssf, cells, truth_rms, status, CASE WHEN status = 'scored' THEN sqrt(sse / sst) END AS nrmse, CASE WHEN status = 'scored' THEN sqrt(ssf / sst) END AS amplitude_ratio, CASE WHEN status = 'scored' AND cells >= 2 AND su > 1e-12 AND sv > 1e-12 THEN cov / (su * sv) END AS correlation
        FROM (SELECT *, CASE WHEN cells = 0 THEN 'unavailable_no_observed_effect_cell' WHEN truth_rms < 0.05 - 1e-12 THEN 'unavailable_low_truth_effect' ELSE 'scored' END AS status FROM (SELECT e.model_id, e.dataset, e.window_id, e.capability_id, t.level, t.coordinate, t.gain * t.gain * e.sse AS sse, t.gain * t.gain * e.sst AS sst, t.gain * t.gain * e.ssf AS ssf, e.cells, coalesce(sqrt(t.gain * t.gain * e.sst / nullif(e.cells, 0)), 0) AS truth_rms, t.gain * e.su AS su, t.gain * e.sv AS sv, t.gain * t.gain * e.cov AS cov
        FROM effect_unit e JOIN treatment t ON e.window_id = t.window_id AND e.capability_id = t.capability_id AND e.level = t.level) q) q""")
    c.add("effect_summary", """SELECT model_id, capability_id, level, count(*) AS candidates, count(CASE WHEN status = 'scored' THEN 1 END) AS scored, count(CASE WHEN status = 'unavailable_low_truth_effect' THEN 1 END) AS low_signal, count(CASE WHEN status = 'unavailable_no_observed_effect_cell' THEN 1 END) AS unobserved, sqrt(sum(CASE WHEN status = 'scored' THEN sse END) / nullif(sum(CASE WHEN status = 'scored' THEN sst END), 0)) AS pooled_nrmse,
        avg(nrmse) AS mean_nrmse, sqrt(sum(CASE WHEN status = 'scored' THEN ssf END) / nullif(sum(CASE WHEN status = 'scored' THEN sst END), 0)) AS pooled_amplitude, avg(correlation) AS mean_correlation FROM effect GROUP BY model_id, capability_id, level""")
