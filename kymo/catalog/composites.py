"""Queries over composite plans, with their check SQL built from shared fragments."""


from pyspark.sql import functions as F

from kymo.catalog.aggregates import sql_circular
from kymo.catalog.frames import sql_half
from kymo.catalog.registry import DAYNO, cal, flags, query, r, rows
from kymo.catalog.scalars import sql_midpoint
from kymo.catalog.show import joined
from kymo.operators import filters
from kymo.plans import baselines, condition, features, quality as dq, rhythm

ON = ["subject_id", "date"]


def ln(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) END"


# ---- quality -------------------------------------------------------------------------

_PRESENT = {n: f"({c} IS NOT NULL{f' AND {c} <> 0' if c in filters.ZERO_IS_ABSENT else ''})" for n, c in filters.COMPLETENESS.items()}
_PCT = "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in _PRESENT.values()) + ") / 7.0e0"
_PASS = " AND ".join(f"coalesce({c} BETWEEN {lo} AND {hi}, TRUE)" for c, lo, hi in filters.PLAUSIBLE.values())


@query(
    "data_quality",
    f"""WITH h AS (SELECT subject_id, CAST(time AS DATE) AS date, count(*) AS n FROM heart_rate GROUP BY ALL),
a AS (SELECT d.subject_id, d.date, coalesce(h.n, 0) AS n, coalesce(h.n, 0) / 60.0e0 AS wear, {_PCT} AS pct, {_PASS} AS pass FROM daily d LEFT JOIN h USING (subject_id, date)),
v AS (SELECT *, wear >= 0.03 AND pass AS valid FROM a),
b AS (SELECT *, count(CASE WHEN valid THEN 1 END) {cal(60)} AS days FROM v),
s AS (SELECT *, 0.4e0 * pct + 0.3e0 * least(1.0e0, wear / 16) + 0.3e0 * least(1.0e0, days / 60.0e0) AS score FROM b)
SELECT subject_id, date, CAST(n AS BIGINT) AS hr_sample_count, {r('wear')} AS wear_time_hours, {r('pct')} AS completeness_pct, pass AS plausibility_pass, valid AS is_valid_day,
  CAST(days AS BIGINT) AS baseline_days, CASE WHEN days < 14 THEN 'cold' WHEN days < 60 THEN 'warming' ELSE 'mature' END AS baseline_maturity,
  {r('score')} AS confidence_score, CASE WHEN score < 0.4 THEN 'low' WHEN score <= 0.7 THEN 'medium' ELSE 'high' END AS confidence_level FROM s""",
)
def _(v):
    out = dq.data_quality(v.daily, v.heart_rate, min_wear=0.03)
    return out.select(
        *ON, "hr_sample_count", "wear_time_hours", "completeness_pct", "plausibility_pass", "is_valid_day", "baseline_days",
        "baseline_maturity", "confidence_score", "confidence_level",
    )


_FEATURE_SQL = (
    "SELECT d.*, "
    + ", ".join(f"avg({c}) {cal(7)} AS {n}" for n, c in features.WEEK_MEANS.items())
    + " FROM daily d"
)
_DELTAS = ", ".join(f"{c} - {m} AS {n}" for n, (c, m) in features.LINEAR_DELTAS.items()) + ", hrv_daily_rmssd - hrv_7d AS hrv_delta"
_WITH_FEATURES = f"""w AS ({_FEATURE_SQL}), f AS (SELECT w.*, {_DELTAS}, CAST(dayofweek(date) AS INT) AS day_of_week,
  q.is_valid_day, q.completeness_pct, q.confidence_score, q.wear_time_hours FROM w LEFT JOIN quality q USING (subject_id, date))"""
_FEATURE_COLS = [*features.WEEK_MEANS, *features.LINEAR_DELTAS, "hrv_delta", "completeness_pct"]


@query(
    "daily_features",
    f"WITH {_WITH_FEATURES} SELECT subject_id, date, {', '.join(f'{r(c)} AS {c}' for c in _FEATURE_COLS)}, day_of_week, is_valid_day FROM f",
)
def _(v):
    return features.daily_features(v.daily, v.quality).select(*ON, *_FEATURE_COLS, "day_of_week", "is_valid_day")


@query(
    "risk_signals",
    f"""WITH {_WITH_FEATURES} SELECT subject_id, date, {flags(*[(n, f'coalesce(is_valid_day, TRUE) AND {c} {op} {x}') for n, c, op, x in filters.RISK_RULES])} AS risks FROM f""",
)
def _(v):
    f = features.daily_features(v.daily, v.quality)
    return filters.risk_signals(f).select(*ON, joined("risk_signals").alias("risks"))


# ---- feature matrices ----------------------------------------------------------------


def _matrix_sql(frame: str, names: list[str], extra: str = "", more: str = "") -> str:
    w7, w3 = (cal(7), cal(3)) if frame == "calendar" else (rows(7), rows(3))
    series = f"OVER (PARTITION BY subject_id ORDER BY {DAYNO})"
    prev = (lambda c: f"max({c}) {cal(1)}") if frame == "calendar" else (lambda c: f"lag({c}) {series}")
    return f"""w AS (SELECT *, {', '.join(f'avg({c}) {w7} AS {n}' for n, c in features.WEEK_MEANS.items())}, avg({ln('hrv_deep_rmssd')}) {w7} AS deep_7d,
  stddev_pop(resting_hr) {w3} AS rhr_3d_std, stddev_pop(hrv_daily_rmssd) {w3} AS hrv_3d_std, stddev_pop(sleep_duration_min) {w3} AS sleep_3d_std,
  {prev('resting_hr')} AS p_rhr, {prev('hrv_daily_rmssd')} AS p_hrv, {ln('hrv_daily_rmssd')} AS hrv_ln_rmssd, {ln('hrv_deep_rmssd')} AS hrv_deep_ln_rmssd{more} FROM daily),
m AS (SELECT *, CASE WHEN hrv_deep_rmssd > 0 AND hrv_daily_rmssd > 0 THEN hrv_deep_rmssd / hrv_daily_rmssd END AS hrv_deep_daily_ratio, hrv_deep_ln_rmssd - deep_7d AS hrv_deep_delta,
  {', '.join(f'{c} - {x} AS {n}' for n, (c, x) in features.LINEAR_DELTAS.items())}, hrv_ln_rmssd - {ln('hrv_7d')} AS hrv_delta,
  CASE WHEN p_rhr > 0 THEN (resting_hr - p_rhr) / CAST(p_rhr AS DOUBLE) END AS rhr_change_rate,
  CASE WHEN p_hrv > 0 AND hrv_daily_rmssd > 0 AND ln(p_hrv) <> 0 THEN (ln(hrv_daily_rmssd) - ln(p_hrv)) / ln(p_hrv) END AS hrv_change_rate,
  CAST(dayofweek(date) AS DOUBLE) AS day_of_week, sin(2 * pi() * dayofweek(date) / 7.0e0) AS dow_sin, cos(2 * pi() * dayofweek(date) / 7.0e0) AS dow_cos{extra} FROM w)"""


def _matrix_cols(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"{r(f'CAST({c} AS DOUBLE)', digits)} AS {c}" for c in names)


for _name, _frame in (("anomaly_feature_matrix", "calendar"), ("anomaly_feature_matrix_rows", "rows")):

    @query(
        _name,
        f"WITH {_matrix_sql(_frame, features.ANOMALY_FEATURES)} SELECT subject_id, date, {_matrix_cols(features.ANOMALY_FEATURES)}, q.is_valid_day FROM m LEFT JOIN quality q USING (subject_id, date)",
    )
    def _(v, frame=_frame):
        return features.anomaly_feature_matrix(v.daily, v.quality, frame)


def _z_sql(x: str, m: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 AND {x} IS NOT NULL THEN 0.6745e0 * ({x} - {m}) / {d} END"


_HRV_X = {"rhr": "resting_hr", "hrv": "hrv_ln_rmssd", "sleep_dur": "sleep_duration_min"}
_HRV_RAW = {"rhr": "resting_hr", "hrv": ln("hrv_daily_rmssd"), "sleep_dur": "sleep_duration_min"}
_CAL_STATS = "".join(f", quantile_cont({x}, 0.5) {cal(60)} AS m_{n}, mad(CAST({x} AS DOUBLE)) {cal(60)} AS d_{n}" for n, x in _HRV_RAW.items())
_ROW_DAYS = {"rhr": 60, "hrv": 14, "sleep_dur": 60}
_ROW_STATS = "".join(
    f", quantile_cont({x}, 0.5) {cal(_ROW_DAYS[n])} AS m_{n}, stddev_pop({x}) {rows(_ROW_DAYS[n])} * 0.6745e0 AS d_{n}" for n, x in _HRV_RAW.items()
) + f", lead(hrv_daily_rmssd) OVER (PARTITION BY subject_id ORDER BY {DAYNO}) AS next_hrv"
_HRV_Z = "".join(f", {_z_sql(x, f'm_{n}', f'd_{n}')} AS z_{n}" for n, x in _HRV_X.items())


@query(
    "hrv_feature_matrix",
    f"WITH {_matrix_sql('calendar', features.HRV_FEATURES, _HRV_Z, _CAL_STATS)} SELECT subject_id, date, {_matrix_cols(features.HRV_FEATURES, 9)} FROM m",
    digits=9,
)
def _(v):
    return features.hrv_feature_matrix(v.daily)


_TARGET = _z_sql(ln("next_hrv"), "m_hrv", "d_hrv")


@query(
    "hrv_feature_matrix_rows",
    f"WITH {_matrix_sql('rows', features.HRV_FEATURES, _HRV_Z + f', {_TARGET} AS target_hrv_zscore', _ROW_STATS)} SELECT subject_id, date, {_matrix_cols([*features.HRV_FEATURES, 'target_hrv_zscore'], 9)} FROM m",
    digits=9,
)
def _(v):
    return features.hrv_feature_matrix(v.daily, frame="rows")


@query(
    "divergence_feature_matrix",
    f"""SELECT d.subject_id, d.date, c.id AS condition_log_id, c.mood_vas IS NULL AS is_legacy, CAST(c.overall_vas AS DOUBLE) AS target_score, CAST(d.resting_hr AS DOUBLE) AS resting_hr,
  {r(ln('d.hrv_daily_rmssd'))} AS hrv_ln_rmssd, CAST(d.steps AS DOUBLE) AS steps, {r('d.spo2_avg')} AS spo2_avg, {r('d.skin_temp_variation')} AS skin_temp_variation, CAST(dayofweek(d.date) AS DOUBLE) AS day_of_week
FROM condition_logs c JOIN daily d ON d.subject_id = c.subject_id AND d.date = CAST(c.logged_at AS DATE)
LEFT JOIN quality q ON q.subject_id = d.subject_id AND q.date = d.date WHERE q.is_valid_day IS NOT FALSE""",
)
def _(v):
    out = features.divergence_feature_matrix(v.daily, v.condition_logs, v.quality)
    return out.select(
        *ON, "condition_log_id", "is_legacy", "target_score", "resting_hr", "hrv_ln_rmssd", "steps", "spo2_avg", "skin_temp_variation", "day_of_week"
    )


# ---- baselines and recovery score ----------------------------------------------------


def _value_sql(m: baselines.Metric) -> str:
    if m.log:
        return ln(m.column)
    return f"nullif(CAST({m.column} AS DOUBLE), 0)" if m.zero_missing else f"CAST({m.column} AS DOUBLE)"


def _stats_sql(values: dict[str, str], ok: str, source: str) -> str:
    masked = ", ".join(f"CASE WHEN {ok} THEN {x} END AS x_{n}" for n, x in values.items())
    stats = ", ".join(
        f"CASE WHEN count(x_{n}) {cal(60)} >= 7 THEN quantile_cont(x_{n}, 0.5) {cal(60)} END AS {n}_median, "
        f"CASE WHEN count(x_{n}) {cal(60)} >= 7 THEN mad(x_{n}) {cal(60)} END AS {n}_mad, count(x_{n}) {cal(60)} AS {n}_count"
        for n in values
    )
    return f"v AS (SELECT *, {masked} FROM {source}), b AS (SELECT *, {stats}, count(CASE WHEN {ok} THEN 1 END) {cal(60)} AS total FROM v)"


_BASE = f"""d AS (SELECT a.*, coalesce(q.is_valid_day, TRUE) AS ok, q.confidence_score AS quality_score FROM daily a LEFT JOIN quality q USING (subject_id, date)),
{_stats_sql({m.name: _value_sql(m) for m in baselines.BASELINE}, 'ok', 'd')}"""


@query(
    "rolling_baseline",
    f"WITH {_BASE} SELECT subject_id, date, "
    + ", ".join(f"{r(f'{m.name}_median')} AS {m.name}_median, {r(f'{m.name}_mad')} AS {m.name}_mad, CAST({m.name}_count AS BIGINT) AS {m.name}_count" for m in baselines.BASELINE)
    + ", CAST(total AS BIGINT) AS total_valid_days FROM b",
)
def _(v):
    cols = [f"{m.name}_{s}" for m in baselines.BASELINE for s in ("median", "mad", "count")]
    return baselines.rolling_baseline(v.daily, v.quality).select(*ON, *cols, "total_valid_days")


def _sri_sql(targets: str = "") -> str:
    extra = f" UNION SELECT subject_id, date FROM {targets}" if targets else ""
    return f"""ep AS (SELECT subject_id, e, arg_max(s, time) AS s FROM (SELECT subject_id, time, stage IN ('deep', 'light', 'rem') AS s,
    unnest(range(CAST(floor((epoch_us(time) - 43200000000) / 30000000.0e0) AS BIGINT), CAST(floor((epoch_us(time) - 43200000000) / 30000000.0e0) AS BIGINT) + seconds // 30)) AS e FROM sleep_stages) x GROUP BY subject_id, e),
  pr AS (SELECT a.subject_id, DATE '1970-01-01' + CAST(a.e // 2880 + 1 AS INT) AS date, count(*) AS pairs, count(*) FILTER (WHERE a.s = b.s) AS matches
    FROM ep a JOIN ep b ON b.subject_id = a.subject_id AND b.e = a.e + 2880 GROUP BY ALL),
  dy AS (SELECT DISTINCT subject_id, DATE '1970-01-01' + CAST(e // 2880 + 1 AS INT) AS date FROM ep),
  tg AS (SELECT subject_id, date FROM dy{extra}),
  sw AS (SELECT t.subject_id, t.date, (SELECT count(*) FROM dy WHERE dy.subject_id = t.subject_id AND dy.date BETWEEN t.date - 7 AND t.date) AS days_used,
    (SELECT coalesce(sum(pairs), 0) FROM pr WHERE pr.subject_id = t.subject_id AND pr.date BETWEEN t.date - 7 AND t.date - 1) AS pairs,
    (SELECT coalesce(sum(matches), 0) FROM pr WHERE pr.subject_id = t.subject_id AND pr.date BETWEEN t.date - 7 AND t.date - 1) AS matches FROM tg t),
  sri AS (SELECT subject_id, date, CASE WHEN days_used >= 7 AND pairs > 0 THEN matches * 100.0e0 / pairs END AS sri, CAST(days_used AS BIGINT) AS days_used, CAST(pairs AS BIGINT) AS pairs FROM sw)"""


@query("sri", f"WITH {_sri_sql()} SELECT subject_id, date, {r('sri')} AS sri, days_used, pairs FROM sri")
def _(v):
    return rhythm.sri(v.sleep_stages)


def _zsql(m: baselines.Metric, base: str, value: str | None = None) -> str:
    x = value or _value_sql(m)
    return f"CASE WHEN {base}_median IS NOT NULL AND {x} IS NOT NULL THEN CASE WHEN {base}_mad = 0 THEN 0.0e0 ELSE 0.6745e0 * ({x} - {base}_median) / {base}_mad END END"


def _maturity(n: str) -> str:
    return f"CASE WHEN {n} < 14 THEN {n} / 14.0e0 * 0.5e0 WHEN {n} < 30 THEN 0.5e0 + ({n} - 14) / 16.0e0 * 0.3e0 ELSE least(1.0e0, 0.8e0 + ({n} - 30) / 30.0e0 * 0.2e0) END"


def _composite_sql(directions: dict[str, int], prefix: str, quality: str = "") -> str:
    items = ", ".join(f"CASE WHEN z_{n} IS NOT NULL THEN greatest(-3.0e0, least(3.0e0, z_{n} * {d})) END" for n, d in directions.items())
    return f"""c AS (SELECT *, list_filter([{items}], lambda x: x IS NOT NULL) AS zs FROM z),
s AS (SELECT *, CASE WHEN len(zs) = 0 THEN 50.0e0 ELSE round_even(50 + 50 * tanh(list_sum(zs) / len(zs) / 2), 1) END AS {prefix}_score,
  CASE WHEN len(zs) = 0 THEN 0.0e0 ELSE round_even(least({quality}len(zs) / {len(directions)}.0e0, {_maturity('total')}), 3) END AS {prefix}_confidence FROM c)"""


def _included(directions) -> str:
    arms = " UNION ALL ".join(
        f"SELECT subject_id, date, '{n}' AS metric, {i} AS i, abs(greatest(-3.0e0, least(3.0e0, z_{n} * {d}))) AS size FROM s WHERE z_{n} IS NOT NULL" for i, (n, d) in enumerate(directions.items())
    )
    return f"inc AS (SELECT subject_id, date, string_agg(metric, ',' ORDER BY size DESC, i) AS metrics FROM ({arms}) t GROUP BY subject_id, date)"


_DIR = {n: m.direction for n, (m, _) in baselines.RECOVERY.items()}
_VRI_Z = ", ".join(f"{'CAST(NULL AS DOUBLE)' if n == 'sri' else _zsql(m, base)} AS z_{n}" for n, (m, base) in baselines.RECOVERY.items())
_VRI = f"""{_BASE}, z AS (SELECT *, {_VRI_Z} FROM b), {_composite_sql(_DIR, 'vri', 'coalesce(quality_score, 1.0e0), ')}"""


@query(
    "vri",
    f"""WITH {_sri_sql('daily')}, {_VRI}, {_included(_DIR)}
SELECT s.subject_id, s.date, vri_score, vri_confidence, {', '.join(f'{r(f"z_{n}", 9)} AS z_{n}' for n in _DIR if n != 'sri')}, {r('sri.sri', 9)} AS sri_value, sri.days_used AS sri_days_used,
  CAST(total AS BIGINT) AS total_valid_days, CASE WHEN total < 14 THEN 'cold' WHEN total < 30 THEN 'warming' ELSE 'warm' END AS baseline_maturity, coalesce(inc.metrics, '') AS metrics
FROM s LEFT JOIN sri USING (subject_id, date) LEFT JOIN inc USING (subject_id, date)""",
    digits=9,
)
def _(v):
    out = baselines.vri(v.daily, v.sleep_stages, v.quality)
    return out.select(
        *ON, "vri_score", "vri_confidence", *[f"z_{n}" for n in _DIR if n != "sri"], "sri_value", "sri_days_used", "total_valid_days",
        "baseline_maturity", joined("metrics_included").alias("metrics"),
    )


@query(
    "vri_with_sri_baseline",
    f"""WITH {_sri_sql('daily')}, d AS (SELECT a.*, coalesce(q.is_valid_day, TRUE) AS ok, q.confidence_score AS quality_score, i.sri AS sri_value FROM daily a LEFT JOIN quality q USING (subject_id, date) LEFT JOIN sri i USING (subject_id, date)),
{_stats_sql({**{m.name: _value_sql(m) for m in baselines.BASELINE}, 'sri': 'sri_value'}, 'ok', 'd')},
z AS (SELECT *, {', '.join(f'{_zsql(m, base)} AS z_{n}' for n, (m, base) in baselines.RECOVERY.items())} FROM b), {_composite_sql(_DIR, 'vri', 'coalesce(quality_score, 1.0e0), ')}
SELECT subject_id, date, vri_score, vri_confidence, {r('z_sri', 9)} AS z_sri FROM s""",
    digits=9,
)
def _(v):
    out = baselines.vri(v.daily, v.sleep_stages, v.quality, sri_baseline=True)
    return out.select(*ON, "vri_score", "vri_confidence", "z_sri")


@query(
    "vri_factors",
    "WITH "
    + _VRI
    + ", a AS ("
    + " UNION ALL ".join(f"SELECT subject_id, date, '{n}' AS metric, {i} AS i, round_even(abs(z_{n}), 3) AS x FROM s WHERE z_{n} IS NOT NULL" for i, n in enumerate(_DIR) if n != "sri")
    + "), g AS (SELECT subject_id, date, string_agg(metric, ',' ORDER BY x DESC, i) AS metrics, count(*) AS n FROM a GROUP BY subject_id, date) "
    + "SELECT s.subject_id, s.date, coalesce(g.metrics, '') AS metrics, CAST(coalesce(g.n, 0) AS INT) AS n FROM s LEFT JOIN g USING (subject_id, date)",
)
def _(v):
    stored = baselines.vri(v.daily, None, v.quality).drop("contributing_factors")
    out = baselines.vri_factors(stored)
    names = F.transform("contributing_factors", lambda f: f.metric)
    return out.select(*ON, F.concat_ws(",", names).alias("metrics"), F.size("contributing_factors").alias("n"))


# ---- rhythm --------------------------------------------------------------------------

_NOON = "CAST(time + INTERVAL '12' HOUR AS DATE)"
_HOURS = "((epoch_us(time) + 43200000000) % 86400000000 / 3600000000.0e0)"
_COS = f"""x AS (SELECT subject_id, {_NOON} AS date, CAST(bpm AS DOUBLE) AS y, cos({_HOURS} * 2 * pi() / 24) AS c, sin({_HOURS} * 2 * pi() / 24) AS s FROM heart_rate),
m AS (SELECT subject_id, date, count(*) AS n, avg(y) AS y, avg(c) AS c, avg(s) AS s, avg(c * c) - avg(c) * avg(c) AS vc, avg(s * s) - avg(s) * avg(s) AS vs, avg(c * s) - avg(c) * avg(s) AS vcs,
  avg(y * c) - avg(y) * avg(c) AS kc, avg(y * s) - avg(y) * avg(s) AS ks FROM x GROUP BY subject_id, date),
g AS (SELECT *, CASE WHEN n >= 4 AND vc * vs - vcs * vcs > 1e-12 THEN vc * vs - vcs * vcs END AS det FROM m),
h AS (SELECT *, (kc * vs - ks * vcs) / det AS b1, (ks * vc - kc * vcs) / det AS b2 FROM g),
fit AS (SELECT subject_id, date, n, y - b1 * c - b2 * s AS mesor, sqrt(b1 * b1 + b2 * b2) AS amplitude, (atan2(-b2, b1) * 24 / (2 * pi()) + 36) % 24 AS acrophase FROM h)"""


@query(
    "cosinor",
    f"WITH {_COS} SELECT subject_id, date, CAST(n AS BIGINT) AS n_samples, {r('mesor', 3)} AS mesor, {r('amplitude', 3)} AS amplitude, {r('acrophase', 3)} AS acrophase_hour FROM fit",
    digits=3,
)
def _(v):
    return rhythm.cosinor(v.heart_rate, min_samples=4, digits=None)


# Thirty days as one window, so that every hour of the matrix is covered.
_NPAR_DAYS = 30
_NPAR = f"""cells AS (SELECT subject_id, {_NOON} AS date, CAST(floor({_HOURS}) AS INT) AS h, avg(bpm) AS m FROM heart_rate GROUP BY ALL),
t AS (SELECT DISTINCT subject_id, date FROM cells),
grid AS (SELECT t.subject_id, t.date, CAST(d AS INT) AS d, CAST(h AS INT) AS h, t.date - {_NPAR_DAYS - 1} + CAST(d AS INT) AS on_date FROM t, (SELECT unnest(range({_NPAR_DAYS})) AS d) a, (SELECT unnest(range(24)) AS h) b),
j AS (SELECT g.*, c.m FROM grid g LEFT JOIN cells c ON c.subject_id = g.subject_id AND c.date = g.on_date AND c.h = g.h),
cov AS (SELECT subject_id, date, count(*) AS days FROM (SELECT subject_id, date, d FROM j GROUP BY ALL HAVING count(m) >= 1) q GROUP BY ALL),
hm AS (SELECT subject_id, date, h, avg(m) AS hm FROM j GROUP BY ALL),
ok AS (SELECT hm.subject_id, hm.date FROM hm JOIN cov USING (subject_id, date) GROUP BY ALL HAVING count(hm) = 24 AND max(days) >= 3),
f AS (SELECT j.subject_id, j.date, j.d, j.h, coalesce(j.m, hm.hm) AS x FROM j JOIN hm USING (subject_id, date, h) JOIN ok USING (subject_id, date)),
st AS (SELECT *, avg(x) OVER (PARTITION BY subject_id, date) AS mean, x - lag(x) OVER (PARTITION BY subject_id, date ORDER BY d, h) AS step FROM f),
ag AS (SELECT subject_id, date, sum((x - mean) * (x - mean)) AS every, sum(step * step) AS moved, max(mean) AS mean FROM st GROUP BY ALL),
bt AS (SELECT hm.subject_id, hm.date, sum((hm - ag.mean) * (hm - ag.mean)) AS between FROM hm JOIN ag USING (subject_id, date) GROUP BY ALL),
l AS (SELECT subject_id, date, h, x FROM f WHERE d = {_NPAR_DAYS - 1}), l2 AS (SELECT * FROM l UNION ALL SELECT subject_id, date, h + 24, x FROM l),
sl AS (SELECT subject_id, date, h, round(sum(x) OVER (PARTITION BY subject_id, date ORDER BY h ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) / 10, 9) AS m10,
  round(sum(x) OVER (PARTITION BY subject_id, date ORDER BY h ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) / 5, 9) AS l5 FROM l2 QUALIFY h < 24),
ex AS (SELECT subject_id, date, max(m10) AS top, min(l5) AS low FROM sl GROUP BY ALL),
ats AS (SELECT sl.subject_id, sl.date, min(h) FILTER (WHERE m10 = top) AS top_at, min(h) FILTER (WHERE l5 = low) AS low_at FROM sl JOIN ex USING (subject_id, date) GROUP BY ALL),
np AS (SELECT ag.subject_id, ag.date, CASE WHEN every > 0 THEN {_NPAR_DAYS * 24}.0e0 * between / (24 * every) ELSE 0 END AS i_s, CASE WHEN every > 0 THEN {_NPAR_DAYS * 24}.0e0 * moved / ({_NPAR_DAYS * 24 - 1} * every) ELSE 0 END AS i_v,
  CASE WHEN top + low > 0 THEN (top - low) / (top + low) ELSE 0 END AS r_a, top, low, top_at, low_at FROM ag JOIN bt USING (subject_id, date) JOIN ex USING (subject_id, date) JOIN ats USING (subject_id, date)),
npar AS (SELECT t.subject_id, t.date, greatest(0.0e0, least(1.0e0, i_s)) + 0 * i_s AS npar_is, greatest(0.0e0, least(2.0e0, i_v)) + 0 * i_v AS npar_iv, greatest(0.0e0, least(1.0e0, r_a)) + 0 * r_a AS npar_ra, top, low,
  CAST((top_at + 12) % 24 AS DOUBLE) AS m10_start_hour, CAST((low_at + 12) % 24 AS DOUBLE) AS l5_start_hour FROM t LEFT JOIN np USING (subject_id, date))"""
_NPAR_OPTIONS = dict(window_days=_NPAR_DAYS, min_per_cell=1, min_hours=1)


@query(
    "npar",
    f"""WITH {_NPAR} SELECT subject_id, date, {r('npar_is')} AS npar_is, {r('npar_iv')} AS npar_iv, {r('npar_ra')} AS npar_ra, {r('top')} AS m10_value, m10_start_hour, {r('low')} AS l5_value, l5_start_hour FROM npar""",
)
def _(v):
    return rhythm.npar(v.heart_rate, digits=None, **_NPAR_OPTIONS)


_MEAN = lambda x: sql_circular(x, f" {cal(6, True)}")
_TIMING = f"""mid AS (SELECT subject_id, date, CASE WHEN sleep_start IS NOT NULL AND sleep_end IS NOT NULL THEN {sql_midpoint()} END AS mid, isodow(date) >= 6 AS we FROM daily),
m2 AS (SELECT *, CASE WHEN we THEN mid END AS m_we, CASE WHEN NOT we THEN mid END AS m_wd FROM mid),
tw AS (SELECT subject_id, date, count(mid) {cal(6, True)} AS n, last_value(mid IGNORE NULLS) {cal(6, True)} AS today, {_MEAN('mid')[1]} AS sd,
  CASE WHEN count(m_we) {cal(6, True)} > 0 THEN {_MEAN('m_we')[0]} END AS a_we, CASE WHEN count(m_wd) {cal(6, True)} > 0 THEN {_MEAN('m_wd')[0]} END AS a_wd FROM m2),
timing AS (SELECT subject_id, date, CASE WHEN n >= 3 THEN today / 60 END AS midpoint, CASE WHEN n >= 3 THEN sd END AS sd,
  CASE WHEN n >= 3 THEN coalesce(CASE WHEN abs(a_we - a_wd) > 720 THEN 1440 - abs(a_we - a_wd) ELSE abs(a_we - a_wd) END, 0.0e0) END AS jetlag FROM tw)"""


@query(
    "sleep_timing",
    f"WITH {_TIMING} SELECT subject_id, date, {r('midpoint')} AS sleep_midpoint_hour, {r('sd')} AS sleep_midpoint_var_min, {r('jetlag')} AS social_jetlag_min FROM timing",
)
def _(v):
    return rhythm.sleep_timing(v.daily, digits=None)


_DIP = f"""inside AS (SELECT h.*, EXISTS (SELECT 1 FROM sleep_stages s WHERE s.subject_id = h.subject_id AND s.stage IN ('deep', 'light', 'rem') AND s.time <= h.time AND h.time < s.time + to_seconds(s.seconds)) AS zz FROM heart_rate h),
dn AS (SELECT subject_id, {_NOON} AS date, count(*) AS n, avg(CASE WHEN extract('hour' FROM time) >= 10 AND extract('hour' FROM time) < 22 THEN bpm END) AS day, avg(CASE WHEN zz THEN bpm END) AS night FROM inside GROUP BY ALL),
dip AS (SELECT subject_id, date, CASE WHEN n >= 3 AND night IS NOT NULL AND day <> 0 THEN (day - night) / day * 100 END AS dip, CASE WHEN n >= 3 AND night IS NOT NULL AND day <> 0 THEN day END AS day,
  CASE WHEN n >= 3 AND night IS NOT NULL AND day <> 0 THEN night END AS night, n FROM dn)"""


@query(
    "nocturnal_dip",
    f"WITH {_DIP} SELECT subject_id, date, CAST(n AS BIGINT) AS n_samples, {r('dip')} AS nocturnal_dip_pct, {r('day')} AS daytime_mean_hr, {r('night')} AS nighttime_mean_hr FROM dip",
)
def _(v):
    return rhythm.nocturnal_dip(v.heart_rate, v.sleep_stages, min_samples=3, digits=None)


def _circadian(v):
    """Circadian table with unrounded metrics, so both engines score the same numbers."""
    fit = rhythm.cosinor(v.heart_rate, min_samples=4, digits=None).select(*ON, F.col("amplitude").alias("cosinor_amplitude"))
    rest = rhythm.npar(v.heart_rate, digits=None, **_NPAR_OPTIONS).select(*ON, "npar_is", "npar_iv")
    timing = rhythm.sleep_timing(v.daily, digits=None).select(*ON, "sleep_midpoint_var_min")
    dip = rhythm.nocturnal_dip(v.heart_rate, v.sleep_stages, min_samples=3, digits=None).select(*ON, "nocturnal_dip_pct")
    return fit.join(rest, ON, "full").join(timing, ON, "full").join(dip, ON, "full")


_CIRC_X = {
    "amplitude": "cosinor_amplitude", "is": "npar_is", "iv": "npar_iv", "midpoint_var": "sleep_midpoint_var_min", "dip_pct": "-abs(nocturnal_dip_pct - 15)",
}
_CIRC = f"""{_COS}, {_NPAR.replace('f AS (', 'fl AS (').replace(' FROM f)', ' FROM fl)').replace('FROM f WHERE', 'FROM fl WHERE').replace('t AS (SELECT DISTINCT', 'td AS (SELECT DISTINCT').replace('FROM t, (', 'FROM td t, (').replace('FROM t LEFT JOIN np', 'FROM td t LEFT JOIN np')}, {_TIMING}, {_DIP},
circ AS (SELECT subject_id, date, fit.amplitude AS cosinor_amplitude, npar.npar_is, npar.npar_iv, timing.sd AS sleep_midpoint_var_min, dip.dip AS nocturnal_dip_pct
  FROM fit FULL OUTER JOIN npar USING (subject_id, date) FULL OUTER JOIN timing USING (subject_id, date) FULL OUTER JOIN dip USING (subject_id, date)),
{_stats_sql(_CIRC_X, 'cosinor_amplitude IS NOT NULL', 'circ')}"""


@query(
    "circadian_baseline",
    f"WITH {_CIRC} SELECT subject_id, date, "
    + ", ".join(f"{r(f'{n}_median', 3)} AS {n}_median, {r(f'{n}_mad', 3)} AS {n}_mad, CAST({n}_count AS BIGINT) AS {n}_count" for n in _CIRC_X)
    + ", CAST(total AS BIGINT) AS total_valid_days FROM b",
    digits=3,
)
def _(v):
    cols = [f"{n}_{s}" for n in _CIRC_X for s in ("median", "mad", "count")]
    return rhythm.circadian_baseline(_circadian(v)).select(*ON, *cols, "total_valid_days")


_CHS_DIR = {n: m.direction for n, (m, _) in rhythm.CIRCADIAN.items()}
_CHS_Z = ", ".join(f"{_zsql(m, base, _CIRC_X[base])} AS z_{n}" for n, (m, base) in rhythm.CIRCADIAN.items())


@query(
    "chs",
    f"""WITH {_CIRC}, z AS (SELECT *, {_CHS_Z} FROM b), {_composite_sql(_CHS_DIR, 'chs')} SELECT subject_id, date, chs_score, chs_confidence, CAST(total AS BIGINT) AS total_valid_days FROM s""",
)
def _(v):
    return rhythm.chs(_circadian(v)).select(*ON, "chs_score", "chs_confidence", "total_valid_days")


# ---- condition -----------------------------------------------------------------------

_POINTS = {
    "hrv": "CASE WHEN hrv_delta > 5 THEN 6 WHEN hrv_delta < -10 THEN -10 ELSE 0 END",
    "sleep_duration": "CASE WHEN sleep_duration_min / 60.0e0 BETWEEN 7 AND 9 THEN 6 WHEN sleep_duration_min / 60.0e0 < 5 THEN -16 ELSE 0 END",
    "deep_sleep": "CASE WHEN sleep_deep_min >= 60 THEN 4 WHEN sleep_deep_min < 30 THEN -6 ELSE 0 END",
    "resting_hr": "CASE WHEN resting_hr_delta > 5 THEN -8 ELSE 0 END",
    "spo2": "CASE WHEN spo2_avg < 93 THEN -10 ELSE 0 END",
    "steps": "CASE WHEN steps_delta > 3000 THEN 4 WHEN steps_delta < -5000 THEN -4 ELSE 0 END",
}
_SCORED = f"""{_WITH_FEATURES}, p AS (SELECT *, {', '.join(f'CASE WHEN coalesce(is_valid_day, TRUE) THEN {x} ELSE 0 END AS p_{n}' for n, x in _POINTS.items())} FROM f),
cs AS (SELECT *, greatest(0.0e0, least(100.0e0, 50.0e0 + {' + '.join(f'p_{n}' for n in _POINTS)})) AS predicted_score,
  CASE WHEN coalesce(is_valid_day, TRUE) THEN least(0.4e0, confidence_score) ELSE 0.1e0 END AS confidence FROM p),
fa AS ({' UNION ALL '.join(f"SELECT subject_id, date, '{n}' AS feature, {i} AS i, p_{n} AS x FROM cs WHERE p_{n} <> 0" for i, n in enumerate(_POINTS))}),
fs AS (SELECT subject_id, date, string_agg(feature, ',' ORDER BY abs(x) DESC, i) AS factors FROM fa GROUP BY subject_id, date)"""


@query(
    "condition_score",
    f"WITH {_SCORED} SELECT cs.subject_id, cs.date, {r('predicted_score')} AS predicted_score, {r('confidence')} AS confidence, coalesce(factors, '') AS factors FROM cs LEFT JOIN fs USING (subject_id, date)",
)
def _(v):
    out = condition.condition_score(features.daily_features(v.daily, v.quality))
    names = F.transform("contributing_factors", lambda f: f.feature)
    return out.select(*ON, "predicted_score", "confidence", F.concat_ws(",", names).alias("factors"))


@query(
    "condition_forecast",
    f"""WITH {_SCORED} SELECT cs.subject_id, cs.date, {r('predicted_score')} AS predicted_score, {r('greatest(confidence, CASE WHEN spo2_avg IS NOT NULL THEN spo2_avg / 200 END)', 9)} AS confidence,
  coalesce(factors, '') || CASE WHEN spo2_avg IS NULL THEN '' WHEN factors IS NULL THEN 'hrv_prediction' ELSE ',hrv_prediction' END AS factors,
  {flags(*[(n, f'coalesce(is_valid_day, TRUE) AND {c} {op} {x}') for n, c, op, x in filters.RISK_RULES])} AS risks FROM cs LEFT JOIN fs USING (subject_id, date)""",
    digits=9,
)
def _(v):
    hrv = v.daily.select(*ON, (F.col("spo2_avg") - 95).alias("predicted_zscore"), (F.col("spo2_avg") / 200).alias("confidence"))
    out = condition.condition_forecast(features.daily_features(v.daily, v.quality), hrv)
    names = F.transform("contributing_factors", lambda f: f.feature)
    return out.select(*ON, "predicted_score", "confidence", F.concat_ws(",", names).alias("factors"), joined("risk_signals").alias("risks"))


_HALF = ", ".join(f"{sql_half(c, s)} AS {c[0]}{i}" for c in ("hrv_daily_rmssd", "sleep_duration_min", "t_steps") for i, s in ((1, "first"), (2, "second")))


@query(
    "weekly_insight",
    f"""WITH pr AS (SELECT a.subject_id, a.date, b.hrv_daily_rmssd, b.sleep_duration_min, b.steps AS t_steps, row_number() OVER (PARTITION BY a.subject_id, a.date ORDER BY b.date) AS k,
  count(*) OVER (PARTITION BY a.subject_id, a.date) AS n FROM daily a JOIN daily b ON b.subject_id = a.subject_id AND b.date BETWEEN a.date - 6 AND a.date),
hf AS (SELECT subject_id, date, max(n) AS n, {_HALF} FROM pr GROUP BY subject_id, date),
fl AS (SELECT *, CASE WHEN h2 > h1 * 1.05e0 THEN 1 ELSE 0 END AS u1, CASE WHEN s2 > s1 THEN 1 ELSE 0 END AS u2, CASE WHEN t2 > t1 * 1.1e0 THEN 1 ELSE 0 END AS u3,
  CASE WHEN h2 < h1 * 0.95e0 THEN 1 ELSE 0 END AS d1, CASE WHEN s2 < s1 * 0.9e0 THEN 1 ELSE 0 END AS d2 FROM hf),
av AS (SELECT d.subject_id, d.date, avg(c.overall_vas) AS score FROM daily d LEFT JOIN condition_logs c ON c.subject_id = d.subject_id AND CAST(c.logged_at AS DATE) BETWEEN d.date - 6 AND d.date GROUP BY ALL)
SELECT subject_id, date - 6 AS week_start, date AS week_end, {r('score')} AS avg_score,
  CASE WHEN n < 3 THEN 'insufficient_data' WHEN u1 + u2 + u3 > d1 + d2 THEN 'improving' WHEN u1 + u2 + u3 < d1 + d2 THEN 'declining' ELSE 'stable' END AS trend,
  {flags(('HRV improving', 'u1 = 1'), ('Sleep duration improving', 'u2 = 1'), ('Activity level increasing', 'u3 = 1'))} AS up,
  {flags(('HRV declining through week', 'd1 = 1'), ('Sleep duration declining', 'd2 = 1'))} AS down FROM fl JOIN av USING (subject_id, date)""",
)
def _(v):
    out = condition.weekly_insight(v.daily, v.condition_logs)
    return out.select(
        "subject_id", "week_start", "week_end", "avg_score", "trend", joined("top_factors").alias("up"), joined("risk_summary").alias("down")
    )


# ---- gates ---------------------------------------------------------------------------


@query(
    "anomaly_quality_gate",
    f"""WITH {_matrix_sql('calendar', features.ANOMALY_FEATURES)}, qn AS (SELECT *, count(CASE WHEN is_valid_day THEN 1 END) {cal(7)} AS n FROM quality),
g AS (SELECT m.*, q.wear_time_hours, q.completeness_pct, q.n, ({' OR '.join(['rhr_3d_std < 0.5', *[f"(({c} < {lo} OR {c} > {hi}){f' AND {c} <> 0' if c in filters.ZERO_SENTINEL else ''})" for c, (lo, hi) in filters.SENSOR_RANGES.items()]])}) AS bad FROM m LEFT JOIN qn q USING (subject_id, date))
SELECT subject_id, date, CASE WHEN wear_time_hours < 10 THEN 'insufficient_data' WHEN n < 3 THEN 'insufficient_data' WHEN bad THEN 'sensor_issue' ELSE 'pass' END AS quality_gate,
  {r('coalesce(least(least(1.0e0, completeness_pct), least(1.0e0, wear_time_hours / 20)), 0.5e0)')} AS quality_confidence FROM g""",
)
def _(v):
    f = features.anomaly_feature_matrix(v.daily)
    return dq.anomaly_quality_gate(f, v.quality).select(*ON, "quality_gate", "quality_confidence")


_RUNS = "SELECT subject_id, CAST(DATE '2024-01-10' + CAST(subject_id % 21 AS INT) AS TIMESTAMP) AS trained_at FROM daily WHERE subject_id % 4 <> 0 GROUP BY subject_id"


@query(
    "train_eligibility",
    f"""WITH runs AS ({_RUNS}), rw AS (SELECT d.subject_id, d.date FROM daily d JOIN quality q USING (subject_id, date) WHERE q.is_valid_day IS NOT FALSE AND d.hrv_daily_rmssd IS NOT NULL),
c AS (SELECT rw.subject_id, count(*) AS available, count(*) FILTER (WHERE r.trained_at IS NULL OR rw.date > CAST(r.trained_at AS DATE)) AS fresh FROM rw LEFT JOIN runs r USING (subject_id) GROUP BY ALL),
rc AS (SELECT subject_id, count(*) FILTER (WHERE is_valid_day IS NOT FALSE) AS days, avg(completeness_pct) AS pct FROM quality WHERE date >= DATE '2024-01-31' - 7 GROUP BY ALL),
a AS (SELECT s.subject_id, coalesce(c.available, 0) AS available, coalesce(c.fresh, 0) AS fresh, coalesce(rc.days, 0) AS days, coalesce(rc.pct, 0.0e0) AS pct
  FROM (SELECT DISTINCT subject_id FROM quality) s LEFT JOIN c USING (subject_id) LEFT JOIN rc USING (subject_id)),
w AS (SELECT *, CASE WHEN available < 8 THEN 'insufficient_data' WHEN fresh = 0 THEN 'no_new_data' WHEN days < 3 OR pct < 0.41 THEN 'low_recent_quality' ELSE 'ready' END AS reason FROM a)
SELECT subject_id, CAST(available AS BIGINT) AS available_count, CAST(fresh AS BIGINT) AS new_count, CAST(days AS BIGINT) AS recent_valid_days, {r('pct')} AS recent_completeness, reason, reason = 'ready' AS trainable FROM w""",
)
def _(v):
    day = F.expr("date_add(DATE '2024-01-10', CAST(subject_id % 21 AS INT))").cast("timestamp")
    runs = v.daily.where("subject_id % 4 <> 0").select("subject_id").distinct().withColumn("trained_at", day)
    return dq.train_eligibility(v.daily, v.quality, runs, 8, "2024-01-31", metric="hrv_daily_rmssd", min_completeness=0.41)




# ---- daily rollup from tall records ----------------------------------------------------

_KIND = """CASE event_type WHEN 'click' THEN 'HKQuantityTypeIdentifierHeartRate' WHEN 'view' THEN 'HKQuantityTypeIdentifierStepCount'
  WHEN 'signup' THEN 'HKQuantityTypeIdentifierRestingHeartRate' WHEN 'error' THEN 'HKQuantityTypeIdentifierOxygenSaturation' ELSE 'HKQuantityTypeIdentifierActiveEnergyBurned' END"""


def _rollup_pick(kind: str, agg: str, ok: str, name: str) -> str:
    return f"""{name} AS (SELECT subject_id, date, value AS {name}_v FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY CASE WHEN {ok} THEN 1 ELSE 0 END DESC, rank DESC) AS k
  FROM (SELECT subject_id, date, rank, {agg} AS value FROM t WHERE type LIKE '%{kind}' GROUP BY subject_id, date, rank) a) b WHERE k = 1)"""


def _rollup_sql() -> str:
    from kymo.catalog.joins import _SESSIONS

    return f"""WITH t AS (SELECT user_id AS subject_id, CAST(ts AS DATE) AS date, ts, {_KIND} AS type, event_id % 3 AS rank, value, event_id FROM events),
{_rollup_pick('StepCount', 'round_even(sum(value), 0)', 'value > 0 AND value <= 200000', 'st')},
{_rollup_pick('ActiveEnergyBurned', 'round_even(sum(value), 0)', 'value > 0 AND value <= 15000', 'ac')},
{_rollup_pick('RestingHeartRate', 'arg_max(value, ts)', 'value >= 30 AND value <= 100', 'rh')},
mm AS (SELECT subject_id, date, date_trunc('minute', ts) AS m, rank, round_even(avg(value), 0) AS bpm FROM t WHERE type LIKE '%IdentifierHeartRate' GROUP BY ALL),
ma AS (SELECT subject_id, date, rank, avg(bpm) AS mean FROM mm GROUP BY ALL),
mk AS (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY CASE WHEN mean BETWEEN 25 AND 200 THEN 1 ELSE 0 END DESC, rank DESC) AS k FROM ma),
hr AS (SELECT mm.subject_id, mm.date, CAST(max(bpm) AS INT) AS max_hr, CAST(count(*) FILTER (WHERE bpm < 76) AS BIGINT) AS zone_out_min FROM mm JOIN mk ON mk.subject_id = mm.subject_id AND mk.date = mm.date AND mk.rank = mm.rank AND k = 1 GROUP BY ALL),
{_SESSIONS}, mn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY duration_min DESC, a) AS k FROM sess) x WHERE k = 1),
ox AS (SELECT t.subject_id, t.date, max(CASE WHEN value <= 1 THEN value * 100 ELSE value END) AS top FROM t JOIN mn ON mn.subject_id = t.subject_id AND mn.date = t.date WHERE type LIKE '%OxygenSaturation' AND t.ts BETWEEN mn.a AND mn.b GROUP BY ALL),
dd AS (SELECT subject_id, date FROM t UNION SELECT subject_id, date FROM sess)
SELECT dd.subject_id, dd.date, CAST(CASE WHEN st_v > 0 THEN st_v END AS INT) AS steps, CAST(CASE WHEN ac_v > 0 THEN ac_v END AS INT) AS calories_total, CAST(round_even(rh_v, 0) AS INT) AS resting_hr,
  max_hr, zone_out_min, mn.duration_min AS sleep_duration_min, mn.deep_min AS sleep_deep_min, mn.onset_latency AS sleep_onset_latency, {r('round_even(ox.top, 1)')} AS spo2_max
FROM dd LEFT JOIN st USING (subject_id, date) LEFT JOIN ac USING (subject_id, date) LEFT JOIN rh USING (subject_id, date) LEFT JOIN hr USING (subject_id, date) LEFT JOIN mn USING (subject_id, date) LEFT JOIN ox USING (subject_id, date)"""


@query("daily_rollup", _rollup_sql())
def _(v):
    from kymo.catalog.joins import _sessions
    from kymo.plans.rollup import daily_rollup

    tall = v.events.select(
        F.col("user_id").alias("subject_id"), F.to_date("ts").alias("date"), F.col("ts").alias("start"), F.expr(_KIND).alias("type"),
        (F.col("event_id") % 3).alias("source_rank"), F.col("value").alias("numeric_value"),
    )
    out = daily_rollup(tall, _sessions(v))
    return out.select(
        *ON, "steps", "calories_total", "resting_hr", "max_hr", "zone_out_min", "sleep_duration_min", "sleep_deep_min", "sleep_onset_latency", "spo2_max"
    )
