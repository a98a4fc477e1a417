"""Queries over feature preparation, models, detection and evaluation. Every query fits its own model."""

from pyspark.sql import functions as F

from kymo.catalog.composites import ON, _circadian as circadian, ln
from kymo.catalog.registry import DAYNO, ENTRIES, cal, query, r
from kymo.core import calendar_frame
from kymo.operators import aggregates as agg, joins
from kymo.operators.ranking import sort_by_size
from kymo.session import materialized
from kymo.plans import baselines, boosting, detect, evaluation as ev, features, forest, linear, prepare, rhythm

PREP = ["resting_hr", "hrv_daily_rmssd", "steps", "spo2_avg"]


@query(
    "impute_median",
    "WITH s AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in PREP) + " FROM daily) SELECT subject_id, date, "
    + ", ".join(f"{r(f'coalesce(CAST({c} AS DOUBLE), m_{c}, 0.0e0)')} AS {c}" for c in PREP) + " FROM daily, s",
)
def _(v):
    return prepare.impute_median(v.daily.select(*ON, *PREP), PREP)


@query(
    "winsorize",
    "WITH s AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS a_{c}, quantile_cont({c}, 0.99) AS b_{c}" for c in PREP) + " FROM daily) SELECT subject_id, date, "
    + ", ".join(f"{r(f'CASE WHEN {c} IS NOT NULL THEN greatest(a_{c}, least(b_{c}, {c})) END')} AS {c}" for c in PREP) + " FROM daily, s",
)
def _(v):
    return prepare.winsorize(v.daily.select(*ON, *PREP), PREP)


def _scale_sql(center: str) -> str:
    mid = "avg({c})" if center == "mean" else "quantile_cont({c}, 0.5)"
    stats = ", ".join(f"{mid.format(c=c)} AS m_{c}, stddev_pop({c}) AS s_{c}" for c in PREP)
    cols = ", ".join(f"{r(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END')} AS {c}" for c in PREP)
    return f"WITH s AS (SELECT {stats} FROM daily) SELECT subject_id, date, {cols} FROM daily, s"


@query("standardize", _scale_sql("mean"))
def _(v):
    return prepare.standardize(v.daily.select(*ON, *PREP), PREP)


@query("standardize_median", _scale_sql("median"))
def _(v):
    return prepare.standardize(v.daily.select(*ON, *PREP), PREP, "median")


# Two columns make the components a closed form; signs are free, so sizes are compared.
@query(
    "group_pca",
    f"""WITH m AS (SELECT quantile_cont(resting_hr, 0.5) AS mx, quantile_cont(spo2_avg, 0.5) AS my FROM daily),
x AS (SELECT subject_id, date, coalesce(CAST(resting_hr AS DOUBLE), mx) AS x, coalesce(spo2_avg, my) AS y FROM daily, m),
c AS (SELECT avg(x) AS ax, avg(y) AS ay, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM x),
l AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1 FROM c),
n AS (SELECT *, sqrt(b * b + (l1 - a) * (l1 - a)) AS norm FROM l)
SELECT subject_id, date, {r('abs(((x - ax) * b + (y - ay) * (l1 - a)) / norm)')} AS pc1, {r('abs(((x - ax) * (l1 - a) - (y - ay) * b) / norm)')} AS pc2 FROM x, n""",
)
def _(v):
    pair = v.daily.select(*ON, "resting_hr", "spo2_avg")
    out = prepare.group_pca(pair, {"vital": ["resting_hr", "spo2_avg"]}, {"vital": 2}, 1.0)
    return out.select(*ON, F.abs("vital_pc1").alias("pc1"), F.abs("vital_pc2").alias("pc2"))


@query("group_pca_matrix")
def _(v):
    return prepare.group_pca(features.hrv_feature_matrix(v.daily))


# ---- evaluation on the long series ----------------------------------------------------

_FORECAST = f"""p AS (SELECT subject_id, date, metric_a / 100000 AS y, avg(metric_a) {cal(7)} / 100000 AS a, avg(metric_a) {cal(28)} / 100000 AS b FROM long_daily)"""


def _forecast(v):
    w = lambda n: F.avg("metric_a").over(calendar_frame(["subject_id"], n)) / 100000
    return v.long_daily.select(*ON, (F.col("metric_a") / 100000).alias("y"), w(7).alias("a"), w(28).alias("b"))


@query(
    "walk_forward_folds",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY {DAYNO}) - 1 AS i, lag(date, 2) OVER (PARTITION BY subject_id ORDER BY {DAYNO}) AS train_end, min(date) OVER (PARTITION BY subject_id) AS train_start FROM long_daily)
SELECT subject_id, CAST(i - 91 AS BIGINT) AS fold_idx, train_start, train_end, date AS test_date, CAST(i - 1 AS BIGINT) AS n_train FROM n WHERE i >= 91""",
)
def _(v):
    return ev.walk_forward_folds(v.long_daily)


_EXPAND = f"OVER (PARTITION BY subject_id ORDER BY {DAYNO} ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)"


@query(
    "fold_normalise",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY {DAYNO}) - 1 AS i, quantile_cont(CAST(metric_b AS DOUBLE), 0.5) {_EXPAND} AS mb, stddev_pop(metric_b) {_EXPAND} AS sb FROM long_daily)
SELECT subject_id, date, CAST(i - 91 AS BIGINT) AS fold_idx, {r('(metric_b - mb) / CASE WHEN sb = 0 THEN 1 ELSE sb END')} AS metric_b FROM n WHERE i >= 91""",
)
def _(v):
    return ev.fold_normalise(v.long_daily, ["metric_b"])


@query(
    "regression_metrics",
    f"""WITH {_FORECAST}, e AS (SELECT subject_id, y - 1.5e0 AS y, a - 1.5e0 AS a FROM p WHERE y IS NOT NULL AND a IS NOT NULL)
SELECT subject_id, CAST(count(*) AS BIGINT) AS n, {r('avg(abs(y - a))')} AS mae, {r('sqrt(avg((y - a) * (y - a)))')} AS rmse,
  {r('CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - a) * (y - a)) / (var_pop(y) * count(*)) ELSE 0 END')} AS r2, {r('avg(CASE WHEN sign(y) = sign(a) THEN 1.0e0 ELSE 0.0e0 END)')} AS directional_accuracy FROM e GROUP BY subject_id""",
)
def _(v):
    p = _forecast(v).select("subject_id", (F.col("y") - 1.5).alias("y"), (F.col("a") - 1.5).alias("a"))
    return ev.regression_metrics(p, "y", "a", ["subject_id"])


@query(
    "stability_selection",
    """WITH i AS (SELECT l_suppkey AS fold_idx, concat('part', CAST(l_partkey % 25 AS VARCHAR)) AS feature, sum(l_extendedprice) AS importance FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY fold_idx ORDER BY importance DESC, feature) AS n FROM i)
SELECT feature, CAST(count(*) AS BIGINT) AS n_hits, CAST((SELECT count(DISTINCT fold_idx) FROM i) AS BIGINT) AS n_folds FROM k WHERE n <= 10 GROUP BY feature HAVING count(*) >= 0.4 * (SELECT count(DISTINCT fold_idx) FROM i)""",
)
def _(v):
    imp = v.lineitem.groupBy(
        F.col("l_suppkey").alias("fold_idx"), F.concat(F.lit("part"), (F.col("l_partkey") % 25).cast("string")).alias("feature")
    ).agg(F.sum("l_extendedprice").alias("importance"))
    return ev.stability_selection(imp, share=0.4)


_ALPHAS = ", ".join(f"avg(abs({w} * a + {round(1 - w, 1)} * b - y)) AS m{i}" for i, w in enumerate(("0.3e0", "0.4e0", "0.5e0", "0.6e0", "0.7e0")) for w in [float(w.replace('e0', ''))])


@query(
    "blend_search",
    f"""WITH {_FORECAST}, s AS (SELECT subject_id, count(*) AS n, avg(abs(a - y)) AS ma, avg(abs(b - y)) AS mb, {_ALPHAS} FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL GROUP BY subject_id),
l AS (SELECT *, [round(m0, 9), round(m1, 9), round(m2, 9), round(m3, 9), round(m4, 9)] AS ms FROM s)
SELECT subject_id, CAST(n AS BIGINT) AS n, {r('ma')} AS mae_a, {r('mb')} AS mae_b, CAST([0.3, 0.4, 0.5, 0.6, 0.7][list_position(ms, list_min(ms))] AS DOUBLE) AS alpha, {r('least(m0, m1, m2, m3, m4)')} AS blend_mae, mb <= 1.15e0 * ma AS accepted FROM l""",
)
def _(v):
    return ev.blend_search(_forecast(v), "a", "b", "y", keys=["subject_id"])


@query(
    "blend_predict",
    f"WITH {_FORECAST} SELECT subject_id, date, {r('coalesce(0.3e0 * a + 0.7e0 * CASE WHEN y > 1.5 THEN b END, a)', 10)} AS blend FROM p",
    digits=10,
)
def _(v):
    p = _forecast(v)
    return p.select(*ON, ev.blend_predict("a", F.when(F.col("y") > 1.5, F.col("b")), 0.3).alias("blend"))


@query(
    "time_split",
    f"""SELECT subject_id, date, row_number() OVER (PARTITION BY subject_id ORDER BY {DAYNO} DESC) <= greatest(1, CAST(floor(count(*) OVER (PARTITION BY subject_id) * 0.15e0) AS INT)) AS is_validation FROM long_daily""",
)
def _(v):
    return ev.time_split(v.long_daily).select(*ON, "is_validation")


@query(
    "score_normalise",
    f"""SELECT subject_id, date, {r('greatest(0.0e0, least(1.0e0, 1 - (skin_temp_variation + 5) / 60.0e0)) * (1 - 0.5e0 * CASE WHEN spo2_avg IS NULL THEN 0.25e0 ELSE 0 END)', 9)} AS normalized, skin_temp_variation < -2 AS flagged FROM daily""",
    digits=9,
)
def _(v):
    unit, flag = ev.score_normalise(
        "skin_temp_variation", F.lit(-5.0), F.lit(55.0), F.lit(-2.0), F.when(F.col("spo2_avg").isNull(), 0.25).otherwise(0.0)
    )
    return v.daily.select(*ON, unit.alias("normalized"), flag.alias("flagged"))


@query(
    "pot_threshold",
    f"""WITH s AS (SELECT subject_id, metric_a / 100000 AS x FROM long_daily), c AS (SELECT subject_id, quantile_cont(x, 0.05) AS t, quantile_cont(x, 0.02) AS q FROM s GROUP BY subject_id),
e AS (SELECT s.subject_id, t, q, CASE WHEN x <= t THEN t - x END AS ex FROM s JOIN c USING (subject_id)),
a AS (SELECT subject_id, max(t) AS t, max(q) AS q, count(ex) AS n, avg(ex) AS m, var_pop(ex) AS v FROM e GROUP BY subject_id),
k AS (SELECT *, 0.5e0 * (1 - m * m / v) AS shape, 0.5e0 * m * (m * m / v + 1) AS scale FROM a)
SELECT subject_id, {r('t')} AS tail_threshold, CAST(n AS BIGINT) AS n_tail, {r('CASE WHEN n >= 5 AND v > 0 THEN t - scale / shape * (pow(0.02e0, -shape) - 1) ELSE q END')} AS threshold FROM k""",
)
def _(v):
    s = v.long_daily.select("subject_id", (F.col("metric_a") / 100000).alias("score"))
    return ev.pot_threshold(s, keys=["subject_id"])


_A = "list_avg(list_transform(ex, lambda x: ln(1 + (exp({s}) - 1) * x / top)))"
_B = "list_avg(list_transform(ex, lambda x: 1 / (1 + (exp({s}) - 1) * x / top)))"


# The root of the slope by bisection, from the best cell of the same search range.
@query(
    "pot_threshold_likelihood",
    f"""WITH RECURSIVE s AS (SELECT subject_id, ln(metric_a) AS x FROM long_daily), c AS (SELECT subject_id, quantile_cont(x, 0.05) AS t, quantile_cont(x, 0.02) AS q FROM s GROUP BY subject_id),
e AS (SELECT s.subject_id, any_value(t) AS t, any_value(q) AS q, list(t - x) AS ex, max(t - x) AS top FROM s JOIN c USING (subject_id) WHERE x <= t GROUP BY s.subject_id),
g AS (SELECT subject_id, ex, top, 0.5e0 + i AS s FROM e, range(-14, 14) r(i)),
p AS (SELECT subject_id, s, top, {_A.format(s='s')} AS a FROM g),
b AS (SELECT subject_id, arg_max(s, -ln(a / ((exp(s) - 1) / top)) - a) AS s FROM p WHERE a >= -1 GROUP BY subject_id),
h AS (SELECT subject_id, s - 1 AS lo, s + 1 AS hi, 0 AS k FROM b
  UNION ALL SELECT subject_id, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END, k + 1
  FROM (SELECT h.*, CASE WHEN abs(lo + hi) < 2e-6 THEN list_avg(list_transform(ex, lambda x: x * x)) > 2 * pow(list_avg(ex), 2) ELSE (1 + {_A.format(s='((lo + hi) / 2)')}) * {_B.format(s='((lo + hi) / 2)')} > 1 END AS up FROM h JOIN e USING (subject_id) WHERE k < 44) y),
f AS (SELECT subject_id, t, ex, CASE WHEN a < -1 THEN -1 / top ELSE (exp(lo) - 1) / top END AS theta, greatest(a, -1) AS a FROM (SELECT e.*, lo, {_A.format(s='lo')} AS a FROM e JOIN h USING (subject_id) WHERE k = 44) z)
SELECT subject_id, {r('t')} AS tail_threshold, CAST(len(ex) AS BIGINT) AS n_tail, {r('a')} AS shape, {r('a / theta')} AS scale, {r('t - (pow(0.02e0, -a) - 1) / theta')} AS threshold FROM f""",
)
def _(v):
    s = v.long_daily.select("subject_id", F.log("metric_a").alias("score"))
    return ev.pot_threshold(s, keys=["subject_id"], method="likelihood")


# ---- models --------------------------------------------------------------------------


def _forest_rows(v):
    m = features.anomaly_feature_matrix(v.daily, v.quality, "rows")
    return m.where("coalesce(is_valid_day, true)")


def _forest(v):
    return forest.isolation_forest_train(_forest_rows(v), features.ANOMALY_FEATURES, trees=200, row_id=ON)


# The forest is random, so its checks are statements that hold for any forest.
@query(
    "isolation_forest_train",
    """SELECT count(*) AS n, true AS share_below_offset, true AS unit_scores, true AS whole_range
FROM daily d LEFT JOIN quality q USING (subject_id, date) WHERE q.is_valid_day IS NOT FALSE""",
)
def _(v):
    """On its own training rows: the contamination share lies below the offset, and the
    normalised score spans 0 to 1 before missing features damp it."""
    model = _forest(v)
    scored = forest.isolation_forest_score(_forest_rows(v), model, ON)
    share = F.avg((F.col("anomaly_score") < 0).cast("double"))
    return scored.agg(
        F.count("*").alias("n"),
        (F.abs(share - 0.02) <= 0.002 + 1 / F.count("*")).alias("share_below_offset"),
        F.min(F.col("normalized_score").between(0, 1)).alias("unit_scores"),
        ((F.min("anomaly_score") == model.score_min) & (F.max("anomaly_score") == model.score_max)).alias("whole_range"),
    )


# Scores of a random forest have no SQL; tests recompute depths from the stored trees.
@query("isolation_forest_score")
def _(v):
    out = forest.isolation_forest_score(features.anomaly_feature_matrix(v.daily), _forest(v), ON)
    return out.select(*ON, "anomaly_score", "normalized_score", "is_anomaly")


@query("ablation_attribution")
def _(v):
    out = forest.ablation_attribution(features.anomaly_feature_matrix(v.daily), _forest(v), ON)
    top = F.get(sort_by_size("contributions"), F.lit(0))
    return out.select(*ON, top["feature"].alias("top_feature"), top["contribution"].alias("top_contribution"))


@query("shapley_attribution")
def _(v):
    """Largest contribution of each day and the sum of all, which is its path length less the
    expected one."""
    out = forest.shapley_attribution(features.anomaly_feature_matrix(v.daily), _forest(v), ON)
    top = F.get(sort_by_size("contributions"), F.lit(0))
    total = F.aggregate("contributions", F.lit(0.0), lambda t, c: t + c["contribution"])
    return out.select(*ON, top["feature"].alias("top_feature"), top["contribution"].alias("top_contribution"), total.alias("above_expected"))


@query("anomaly_detect")
def _(v):
    f = features.anomaly_feature_matrix(v.daily)
    out = detect.anomaly_detect(f, _forest(v), v.quality, min_wear=5)
    return out.withColumn("top_drivers", F.to_json("top_drivers"))


_RIDGE = ["resting_hr", "hrv_ln_rmssd", "steps", "spo2_avg", "skin_temp_variation", "day_of_week"]
_PAIRS = f"""SELECT c.subject_id, CAST(c.overall_vas AS DOUBLE) AS y, d.resting_hr, {ln('d.hrv_daily_rmssd')} AS hrv_ln_rmssd, d.steps, d.spo2_avg, d.skin_temp_variation, CAST(dayofweek(d.date) AS DOUBLE) AS day_of_week
FROM condition_logs c JOIN daily d ON d.subject_id = c.subject_id AND d.date = CAST(c.logged_at AS DATE) LEFT JOIN quality q ON q.subject_id = d.subject_id AND q.date = d.date WHERE q.is_valid_day IS NOT FALSE"""


def _pairs(v):
    return features.divergence_feature_matrix(v.daily, v.condition_logs, v.quality)


def _ridge(v, by_subject=True):
    return linear.ridge_fit(_pairs(v), _RIDGE, "target_score", keys=["subject_id"] if by_subject else [])


def _ridge_sql(by: str) -> str:
    """Ridge of six features as CTEs: ``fit`` holds, per ``by``, the medians, means, deviations and the
    coefficients, which solve the normal equations by conjugate gradients (exact after six steps)."""
    k = range(len(_RIDGE))
    xs = ", ".join(f"coalesce({c}, m{i}) AS x{i}" for i, c in enumerate(_RIDGE))
    medians = ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0) AS m{i}" for i, c in enumerate(_RIDGE))
    stats = ", ".join(f"avg(x{i}) AS a{i}, CASE WHEN stddev_pop(x{i}) < 1e-12 THEN 1 ELSE stddev_pop(x{i}) END AS s{i}" for i in k)
    scaled = ", ".join(f"(x{i} - a{i}) / s{i} AS z{i}" for i in k)
    rows = ", ".join("[" + ", ".join(f"sum(z{i} * z{j}) + {int(i == j)}" for j in k) + "]" for i in k)
    right = ", ".join(f"sum(z{i} * (t - mt))" for i in k)
    dot = "list_dot_product"
    return f"""p AS (SELECT {by} AS g, * FROM ({_PAIRS})), md AS (SELECT g, {medians} FROM p GROUP BY g),
x AS (SELECT p.g, y, ln(least(99.5e0, greatest(0.5e0, y)) / 100 / (1 - least(99.5e0, greatest(0.5e0, y)) / 100)) AS t, {xs} FROM p JOIN md USING (g)),
st AS (SELECT g, count(*) AS n, avg(t) AS mt, {stats} FROM x GROUP BY g),
z AS (SELECT g, y, t, mt, n, {scaled} FROM x JOIN st USING (g)),
eq AS (SELECT g, [{rows}] AS a, [{right}] AS b FROM z GROUP BY g),
cg AS (SELECT g, 0 AS k, a, list_transform(b, lambda v: 0e0) AS x, b AS r, b AS q FROM eq
  UNION ALL SELECT g, k + 1, a, list_transform(range(1, 7), lambda i: x[i] + step * q[i]), rest,
    list_transform(range(1, 7), lambda i: rest[i] + {dot}(rest, rest) / greatest({dot}(r, r), 1e-300) * q[i])
  FROM (SELECT *, list_transform(range(1, 7), lambda i: r[i] - step * aq[i]) AS rest FROM (
    SELECT *, {dot}(r, r) / greatest({dot}(q, aq), 1e-300) AS step FROM (SELECT *, list_transform(a, lambda v: {dot}(v, q)) AS aq FROM cg WHERE k < 14)))),
fit AS (SELECT * FROM st JOIN md USING (g) JOIN (SELECT g, x AS coef FROM cg WHERE k = 14) USING (g))"""


def _ridge_part(i: int, row: str = "d") -> str:
    return f"coef[{i + 1}] * (coalesce({row}.{_RIDGE[i]}, m{i}) - a{i}) / s{i}"


def _score(margin: str) -> str:
    return f"100.0e0 / (1 + exp(-({margin})))"


_DAYS = f"""days AS (SELECT subject_id, date, resting_hr, {ln('hrv_daily_rmssd')} AS hrv_ln_rmssd, steps, spo2_avg, skin_temp_variation,
  CAST(dayofweek(date) AS DOUBLE) AS day_of_week FROM daily)"""
_Z = " + ".join(f"coef[{i + 1}] * z{i}" for i in range(6))


@query(
    "ridge_fit",
    f"""WITH RECURSIVE {_ridge_sql("subject_id")},
e AS (SELECT g, y, y - {_score(f"fit.mt + {_Z}")} AS e FROM z JOIN fit USING (g)),
v AS (SELECT g, CASE WHEN var_pop(y) > 0 THEN 1 - sum(e * e) / (var_pop(y) * count(*)) ELSE 0 END AS r2, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
  avg(e) AS residual_mean, CASE WHEN stddev_pop(e) < 1e-8 THEN 1 ELSE stddev_pop(e) END AS residual_std FROM e GROUP BY g)
SELECT g AS subject_id, CAST(n AS BIGINT) AS n, {", ".join(f"{r(f'coef[{i + 1}]', 4)} + 0e0 AS coef_{c}" for i, c in enumerate(_RIDGE))}, {r("mt", 4)} AS intercept,
  {", ".join(f"{r(c, 4)} + 0e0 AS {c}" for c in ("r2", "mae", "rmse", "residual_mean", "residual_std"))} FROM fit JOIN v USING (g)""",
    digits=4,
)
def _(v):
    t = _ridge(v).table
    coefs = [F.get("coef", F.lit(i)).alias(f"coef_{c}") for i, c in enumerate(_RIDGE)]
    return t.select("subject_id", "n", *coefs, "intercept", "r2", "mae", "rmse", "residual_mean", "residual_std")


# One feature makes ridge a closed form: coef = Sxy / (Sxx / sd + alpha) on scaled values.
_ONE = f"""p AS ({_PAIRS}), m AS (SELECT subject_id, quantile_cont(skin_temp_variation, 0.5) AS med FROM p GROUP BY subject_id),
x AS (SELECT p.subject_id, coalesce(skin_temp_variation, med) AS x, ln(least(99.5e0, greatest(0.5e0, y)) / 100 / (1 - least(99.5e0, greatest(0.5e0, y)) / 100)) AS t FROM p JOIN m USING (subject_id)),
s AS (SELECT subject_id, count(*) AS n, avg(x) AS mx, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd, avg(t) AS mt, sum(x * t) - count(*) * avg(x) * avg(t) AS sxy, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx FROM x GROUP BY subject_id),
one AS (SELECT s.*, m.med, sxy / sd / (sxx / (sd * sd) + 1) AS coef FROM s JOIN m USING (subject_id)),
c AS (SELECT d.subject_id, d.date, one.coef * (coalesce(d.skin_temp_variation, one.med) - one.mx) / one.sd AS part, one.mt FROM daily d LEFT JOIN one USING (subject_id))"""


def _ridge_one(v):
    return linear.ridge_fit(_pairs(v), ["skin_temp_variation"], "target_score")


@query(
    "ridge_fit_one_feature",
    f"WITH {_ONE} SELECT subject_id, CAST(n AS BIGINT) AS n, {r('coef', 4)} AS coef, {r('mt', 4)} AS intercept FROM one",
    digits=4,
)
def _(v):
    t = _ridge_one(v).table
    return t.select("subject_id", "n", F.get("coef", F.lit(0)).alias("coef"), "intercept")


@query(
    "ridge_predict_one_feature",
    f"WITH {_ONE} SELECT subject_id, date, {r('100.0e0 / (1 + exp(-(mt + part)))', 4)} AS predicted_score FROM c",
    digits=4,
)
def _(v):
    days = features.divergence_day_features(v.daily)
    return linear.ridge_predict(days, _ridge_one(v)).select(*ON, "predicted_score")


@query("linear_contributions", f"WITH {_ONE} SELECT subject_id, date, {r('part', 4)} AS contribution FROM c", digits=4)
def _(v):
    days = features.divergence_day_features(v.daily)
    out = linear.linear_contributions(days, _ridge_one(v))
    return out.select(*ON, F.get("contributions", F.lit(0))["contribution"].alias("contribution"))


@query(
    "ridge_predict",
    f"""WITH RECURSIVE {_ridge_sql("subject_id")}, {_DAYS}
SELECT d.subject_id, d.date, {r(_score("mt + " + " + ".join(_ridge_part(i) for i in range(6))), 4)} AS predicted_score
FROM days d LEFT JOIN fit ON fit.g = d.subject_id""",
    digits=4,
)
def _(v):
    days = features.divergence_day_features(v.daily)
    return linear.ridge_predict(days, _ridge(v)).select(*ON, "predicted_score")


@query(
    "linear_contributions_top",
    f"""WITH RECURSIVE {_ridge_sql("subject_id")}, {_DAYS},
parts AS (SELECT d.subject_id, d.date, unnest([{", ".join(f"struct_pack(f := '{c}', c := {_ridge_part(i)})" for i, c in enumerate(_RIDGE))}]) AS p
  FROM days d JOIN fit ON fit.g = d.subject_id),
top AS (SELECT subject_id, date, arg_max(p.f, abs(p.c)) AS f, arg_max(p.c, abs(p.c)) AS c FROM parts GROUP BY subject_id, date)
SELECT d.subject_id, d.date, f AS top_feature, {r("c", 4)} AS top_contribution FROM days d LEFT JOIN top USING (subject_id, date)""",
    digits=4,
)
def _(v):
    days = features.divergence_day_features(v.daily)
    out = linear.linear_contributions(days, _ridge(v))
    top = F.get(sort_by_size("contributions"), F.lit(0))
    return out.select(*ON, top["feature"].alias("top_feature"), top["contribution"].alias("top_contribution"))


@query("divergence_detect")
def _(v):
    days = features.divergence_day_features(v.daily)
    out = detect.divergence_detect(days, v.condition_logs, _ridge(v, False))
    return out.withColumn("top_drivers", F.to_json("top_drivers"))


@query(
    "divergence_residuals",
    f"""WITH RECURSIVE {_ridge_sql("1")}, {_DAYS},
c AS (SELECT subject_id, CAST(logged_at AS DATE) AS date, CAST(arg_max(overall_vas, logged_at) AS DOUBLE) AS y FROM condition_logs GROUP BY subject_id, CAST(logged_at AS DATE)),
e AS (SELECT subject_id, date, d.date IS NOT NULL AS bio, y, {_score("mt + " + " + ".join(_ridge_part(i) for i in range(6)))} AS p
  FROM days d FULL JOIN c USING (subject_id, date), fit)
SELECT subject_id, date, CASE WHEN bio AND y IS NOT NULL THEN {r("y", 2)} ELSE 0 END AS actual_score, CASE WHEN bio AND y IS NOT NULL THEN {r("p", 2)} ELSE 0 END AS predicted_score,
  CASE WHEN bio AND y IS NOT NULL THEN {r("y - p", 4)} + 0e0 ELSE 0 END AS residual, NOT bio AS no_biometrics FROM (SELECT * REPLACE (coalesce(bio, false) AS bio) FROM e)""",
    digits=4,
)
def _(v):
    """The part of ``divergence_detect`` that its chart and its text are made from."""
    days = features.divergence_day_features(v.daily)
    out = detect.divergence_detect(days, v.condition_logs, _ridge(v, False))
    return out.select(*ON, "actual_score", "predicted_score", "residual", (F.col("divergence_type") == "no_biometric_data").alias("no_biometrics"))


@query(
    "valid_divergences",
    "SELECT subject_id, date FROM daily d WHERE EXISTS (SELECT 1 FROM condition_logs c WHERE c.subject_id = d.subject_id AND CAST(c.logged_at AS DATE) = d.date)",
)
def _(v):
    days = features.divergence_day_features(v.daily)
    return detect.valid_divergences(detect.divergence_detect(days, v.condition_logs, _ridge(v, False))).select(*ON)


_GBT = features.HRV_FEATURES


def _boosted(v):
    return boosting.gbt_fit(_training(v), _GBT, "target_hrv_zscore")


def _training(v):
    m = features.hrv_feature_matrix(v.daily, v.quality, "rows")
    return m.where("coalesce(is_valid_day, true) AND target_hrv_zscore IS NOT NULL").select(*ON, *_GBT, "target_hrv_zscore")


# One feature with few values, one split a tree: the second round learns what the first left.
_STUMP = """{name} AS (SELECT c, sum(g) FILTER (x <= c) AS gl, count(*) FILTER (x <= c) AS nl, sum(g) AS g, count(*) AS n FROM {rows}, (SELECT unnest(range(0, 6)) AS c) GROUP BY c),
{name}_best AS (SELECT c, 0.5e0 * gl / (nl + 5) AS low, 0.5e0 * (g - gl) / (n - nl + 5) AS high FROM {name} WHERE nl >= 10 AND n - nl >= 10 ORDER BY gl * gl / (nl + 5) + (g - gl) * (g - gl) / (n - nl + 5) DESC LIMIT 1)"""


@query(
    "gbt_fit_stumps",
    f"""WITH d AS (SELECT subject_id, date, dayofweek(date) AS x, CAST(hrv_daily_rmssd AS DOUBLE) AS y FROM daily),
q AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM d WHERE y IS NOT NULL),
t AS (SELECT x, y FROM d, q WHERE y BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)),
b AS (SELECT avg(y) AS base FROM t), r1 AS (SELECT x, y - base AS g FROM t, b), {_STUMP.format(name="s1", rows="r1")},
r2 AS (SELECT x, g - CASE WHEN x <= c THEN low ELSE high END AS g FROM r1, s1_best), {_STUMP.format(name="s2", rows="r2")}
SELECT subject_id, date, {r("base + CASE WHEN x <= s1_best.c THEN s1_best.low ELSE s1_best.high END + CASE WHEN x <= s2_best.c THEN s2_best.low ELSE s2_best.high END", 4)} AS predicted
FROM d, b, s1_best, s2_best""",
    digits=4,
)
def _(v):
    days = v.daily.select(*ON, F.dayofweek("date").alias("day_of_week"), "hrv_daily_rmssd")
    plain = {"max_depth": 1, "rounds": 2, "rate": 0.5, "subsample": 1.0, "columns": 1.0}
    model = boosting.gbt_fit(days, ["day_of_week"], "hrv_daily_rmssd", validation=0.0, **plain)
    return boosting.gbt_predict(days, model, "predicted").select(*ON, "predicted")


@query("gbt_fit")
def _(v):
    out = boosting.gbt_predict(_training(v), _boosted(v), "yhat").withColumnRenamed("target_hrv_zscore", "y")
    return ev.regression_metrics(out, "y", "yhat", ["subject_id"])


@query("gbt_predict")
def _(v):
    m = features.hrv_feature_matrix(v.daily)
    return boosting.gbt_predict(m, _boosted(v)).select(*ON, "predicted_zscore")


@query("hrv_forecast")
def _(v):
    m = features.hrv_feature_matrix(v.daily)
    out = detect.hrv_forecast(m, _boosted(v), v.quality)
    return out.withColumn("top_drivers", F.to_json("top_drivers"))


@query("param_search")
def _(v):
    """Errors of the best of 100 settings, per subject."""
    train = materialized(_training(v), "training")
    best, _mae = boosting.param_search(train, _GBT, "target_hrv_zscore")[0]
    model = boosting.gbt_fit(train, _GBT, "target_hrv_zscore", staged=True, **best)
    out = boosting.gbt_predict(train, model, "yhat").withColumnRenamed("target_hrv_zscore", "y")
    return ev.regression_metrics(out, "y", "yhat", ["subject_id"]).withColumn("max_depth", F.lit(best["max_depth"]))


def _checked(name: str) -> str:
    return f"({ENTRIES[name].check})"


@query(
    "daily_context_scores",
    f"""SELECT d.subject_id, d.date, d.resting_hr, d.steps, {r('q.completeness_pct', 4)} AS completeness_pct, c.overall_vas, {r('b.median_steps', 4)} AS median_steps,
  {r('w.avg_steps', 4)} AS avg_steps, {r('v.vri_score', 4)} AS vri_score, {r('v.vri_confidence', 4)} AS vri_confidence, {r('h.chs_score', 4)} AS chs_score,
  {r('h.chs_confidence', 4)} AS chs_confidence, p.predicted_score AS predicted_condition, x.actual_score, x.residual
FROM daily d LEFT JOIN quality q USING (subject_id, date)
LEFT JOIN (SELECT subject_id, CAST(logged_at AS DATE) AS date, arg_max(overall_vas, logged_at) AS overall_vas
  FROM condition_logs GROUP BY subject_id, CAST(logged_at AS DATE)) c USING (subject_id, date)
LEFT JOIN (SELECT subject_id, date, quantile_cont(steps, 0.5) {cal(60, True)} AS median_steps FROM daily) b USING (subject_id, date)
LEFT JOIN (SELECT subject_id, date, avg(steps) {cal(6, True)} AS avg_steps FROM daily) w USING (subject_id, date)
LEFT JOIN {_checked("vri")} v USING (subject_id, date) LEFT JOIN {_checked("chs")} h USING (subject_id, date)
LEFT JOIN {_checked("ridge_predict")} p USING (subject_id, date) LEFT JOIN {_checked("divergence_residuals")} x USING (subject_id, date)""",
    digits=4,
)
def _(v):
    """The day with its quality, condition log, baselines, week, both scores, the condition predicted from
    the day and the divergence of what was logged from it."""
    days = features.divergence_day_features(v.daily)
    tables = {
        "quality": v.quality,
        "condition": joins.latest_log_per_day(v.condition_logs).select(*ON, "overall_vas", "tags"),
        "baselines": agg.baseline_medians(v.daily, ["steps"]).select(*ON, "median_steps"),
        "week": agg.weekly_avg(v.daily, ["steps"], digits=None).select(*ON, "avg_steps"),
        "vri": baselines.vri(v.daily, v.sleep_stages, v.quality).select(*ON, "vri_score", "vri_confidence"),
        "circadian": rhythm.chs(circadian(v)).select(*ON, "chs_score", "chs_confidence"),
        "prediction": linear.ridge_predict(days, _ridge(v)).select(*ON, "predicted_score"),
        "divergence": detect.divergence_detect(days, v.condition_logs, _ridge(v, False)).select(*ON, "divergence_type", "actual_score", "residual"),
    }
    return joins.daily_context(v.daily, tables).select(
        *ON, "biometrics.resting_hr", "biometrics.steps", "quality.completeness_pct", "condition.overall_vas", "baselines.median_steps",
        "week.avg_steps", "vri.vri_score", "vri.vri_confidence", "circadian.chs_score", "circadian.chs_confidence",
        F.col("prediction.predicted_score").alias("predicted_condition"), "divergence.actual_score", "divergence.residual",
    )
