"""Queries over source selection, set operations and merge rules."""

from pyspark.sql import functions as F

from kymo.catalog.registry import query, r, stamp as sql_stamp
from kymo.catalog.show import stamp
from kymo.catalog.sources import landing
from kymo.functions.vocab import source_priority
from kymo.operators import reconcile as op
from kymo.sources import filetable, sinks

DAY = ("subject_id", "date")


@query(
    "source_priority",
    """SELECT event_id, CASE WHEN lower(concat(props, ' ', event_type)) LIKE '%watch%' OR event_type = 'click' THEN 2
  WHEN event_type = 'view' THEN 1 ELSE 0 END AS rank FROM events""",
)
def _(v):
    device = F.expr("CASE event_type WHEN 'click' THEN 'Apple Watch 7' WHEN 'view' THEN 'iPhone 12' ELSE event_type END")
    return v.events.select("event_id", source_priority("props", device).alias("rank"))


def _pick_sql(agg: str, ok: str) -> str:
    return f"""WITH a AS (SELECT subject_id, date, source_rank, {agg} AS value FROM tall_records GROUP BY subject_id, date, source_rank),
k AS (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY CASE WHEN {ok} THEN 1 ELSE 0 END DESC, source_rank DESC) AS n FROM a)
SELECT subject_id, date, {r('value')} AS value, source_rank FROM k WHERE n = 1"""


@query("pick_best_source", _pick_sql("round_even(sum(value), 0)", "value BETWEEN 10 AND 60"))
def _(v):
    return op.pick_best_source(v.tall_records, plausible=lambda x: x.between(10, 60))


@query("pick_best_source_avg", _pick_sql("avg(value)", "value BETWEEN 10 AND 30"))
def _(v):
    return op.pick_best_source(v.tall_records, agg="avg", plausible=lambda x: x.between(10, 30))


@query(
    "pick_best_source_last",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY subject_id, date, source_rank ORDER BY start DESC, value DESC) AS j FROM tall_records),
k AS (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY CASE WHEN value > 20 THEN 1 ELSE 0 END DESC, source_rank DESC) AS n FROM o WHERE j = 1)
SELECT subject_id, date, value, source_rank FROM k WHERE n = 1""",
)
def _(v):
    return op.pick_best_source(v.tall_records, agg="last", plausible=lambda x: x > 20)


@query(
    "pick_best_source_minutes",
    """WITH m AS (SELECT subject_id, CAST(time AS DATE) AS date, date_trunc('minute', time) AS minute, source_rank, CAST(round_even(avg(CAST(bpm AS DOUBLE)), 0) AS INT) AS bpm
  FROM heart_rate GROUP BY ALL),
a AS (SELECT subject_id, date, source_rank, avg(bpm) AS mean FROM m GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY CASE WHEN mean BETWEEN 25 AND 100 THEN 1 ELSE 0 END DESC, source_rank DESC) AS n FROM a)
SELECT m.subject_id, m.date, strftime(m.minute, '%Y-%m-%d %H:%M:%S') AS minute, m.source_rank, m.bpm FROM m JOIN k ON k.subject_id = m.subject_id AND k.date = m.date AND k.source_rank = m.source_rank AND k.n = 1""",
)
def _(v):
    out = op.pick_best_minutes(v.heart_rate, "bpm", "time", lambda x: x.between(25, 100))
    return out.withColumn("minute", stamp("minute"))


_TWO = "SELECT subject_id, date, source_rank AS source_id, sum(value) AS value FROM tall_records GROUP BY subject_id, date, source_rank"


def _two(v):
    return v.tall_records.groupBy("subject_id", "date", F.col("source_rank").alias("source_id")).agg(F.sum("value").alias("value"))


@query(
    "plausible_pick",
    f"""SELECT subject_id, date, value, source_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, date
  ORDER BY CASE WHEN value > 0 AND value <= 40 THEN 1 ELSE 0 END DESC, CASE source_id WHEN 1 THEN 0 ELSE 1 END) AS k FROM ({_TWO}) t WHERE source_id IN (1, 2)) x WHERE k = 1""",
)
def _(v):
    return op.plausible_pick(_two(v), [1, 2], lambda x: (x > 0) & (x <= 40))


@query(
    "priority_pick",
    f"""SELECT subject_id, date, value, source_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY CASE source_id WHEN 1 THEN 0 ELSE 1 END) AS k
FROM ({_TWO}) t WHERE source_id IN (1, 2)) x WHERE k = 1""",
)
def _(v):
    return op.priority_pick(_two(v), [1, 2])


@query("sum_best_source", _pick_sql("round_even(sum(value), 0)", "TRUE"))
def _(v):
    return op.sum_best_source(v.tall_records)


@query(
    "union_dates",
    """SELECT subject_id, date FROM daily WHERE resting_hr IS NOT NULL UNION SELECT subject_id, CAST(time + to_seconds(seconds) AS DATE) FROM sleep_stages
UNION SELECT subject_id, CAST(logged_at AS DATE) FROM condition_logs""",
)
def _(v):
    sleep = v.sleep_stages.select("subject_id", F.to_date(F.expr("timestampadd(SECOND, seconds, time)")).alias("date"))
    logs = v.condition_logs.select("subject_id", F.to_date("logged_at").alias("date"))
    return op.union_dates(v.daily.where("resting_hr IS NOT NULL"), sleep, logs)


@query("backfill_vas", "SELECT id, coalesce(mood_vas, (mental - 1) * 20 + 10) AS mood_vas FROM condition_logs")
def _(v):
    return op.backfill_vas(v.condition_logs, "mental", "mood_vas").select("id", "mood_vas")


@query("rescale_scores", f"SELECT subject_id, date, {r('spo2_avg * 20')} AS spo2_avg, {r('skin_temp_variation * 20')} AS skin_temp_variation FROM daily")
def _(v):
    return op.rescale_scores(v.daily, ["spo2_avg", "skin_temp_variation"]).select("subject_id", "date", "spo2_avg", "skin_temp_variation")


@query(
    "fill_missing_from",
    """WITH d AS (SELECT subject_id, date, CASE WHEN subject_id % 4 = 0 THEN 0 ELSE resting_hr END AS resting_hr FROM daily),
o AS (SELECT subject_id, CAST(time AS DATE) AS date, max(bpm) AS resting_hr FROM heart_rate GROUP BY ALL)
SELECT d.subject_id, d.date, coalesce(nullif(d.resting_hr, 0), o.resting_hr, d.resting_hr) AS resting_hr FROM d LEFT JOIN o USING (subject_id, date)""",
)
def _(v):
    d = v.daily.select("subject_id", "date", F.when(F.col("subject_id") % 4 == 0, 0).otherwise(F.col("resting_hr")).alias("resting_hr"))
    o = v.heart_rate.groupBy("subject_id", F.to_date("time").alias("date")).agg(F.max("bpm").alias("resting_hr"))
    return op.fill_missing_from(d, o, "resting_hr")


# Old rows are the first three weeks, new rows the last three: they overlap by days.
_OLD = "SELECT subject_id, date, resting_hr, steps, spo2_avg FROM daily WHERE date <= DATE '2024-01-21'"
_NEW = """SELECT subject_id, date, CASE WHEN subject_id % 3 = 0 THEN 0 ELSE resting_hr + 1 END AS resting_hr, steps + 5 AS steps, spo2_avg - 1 AS spo2_avg
  FROM daily WHERE date >= DATE '2024-01-10'"""


def _old_new(v):
    old = v.daily.where("date <= DATE '2024-01-21'").select("subject_id", "date", "resting_hr", "steps", "spo2_avg")
    new = v.daily.where("date >= DATE '2024-01-10'").select(
        "subject_id", "date",
        F.when(F.col("subject_id") % 3 == 0, 0).otherwise(F.col("resting_hr") + 1).alias("resting_hr"),
        (F.col("steps") + 5).alias("steps"), (F.col("spo2_avg") - 1).alias("spo2_avg"),
    )
    return old, new


def _merge_sql(**rules: str) -> str:
    cols = ", ".join(f"{rule} AS {c}" for c, rule in rules.items())
    return f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT subject_id, date, {cols} FROM o FULL OUTER JOIN n USING (subject_id, date)".replace(
        "FROM o FULL", "FROM (SELECT *, TRUE AS is_old FROM o) o FULL"
    ).replace("JOIN n USING", "JOIN (SELECT *, TRUE AS is_new FROM n) n USING")


def _over(c: str) -> str:
    return f"CASE WHEN n.is_new THEN n.{c} ELSE o.{c} END"


@query("upsert_overwrite", _merge_sql(resting_hr=_over("resting_hr"), steps=_over("steps"), spo2_avg=r(_over("spo2_avg"))))
def _(v):
    return sinks.upsert_overwrite(*_old_new(v), on=DAY)


@query(
    "upsert_keep_nonnull",
    _merge_sql(resting_hr="coalesce(n.resting_hr, o.resting_hr)", steps="coalesce(n.steps, o.steps)", spo2_avg=r("coalesce(n.spo2_avg, o.spo2_avg)")),
)
def _(v):
    return sinks.upsert_keep_nonnull(*_old_new(v), on=DAY)


@query(
    "upsert_zero_as_null",
    _merge_sql(
        resting_hr="CASE WHEN n.is_new AND o.is_old THEN coalesce(nullif(n.resting_hr, 0), o.resting_hr) WHEN n.is_new THEN n.resting_hr ELSE o.resting_hr END",
        steps=_over("steps"), spo2_avg=r(_over("spo2_avg")),
    ),
)
def _(v):
    return sinks.upsert_zero_as_null(*_old_new(v), on=DAY, cols=["resting_hr"])


@query(
    "replace_time_range",
    """WITH s AS (SELECT subject_id, sleep_start AS a, sleep_end AS b FROM daily WHERE sleep_start IS NOT NULL)
SELECT subject_id, event_id, stage FROM sleep_stages o WHERE log_id = 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.subject_id = o.subject_id AND o.time BETWEEN s.a AND s.b)
UNION ALL SELECT subject_id, event_id, stage FROM sleep_stages WHERE log_id > 0""",
)
def _(v):
    spans = v.daily.where("sleep_start IS NOT NULL").select("subject_id", F.col("sleep_start").alias("start"), F.col("sleep_end").alias("end"))
    s = v.sleep_stages.drop("date")
    out = sinks.replace_time_range(s.where("log_id = 0"), s.where("log_id > 0"), "time", spans)
    return out.select("subject_id", "event_id", "stage")


@query("upsert_files", _merge_sql(resting_hr=_over("resting_hr"), steps=_over("steps"), spo2_avg=r(_over("spo2_avg"))))
def _(v):
    """The overwriting upsert into a table of files cut by day, in two batches."""
    old, new = _old_new(v)
    table = filetable.create_table(old, landing(v, "files"), ["date", "subject_id"])
    for part in ("date > DATE '2024-01-21'", "date <= DATE '2024-01-21'"):
        filetable.upsert_files(v.spark, table, new.where(part), DAY, lambda o, n: sinks.upsert_overwrite(o, n, DAY))
    return filetable.read_table(v.spark, table)


@query(
    "replace_range_files",
    """WITH s AS (SELECT subject_id, sleep_start AS a, sleep_end AS b FROM daily WHERE sleep_start IS NOT NULL)
SELECT subject_id, event_id, stage FROM sleep_stages o WHERE log_id = 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.subject_id = o.subject_id AND o.time BETWEEN s.a AND s.b)
UNION ALL SELECT subject_id, event_id, stage FROM sleep_stages WHERE log_id > 0""",
)
def _(v):
    spans = v.daily.where("sleep_start IS NOT NULL").select("subject_id", F.col("sleep_start").alias("start"), F.col("sleep_end").alias("end"))
    s = v.sleep_stages.select("subject_id", "time", "event_id", "stage", "log_id")
    table = filetable.create_table(s.where("log_id = 0"), landing(v, "range-files"), ["time", "subject_id"])
    filetable.replace_range_files(v.spark, table, s.where("log_id > 0"), "time", spans)
    return filetable.read_table(v.spark, table).select("subject_id", "event_id", "stage")


@query("retention_filter", "SELECT event_id, subject_id, bpm FROM heart_rate WHERE time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '20' DAY")
def _(v):
    return sinks.retention_filter(v.heart_rate, "time", 20, "2024-01-31 00:00:00").select("event_id", "subject_id", "bpm")


@query(
    "workout_external_id",
    """SELECT event_id, concat('hk_', strftime(time + INTERVAL '9' HOUR, '%Y%m%d%H%M%S'), '_', source) AS external_id,
  concat('hc-', lower(hex(source))) AS session_id FROM heart_rate""",
)
def _(v):
    from kymo.functions.vocab import session_external_id, workout_external_id

    return v.heart_rate.select(
        "event_id", workout_external_id("time", "source", 9).alias("external_id"), session_external_id("source").alias("session_id")
    )
