"""Stand-in wearable views over the general test tables.

Each view is one SELECT that runs unchanged in Spark SQL and in the checking engine, so a
query and its check read the same rows. Sums are rounded before they are floored, because
float sums differ in the last bit between engines and a floor would show it.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo import schemas
from kymo.session import use_utc

TABLES = {
    "events": schemas.EVENTS,
    "orders": schemas.ORDERS,
    "lineitem": schemas.LINEITEM,
    "documents": schemas.DOCUMENTS,
}


def _of(agg: str, kind: str) -> str:
    return f"{agg}(CASE WHEN event_type='{kind}' THEN value END)"


VIEWS = {
    "daily": f"""
SELECT user_id AS subject_id, CAST(ts AS DATE) AS date,
  CAST(floor(round(45 + {_of('avg', 'click')} / 3, 6)) AS INT) AS resting_hr,
  round({_of('avg', 'view')}, 4) AS hrv_daily_rmssd,
  round({_of('max', 'view')} * 1.1, 4) AS hrv_deep_rmssd,
  CAST(floor(round({_of('sum', 'purchase')} * 6, 6)) AS INT) AS sleep_duration_min,
  CAST(floor(round({_of('sum', 'purchase')} * 5, 6)) AS INT) AS sleep_minutes_asleep,
  CAST(floor(round({_of('sum', 'purchase')}, 6)) AS INT) AS sleep_deep_min,
  CAST(floor(round({_of('max', 'purchase')} / 2, 6)) AS INT) AS sleep_rem_min,
  CAST(floor(round({_of('sum', 'signup')} * 100, 6)) AS INT) AS steps,
  CAST(floor(round({_of('max', 'signup')} * 3, 6)) AS INT) AS calories_active,
  CAST(floor(round({_of('avg', 'signup')}, 6)) AS INT) AS active_zone_min,
  round(100 - {_of('avg', 'error')} / 7, 4) AS spo2_avg,
  round(100 - {_of('max', 'error')} / 5, 4) AS spo2_min,
  round(10 + {_of('avg', 'error')} / 7, 4) AS br_full_sleep,
  round(min(value) - 5, 4) AS skin_temp_variation,
  CASE WHEN count(*) > 1 THEN min(ts) - INTERVAL '7' HOUR END AS sleep_start,
  CASE WHEN count(*) > 1 THEN max(ts) - INTERVAL '6' HOUR END AS sleep_end
FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "heart_rate": """
SELECT user_id AS subject_id, ts AS time, CAST(floor(50 + value) AS INT) AS bpm, event_type AS source,
  CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS source_rank, event_id
FROM events""",
    "sleep_stages": """
SELECT user_id AS subject_id, ts AS time, CAST(ts AS DATE) AS date,
  CASE event_type WHEN 'view' THEN 'deep' WHEN 'purchase' THEN 'rem' WHEN 'signup' THEN 'wake' ELSE 'light' END AS stage,
  CAST(floor(value * 120) AS INT) + 30 AS seconds, event_id % 3 AS log_id, event_id FROM events""",
    "quality": """
SELECT user_id AS subject_id, CAST(ts AS DATE) AS date, CAST(count(*) * 5.0 AS DOUBLE) AS wear_time_hours,
  CAST(count(DISTINCT event_type) AS DOUBLE) / 5.0E0 AS completeness_pct,
  CASE WHEN count(*) >= 4 THEN NULL ELSE count(*) >= 2 END AS is_valid_day,
  CAST(count(DISTINCT event_type) AS DOUBLE) / 10.0E0 + 0.25E0 AS confidence_score
FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "condition_logs": """
SELECT event_id AS id, user_id AS subject_id,
  CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL '400' DAY END AS logged_at, CAST(least(100, floor(value)) AS INT) AS overall_vas,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 101 AS INT) END AS mood_vas,
  CAST(event_id % 7 AS INT) AS overall, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 6 AS INT) END AS mental,
  concat(event_type, ',', 'g', CAST(event_id % 7 AS VARCHAR(2))) AS tags_csv FROM events""",
    "tall_records": """
SELECT l_suppkey AS subject_id, CAST(l_shipdate AS DATE) AS date, l_shipdate AS start,
  CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS source_rank,
  l_linestatus AS type, l_quantity AS value, l_orderkey, l_linenumber FROM lineitem""",
    "long_daily": """
SELECT o_orderpriority AS subject_id, CAST(o_orderdate AS DATE) AS date,
  round(sum(o_totalprice), 2) AS metric_a, count(*) AS metric_b
FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)""",
    "who5": """
SELECT o_orderkey AS id, o_custkey AS subject_id, o_orderdate AS assessed_at, CAST(o_orderkey % 6 AS INT) AS item1,
  CAST(floor(o_orderkey / 6) % 6 AS INT) AS item2, CAST(floor(o_orderkey / 36) % 6 AS INT) AS item3,
  CAST(floor(o_orderkey / 216) % 6 AS INT) AS item4, CAST(floor(o_orderkey / 1296) % 6 AS INT) AS item5 FROM orders""",
}


class Views:
    """Stand-in views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = use_utc(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if re.search(rf"\b{t}\b", text)}
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **used)

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    events = cached_property(lambda self: self.table("events"))
    orders = cached_property(lambda self: self.table("orders"))
    lineitem = cached_property(lambda self: self.table("lineitem"))
    documents = cached_property(lambda self: self.table("documents"))
    daily = cached_property(lambda self: self.view("daily"))
    heart_rate = cached_property(lambda self: self.view("heart_rate"))
    sleep_stages = cached_property(lambda self: self.view("sleep_stages"))
    quality = cached_property(lambda self: self.view("quality"))
    tall_records = cached_property(lambda self: self.view("tall_records"))
    long_daily = cached_property(lambda self: self.view("long_daily"))
    who5 = cached_property(lambda self: self.view("who5"))

    @cached_property
    def condition_logs(self) -> DataFrame:
        return self.view("condition_logs").withColumn("tags", F.split("tags_csv", ","))


def with_views(sql: str) -> str:
    """Prefix a check query with the views it names."""
    body = sql.strip()
    needed = [n for n in VIEWS if re.search(rf"\b(FROM|JOIN)\s+{n}\b", body)]
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if not ctes:
        return body
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if match:
        return f"WITH {match.group(1) or ''}{ctes}, {body[match.end():]}"
    return f"WITH {ctes} {body}"
