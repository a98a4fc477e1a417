"""Continuous daily aggregate: late rows, pruned refresh, offsets, replays."""

import datetime as dt
import glob

import pytest
from pyspark.sql import types as T

from kymo.streaming import continuous as ca

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = T.StructType().add("subject_id", "integer").add("time", "timestamp").add("v", "double")


def at(day, v, s=1, hour=0):
    return (s, T0 + dt.timedelta(days=day, hours=hour), v)


def means(spark, of):
    return {(r.subject_id, r.bucket.day): (r.n, r.v_avg) for r in ca.daily_means(spark, of).collect()}


def test_only_stale_days_are_read(spark, tmp_path):
    of = ca.DailyAggregate(str(tmp_path / "agg"), SCHEMA, ("v",))
    ca.land(spark.createDataFrame([at(d, float(d)) for d in range(5)], SCHEMA), of, 0)
    assert [d.day for d in ca.refresh(spark, of)] == [1, 2, 3, 4, 5]
    assert ca.refresh(spark, of) == []
    late = [at(1, 9.0, hour=1), at(1, None, hour=2), at(3, 5.0, s=2)]
    ca.land(spark.createDataFrame(late, SCHEMA), of, 1)
    # Files of the other days become unreadable: a refresh that opened them would fail.
    for day in (1, 3, 5):
        for f in glob.glob(f"{of.raw}/bucket=2024-01-0{day}/**/*.parquet", recursive=True):
            open(f, "wb").write(b"not parquet")
    assert [d.day for d in ca.refresh(spark, of)] == [2, 4]
    assert means(spark, of) == {
        (1, 1): (1, 0.0), (1, 2): (3, 5.0), (1, 3): (1, 2.0), (1, 4): (1, 3.0), (2, 4): (1, 5.0), (1, 5): (1, 4.0)
    }
    got = {(r.subject_id, r.bucket.day): r.v_mean for r in ca.trailing_means(spark, of, 2).collect()}
    assert got[1, 2] == pytest.approx((0 + 1 + 9) / 3) and got[1, 3] == pytest.approx((1 + 9 + 2) / 3) and got[2, 4] == 5.0


def test_offsets_leave_days_stale_and_replays_replace(spark, tmp_path):
    of = ca.DailyAggregate(str(tmp_path / "agg"), SCHEMA, ("v",))
    batch = spark.createDataFrame([at(d, 1.0) for d in range(4)], SCHEMA)
    ca.land(batch, of, 0)
    ca.land(batch, of, 0)
    assert [d.day for d in ca.refresh(spark, of, "2024-01-02", "2024-01-04")] == [2, 3]
    assert sorted(r.bucket.day for r in ca.stale_days(spark, of).collect()) == [1, 4]
    # A refresh that failed before its marks were written does the same work again.
    ca.refresh(spark, of)
    spark.createDataFrame([], "batch_id long, bucket date").write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).parquet(f"{of.path}/done")
    assert len(ca.refresh(spark, of)) == 4
    assert means(spark, of) == {(1, d): (1, 1.0) for d in (1, 2, 3, 4)}


def test_empty_batches_and_rows_without_time(spark, tmp_path):
    of = ca.DailyAggregate(str(tmp_path / "agg"), SCHEMA, ("v",))
    assert ca.refresh(spark, of) == []
    ca.land(spark.createDataFrame([], SCHEMA), of, 0)
    assert ca.refresh(spark, of) == []
    with pytest.raises(Exception, match="row without time"):
        ca.land(spark.createDataFrame([(1, None, 1.0)], SCHEMA), of, 1)


def test_lands_from_a_stream(spark, tmp_path):
    of = ca.DailyAggregate(str(tmp_path / "agg"), SCHEMA, ("v",))
    for b in range(3):
        rows = [at(d, float(b)) for d in range(b + 1)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sdf = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        sdf.writeStream.foreachBatch(lambda df, batch: ca.land(df, of, batch))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    ca.refresh(spark, of)
    assert means(spark, of) == {(1, 1): (3, 1.0), (1, 2): (2, 1.5), (1, 3): (1, 2.0)}
