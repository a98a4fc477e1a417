"""Readers of landed records: tall rows and XML exports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymo.core import require
from kymo.functions.vocab import RECORD_TYPES, source_priority
from kymo.schemas import TALL_RECORDS
from kymo.session import stage_path

STAMP = "yyyy-MM-dd HH:mm:ss Z"
_WRITTEN = r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}\z"


def _stamp(text: str) -> Column:
    """``STAMP`` read by a cast, which costs a tenth of a pattern; texts of another shape go by the pattern."""
    c = F.col(text)
    zoned = F.concat(F.substring(c, 1, 19), F.substring(c, 21, 3), F.lit(":"), F.substring(c, 24, 2))
    return F.when(c.rlike(_WRITTEN), zoned.try_cast("timestamp")).otherwise(F.try_to_timestamp(c, F.lit(STAMP)))


def _parsed(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """Whitelisted types with both timestamps readable. The local date is the one written
    in the record, in the record's own zone."""
    start, end = _stamp("start"), _stamp("end")
    return (
        df.where(F.col("type").isin(*types))
        .withColumns({"local_date": F.substring("start", 1, 10).try_cast("date"), "start": start, "end": end})
        .where(F.col("start").isNotNull() & F.col("end").isNotNull())
        .withColumns(
            {
                "numeric_value": F.col("value").try_cast("double"),
                "source_rank": source_priority("source_name", "device"),
            }
        )
    )


def read_tall_records(
    spark: SparkSession, path: str, types: Sequence[str] = RECORD_TYPES, fmt: str = "parquet"
) -> DataFrame:
    """Landed tall records (parquet, csv or json) with the declared schema."""
    reader = spark.read.format(fmt)
    if fmt == "parquet":
        require(reader.load(path), *TALL_RECORDS.fieldNames())
    if fmt == "csv":
        reader = reader.option("header", True)
    return _parsed(reader.schema(TALL_RECORDS).load(path), types)


def _attributes(*names: str) -> T.StructType:
    return T.StructType([T.StructField(f"_{n}", T.StringType()) for n in names])


RECORD_XML = _attributes("type", "sourceName", "device", "startDate", "endDate", "value", "unit")
WORKOUT_XML = T.StructType(
    [
        *_attributes("workoutActivityType", "sourceName", "device", "startDate", "endDate", "duration").fields,
        T.StructField("WorkoutStatistics", T.ArrayType(_attributes("type", "sum"))),
    ]
)
PROFILE_XML = _attributes("HKCharacteristicTypeIdentifierDateOfBirth")


ELEMENTS = {"Record": RECORD_XML, "Workout": WORKOUT_XML, "WorkoutStatistics": _attributes("type", "sum"), "Me": PROFILE_XML}
_TAG = r"""^(\w+)((?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*/?>"""


def xml_elements(spark: SparkSession, path: str) -> DataFrame:
    """The opening tags of ``ELEMENTS`` in one scan: kind, attrs, file, block, row.

    A tag starts at ``<``, which XML allows nowhere else in tags and texts, so the file is read as
    text cut at that sign: Spark deals byte ranges of one large file to many tasks and no element is
    read twice. ``block`` (where the byte range begins) and ``row`` order the tags of a file. Elements
    within comments and CDATA sections count as elements.
    """
    tags = spark.read.option("lineSep", "<").text(path).select(
        F.regexp_extract("value", _TAG, 1).alias("kind"),
        F.regexp_extract("value", _TAG, 2).alias("attrs"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return tags.where(F.col("kind").isin(*ELEMENTS))


def _of_kind(elements: DataFrame, kind: str, *extra: str) -> DataFrame:
    """The attributes of one kind, as columns; a parser reads them, so entities are resolved."""
    names = [f.name for f in ELEMENTS[kind] if isinstance(f.dataType, T.StringType)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    tag = F.concat(F.lit(f"<{kind}"), "attrs", F.lit("/>"))
    # As a generator, the parser runs once a tag: later filters are not pushed below it, each with a parser of its own.
    parsed = F.inline(F.array(F.from_xml(tag, schema.simpleString())))
    return elements.where(F.col("kind") == kind).select(*extra, parsed.alias(*names))


def _with_statistics(elements: DataFrame, prepared: Callable[[DataFrame], DataFrame] = lambda w: w) -> DataFrame:
    """Workouts with the statistics between their tag and the next workout's, in order. Only these
    two kinds are ordered, per byte range; the workout open at the end of a range is carried on.
    ``prepared`` works on the workouts before they are joined."""
    place = ["file", "block", "row"]
    stats = _of_kind(elements, "WorkoutStatistics", *place).withColumn("opens", F.lit(None).cast("long"))
    begun = elements.where(F.col("kind") == "Workout").select(*place, F.col("row").alias("opens"))
    within = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("m").isNotNull(), F.struct("block", F.col("m").alias("row")))
    ranges = elements.where(F.col("kind").isin("Workout", "WorkoutStatistics")).groupBy("file", "block")
    ranges = ranges.agg(F.max(F.when(F.col("kind") == "Workout", F.col("row"))).alias("m"))
    carried = ranges.select("file", "block", F.max(last).over(before).alias("carried"))
    owned = stats.unionByName(begun, allowMissingColumns=True).withColumn("m", F.max("opens").over(within))
    owned = owned.where(F.col("opens").isNull()).join(carried, ["file", "block"])
    parts = owned.withColumn("owner", F.coalesce(last, "carried")).groupBy("file", "owner")
    listed = F.array_sort(F.collect_list(F.struct("block", "row", "_type", "_sum")))  # the few of one workout
    parts = parts.agg(F.transform(listed, lambda s: F.struct(s["_type"].alias("_type"), s["_sum"].alias("_sum"))).alias("WorkoutStatistics"))
    owners = elements.withColumn("owner", F.struct("block", "row"))
    return prepared(_of_kind(owners, "Workout", "file", "owner")).join(parts, ["file", "owner"], "left").drop("file", "owner")


def read_xml_export(
    spark: SparkSession, path: str, types: Sequence[str] = RECORD_TYPES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, workouts, profile) of an XML export, which is read once: its tags are staged in the
    shared folder by kind, and each frame reads its own."""
    staged = stage_path(spark, "xml")
    found = xml_elements(spark, path)
    found.write.partitionBy("kind").parquet(staged)
    elements = spark.read.schema(found.schema).parquet(staged)
    raw = _of_kind(elements, "Record").select(
        F.col("_type").alias("type"),
        F.col("_sourceName").alias("source_name"),
        F.col("_device").alias("device"),
        F.col("_startDate").alias("start"),
        F.col("_endDate").alias("end"),
        F.col("_value").alias("value"),
        F.col("_unit").alias("unit"),
    )
    records = _parsed(raw, types)

    def dated(workouts: DataFrame) -> DataFrame:
        stamps = {"start": _stamp("_startDate"), "end": _stamp("_endDate")}
        return workouts.withColumns(stamps).drop("_startDate", "_endDate").where(F.col("start").isNotNull() & F.col("end").isNotNull())

    w = _with_statistics(elements, dated)
    start, end = F.col("start"), F.col("end")
    minutes = F.coalesce(F.col("_duration"), F.lit("0")).try_cast("double")

    def last_sum(part: str) -> Column:
        hits = F.filter(
            F.col("WorkoutStatistics"), lambda s: s["_type"].contains(part) & s["_sum"].try_cast("double").isNotNull()
        )
        return F.try_element_at(hits, F.lit(-1))["_sum"].try_cast("double")

    workouts = w.select(
        F.replace(F.coalesce("_workoutActivityType", F.lit("")), F.lit("HKWorkoutActivityType"), F.lit("")).alias("activity_type"),
        F.col("_sourceName").alias("source_name"),
        F.col("_device").alias("device"),
        start,
        end,
        F.coalesce(minutes * 60.0, (F.unix_timestamp(end) - F.unix_timestamp(start)).cast("double")).alias("duration_sec"),
        last_sum("DistanceWalkingRunning").alias("distance_km"),
        last_sum("ActiveEnergyBurned").alias("energy_kcal"),
    )

    profile = _of_kind(elements, "Me").select(
        F.col("_HKCharacteristicTypeIdentifierDateOfBirth").try_cast("date").alias("birth_date")
    )
    return records, workouts, profile
