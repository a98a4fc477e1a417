"""One scan of an XML export: byte ranges, entities, order of a workout's parts."""

import pytest
from pyspark.sql import functions as F

from kymo.sources import tall

STAMP = "2024-01-01 {:02d}:{:02d}:00 +0000"


def record(i):
    quote = "'" if i % 2 else '"'
    at = STAMP.format(i % 24, i % 60)
    return (
        f"<Record type={quote}HKQuantityTypeIdentifierHeartRate{quote} sourceName='A &amp; B &lt;{i}&gt; &#233; > 1' "
        f'device="{i}"\n  startDate="{at}" endDate="{at}" value="{i}"' + ("/>" if i % 3 else '><MetadataEntry key="Record" value="x"/></Record>')
    )


def workout(i):
    parts = "".join(f'\n<WorkoutStatistics type="HKQuantityTypeIdentifierDistanceWalkingRunning" sum="{i}.{j}"/>' for j in range(i % 4))
    at = STAMP.format(i % 24, i % 60)
    return f'<Workout workoutActivityType="HKWorkoutActivityTypeRunning" device="{i}" startDate="{at}" endDate="{at}" duration="1">{parts}</Workout>'


def write(path, n):
    body = "\n".join(record(i) + "\n" + workout(i) for i in range(n))
    head = '<?xml version="1.0"?>\n<!DOCTYPE HealthData [\n<!ELEMENT Record ((MetadataEntry)*)>\n<!ATTLIST Record\n type CDATA #REQUIRED>\n]>\n'
    path.write_text(f'{head}<HealthData locale="x">\n<Me HKCharacteristicTypeIdentifierDateOfBirth="1990-05-10"/>\n{body}\n</HealthData>', encoding="utf-8")


@pytest.fixture
def narrow(spark):
    """Byte ranges of four kilobytes, so that many begin within an element."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_one_large_file_is_read_once_by_many_tasks(spark, tmp_path, narrow):
    n = 400
    write(tmp_path / "export.xml", n)
    path = str(tmp_path / "export.xml")
    assert tall.xml_elements(spark, path).rdd.getNumPartitions() > 8
    records, workouts, profile = tall.read_xml_export(spark, path)
    (tmp_path / "export.xml").unlink()  # the frames read what the one scan staged
    got = {r.device: r for r in records.collect()}
    assert len(got) == n and records.count() == n
    for i in range(n):
        assert (got[str(i)].source_name, got[str(i)].numeric_value) == (f"A & B <{i}> é > 1", float(i))
    rows = {int(w.device): w.distance_km for w in workouts.collect()}
    assert rows == {i: float(f"{i}.{i % 4 - 1}") if i % 4 else None for i in range(n)}
    assert [str(p.birth_date) for p in profile.collect()] == ["1990-05-10"]


def test_equal_to_a_reader_by_row_tag(spark, tmp_path):
    write(tmp_path / "export.xml", 60)
    path = str(tmp_path / "export.xml")
    elements = tall.xml_elements(spark, path)
    for kind in ("Record", "Me"):
        want = spark.read.format("xml").option("rowTag", kind).schema(tall.ELEMENTS[kind]).load(path)
        got = tall._of_kind(elements, kind)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == want.count()
    want = spark.read.format("xml").option("rowTag", "Workout").schema(tall.WORKOUT_XML).load(path).select(*tall.WORKOUT_XML.names)
    got = tall._with_statistics(elements).select(*tall.WORKOUT_XML.names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_files_without_elements(spark, tmp_path):
    (tmp_path / "empty.xml").write_text("<HealthData></HealthData>")
    assert [f.count() for f in tall.read_xml_export(spark, str(tmp_path))] == [0, 0, 0]


def test_a_tag_is_parsed_once_for_all_filters(spark, tmp_path):
    write(tmp_path / "export.xml", 5)
    _records, workouts, _profile = tall.read_xml_export(spark, str(tmp_path / "export.xml"))
    plan = workouts._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("from_xml(") == 2  # workouts and statistics


def test_stamps_are_those_of_the_pattern(spark):
    texts = [
        "2024-02-29 23:59:59 +0900", "2023-02-29 00:00:00 +0000", "1582-10-10 12:00:00 -0330", "2024-01-01 24:00:00 +0000", "2024-01-01 00:00:60 +0000",
        "2024-01-01 00:00:00 +1800", "2024-01-01 00:00:00 +1801", "2024-01-01 00:00:00 -0000", "0000-01-01 00:00:00 +0000", "not a time", "", None,
        "2024-01-01 00:00:00 Z", "2024-01-01T00:00:00 +0000", "2024-1-1 0:0:0 +0000", "2024-01-01 00:00:00 +0000\n", " 2024-01-01 00:00:00 +0000",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    both = df.select("x", tall._stamp("x").alias("a"), F.try_to_timestamp("x", F.lit(tall.STAMP)).alias("b"))
    assert both.where("NOT (a <=> b)").count() == 0 and both.where("a IS NOT NULL").count() == 5
