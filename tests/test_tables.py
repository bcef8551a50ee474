"""Reading and overwriting stored tables."""


import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T
from rows import frame, trip

from curbside.operators.marts import mart_schema
from curbside.sources import materialise, overwrite_table, read_table, scratch_path
from curbside.sources.scratch import NoSharedFolderError
from curbside.sources.sinks import reject_overlap

SCHEMA = mart_schema("top_hours_by_taxi_type")


def test_a_table_that_was_never_written(spark, tmp_path):
    empty = read_table(spark, f"{tmp_path}/none", schema=SCHEMA)
    assert empty.schema == SCHEMA and empty.count() == 0
    with pytest.raises(AnalysisException):
        read_table(spark, f"{tmp_path}/none")


def test_a_table_without_files(spark, tmp_path):
    assert read_table(spark, str(tmp_path), schema=SCHEMA).count() == 0


def test_overwriting_replaces(spark, tmp_path):
    path = f"{tmp_path}/t"
    for rows in ([("a", 1, 2), ("b", 1, 2)], [("c", 3, 4)]):
        overwrite_table(spark.createDataFrame(rows, SCHEMA), path)
    assert [tuple(r) for r in read_table(spark, path).collect()] == [("c", 3, 4)]


def test_overwriting_replaces_all_partitions(spark, tmp_path, conf):
    """Also in a session that overwrites partition by partition."""
    conf("spark.sql.sources.partitionOverwriteMode", "dynamic")
    path = f"{tmp_path}/t"
    overwrite_table(frame(spark, [trip(), trip(source="green")]), path, partition_by=["taxi_type"])
    overwrite_table(frame(spark, [trip(), trip()]), path, partition_by=["taxi_type"])
    stored = read_table(spark, path)
    assert stored.columns[-1] == "taxi_type"
    assert [r.taxi_type for r in stored.collect()] == ["yellow", "yellow"]


@pytest.mark.parametrize("open_partitions", [0, 2, 9])
def test_any_number_of_open_partitions(spark, tmp_path, open_partitions):
    """Five partitions per task, fewer or more files open than that."""
    option = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(option)
    df = spark.range(1000).selectExpr("id as x", "concat('p', id % 5) as part").coalesce(2)
    overwrite_table(df, f"{tmp_path}/t", partition_by=["part"], open_partitions=open_partitions)
    stored = read_table(spark, f"{tmp_path}/t")
    assert stored.count() == 1000 and stored.exceptAll(df).isEmpty()
    assert spark.conf.get(option) == before


@pytest.mark.parametrize("flavour", [T.TimestampType(), T.TimestampNTZType()], ids=str)
def test_timestamps_are_stored_with_statistics(spark, tmp_path, flavour):
    option = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(option)
    df = frame(spark, [trip()], timestamp=flavour).coalesce(1)
    overwrite_table(df, f"{tmp_path}/t")
    (part,) = (tmp_path / "t").glob("part-*.parquet")
    group = pq.ParquetFile(part).metadata.row_group(0)
    pickup = next(
        group.column(i)
        for i in range(group.num_columns)
        if group.column(i).path_in_schema == "tpep_pickup_datetime"
    )
    assert pickup.physical_type == "INT64" and pickup.statistics.has_min_max
    assert read_table(spark, f"{tmp_path}/t").collect() == df.collect()
    assert spark.conf.get(option) == before


@pytest.mark.parametrize(
    ("output", "source"),
    [
        ("/a/b", "/a/b"),
        ("/a/b/", "/a/b"),
        ("file:///a/b", "/a/b"),
        ("file:/a/b", "file:///a/b/"),
        ("/a", "/a/b"),
        ("/a/b/c", "/a/b"),
        ("s3a://lake/silver", "s3a://lake/silver/"),
    ],
)
def test_overlap_is_refused(output, source):
    with pytest.raises(ValueError, match="cannot overwrite"):
        reject_overlap(output, ["/elsewhere", source])


def test_neighbours_are_fine():
    reject_overlap("/a/bc", ["/a/b", "s3a://x/a/bc"])


def test_refused_before_the_table_is_touched(spark, tmp_path):
    path = f"{tmp_path}/t"
    overwrite_table(spark.range(3).toDF("x"), path)
    with pytest.raises(ValueError):
        overwrite_table(read_table(spark, path), path, inputs=[path])
    assert read_table(spark, path).count() == 3


def test_scratch_follows_the_session(spark):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    root = f"{spark.conf.get('spark.checkpoint.dir')}/curbside-"
    assert all(p.startswith(root) for p in (first, second))


def test_scratch_without_a_checkpoint_folder_is_in_the_warehouse(spark, monkeypatch):
    get = spark.conf.get
    monkeypatch.setattr(
        type(spark.conf), "get",
        lambda self, key, *rest: None if key == "spark.checkpoint.dir" else get(key, *rest),
    )
    warehouse = get("spark.sql.warehouse.dir").rstrip("/")
    assert scratch_path(spark, "x").startswith(f"{warehouse}/_scratch/curbside-")


def test_materialise_starts_from_the_stored_rows(spark):
    kept = materialise(spark.range(5).selectExpr("id as x", "rand() as r"), "five")
    assert kept.collect() == kept.collect() and kept.count() == 5
    assert all("/five/part-" in path for path in kept.inputFiles())


def test_other_formats(spark, tmp_path):
    overwrite_table(spark.range(3).toDF("x"), f"{tmp_path}/t", fmt="orc")
    assert read_table(spark, f"{tmp_path}/t", fmt="orc").count() == 3


def test_a_cluster_must_say_which_folder_is_shared(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        applicationId = "x"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(NoSharedFolderError, match="spark.checkpoint.dir"):
        scratch_path(Session(), "x")
