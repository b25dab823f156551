"""Commits of several tables, feeds that break off and start again, databases in ranges, files by their bytes."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labframe.sources import commit, io
from labframe.sources.schema import TableSpec


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_run_that_breaks_off_leaves_the_old_state(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id bigint")
    with pytest.raises(ValueError, match="no version"):
        commit.read_published(spark, root, "a")
    assert commit.committed(spark, root, "1", {"a": rows(1, 2), "b": rows(7)})

    def broken():
        raise InterruptedError

    with pytest.raises(InterruptedError):
        commit.committed(spark, root, "2", {"a": rows(3), "b": rows(8)}, before_publishing=broken)
    assert ids(commit.read_published(spark, root, "a")) == [1, 2] and ids(commit.read_published(spark, root, "b")) == [7]
    assert commit.swept(spark, root) == 2 and commit.swept(spark, root) == 0
    # the same batch again, then once more
    assert commit.committed(spark, root, "2", {"a": rows(3), "b": rows(8)}) and not commit.committed(spark, root, "2", {"a": rows(9)})
    assert ids(commit.read_published(spark, root, "a")) == [1, 2, 3] and ids(commit.read_published(spark, root, "a", 0)) == [1, 2]
    assert commit.committed(spark, root, "3", {"a": rows(5), "b": rows()}, replace=("a", "b"))
    assert ids(commit.read_published(spark, root, "a")) == [5] and ids(commit.read_published(spark, root, "b")) == []


def test_two_writers_get_versions_of_their_own(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    one = spark.createDataFrame([(1,)], "id bigint")

    def other():  # publishes while the first one is about to
        commit.committed(spark, root, "other", {"a": one.withColumn("id", F.lit(2).cast("bigint"))})

    assert commit.committed(spark, root, "mine", {"a": one}, before_publishing=other)
    assert [v["batch"] for v in commit.versions(spark, root)] == ["other", "mine"] and ids(commit.read_published(spark, root, "a")) == [1, 2]
    assert not commit._published(spark, root, {"batch": "late", "tables": {}}, 1) and commit._published(spark, root, {"batch": "late", "tables": {}}, 2)


def test_a_feed_that_fails_in_the_middle_gives_each_line_once(spark, tmp_path):
    root, source, checkpoint = (f"file://{tmp_path}/{n}" for n in ("t", "in", "c"))
    lines = ['{"id": 1}', '{"id": 2', "no json", '{"id": "x"}', '{"id": 5, "more": 1}', "[1]"]
    for i, line in enumerate(lines):
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(source)
    record, seen = T.StructType.fromDDL("id BIGINT"), []

    def tables(df):
        seen.append(1)
        if len(seen) == 4:
            raise RuntimeError("down")
        good, bad = io.json_split(df, "value", record)
        return {"good": good, "bad": bad}

    def run():
        feed = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(source)
        commit.commit_sink(feed, root, "feed", checkpoint, tables).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="down"):
        run()
    assert len(commit.versions(spark, root)) == 3
    run()
    assert ids(commit.read_published(spark, root, "good")) == [1, 5]
    assert sorted(r.value for r in commit.read_published(spark, root, "bad").collect()) == sorted([lines[1], lines[2], lines[3], lines[5]])


def test_a_database_is_read_in_ranges_with_filters_and_columns(spark, tmp_path):
    spec = TableSpec("thing", "id BIGINT, name STRING, size INT")
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    io.write_jdbc(spark.range(3, 103).selectExpr("id", "concat('n', id) AS name", "CAST(id % 7 AS INT) AS size"), url, spec, "name VARCHAR(20)", driver=driver)
    df = io.read_jdbc(spark, url, spec, 4, driver=driver)
    assert df.schema.names == ["id", "name", "size"] and df.rdd.getNumPartitions() == 4 and df.count() == 100
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and min(sizes) == 25
    plan = df.where("size = 3 AND id > 50").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(size,3)" in plan and "GreaterThan(id,50)" in plan and "numPartitions=4" in plan
    assert sorted(r.name for r in df.where("size = 3 AND id > 80").select("name").collect()) == ["n101", "n87", "n94"]
    io.write_jdbc(df.where("id < 0"), url, TableSpec("nothing", spec.ddl), "name VARCHAR(20)", driver=driver)
    assert io.read_jdbc(spark, url, TableSpec("nothing", spec.ddl), driver=driver).count() == 0


def test_files_are_told_by_their_bytes_and_large_ones_not_opened(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"a.png": b"\x89PNG\r\n\x1a\nrest", "b.png": b"\xff\xd8\xff\xe0", "sub/c.webp": b"RIFF\x01\x02\x03\x04WEBPVP8 ", "d.webp": b"RIFF\x01\x02\x03\x04WAVE", "e.jpg": b"", "f.png": b"\x89PNG\r\n\x1a\n" + b"x" * 100}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    found = io.read_manifest(spark, str(tmp_path), most=90)
    got = {r.path.rpartition("/")[2]: (r.length, r.magic) for r in found.collect()}
    assert got == {"a.png": (12, "image/png"), "b.png": (4, "image/jpeg"), "c.webp": (16, "image/webp"), "d.webp": (12, None), "f.png": (108, None)}
    stated = spark.createDataFrame([("a.png", "image/png"), ("b.png", "image/png"), ("f.png", "image/png"), ("d.webp", "image/webp"), ("none.png", "image/png"), ("e.jpg", "text/html")], "path string, mime string")
    named = found.withColumn("path", F.substring_index("path", "/", -1))
    assert {r.path: r.fault for r in io.manifest_faults(stated, named, most=90).collect()} == {"a.png": None, "b.png": "CONTENT", "f.png": "SIZE", "d.webp": "CONTENT", "none.png": "MISSING", "e.jpg": "MISSING"}
