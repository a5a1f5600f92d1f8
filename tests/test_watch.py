"""A watched folder, listed by a task, has the rows of Spark's own files."""

import os

import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from tidewire.sources import files as A

COLUMNS = ["path", "filename", "modified", "n_bytes", "content"]


def spark_files(spark, root, pattern):
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    modified = F.col("modificationTime").cast("timestamp_ntz").alias("modified")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), modified, F.col("length").alias("n_bytes"), "content")


def put(folder, name, content=b"x"):
    (folder / name).write_bytes(content)


def by_spark(files):
    return "binaryFile" in files._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_the_rows_are_those_of_sparks_files(spark, tmp_path, scheme):
    folder = tmp_path / "in 100%"
    (folder / "below.dat").mkdir(parents=True)
    put(folder / "below.dat", "deep.dat")
    names = ["a.dat", "A.DAT", "b [1].dat", "c.tmp", "d{e}.dat", "f,g.dat", "h.dat.gz", "1.txt", "21.txt", "3.txt", "_k=v.dat", "i+j.dat", "k\nl.dat"]
    for n, name in enumerate([*names, ".m.dat", "_n.dat", "o.dat._COPYING_", ".p.txt"]):
        put(folder, name, bytes(range(n + 1)))
        os.utime(folder / name, ns=(0, 1_700_000_000_123_456_789 + n))
    put(folder, "empty.dat", b"")
    os.symlink(folder / "c.tmp", folder / "link.dat")
    os.symlink(folder / "nothing", folder / "broken.dat")
    root = f"{scheme}{folder}"
    for globs in (["*.dat"], ["*.dat", "*1*.txt"], ["[!a]*.dat"], ["{a,b*}.dat"], ["?.*"], ["*"], ["f\\,g.dat"], ["none"], ["*.gz"], ["*i+j*"]):
        pattern = globs[0] if len(globs) == 1 else "{" + ",".join(globs) + "}"
        got = A.watch_files(spark, f"{root}/", globs, "w")
        assert got.columns == ["watch", *COLUMNS] and not by_spark(got)
        expected = spark_files(spark, root, pattern)
        assert [(f.name, f.dataType) for f in got.drop("watch").schema] == [(f.name, f.dataType) for f in expected.schema]
        assert sorted(got.drop("watch").collect()) == sorted(expected.collect()), globs
    assert A.watch_files(spark, root, []).count() == 0


def test_a_task_opens_many_files_or_few_large_ones(spark, tmp_path, monkeypatch):
    for n in range(600):
        put(tmp_path, f"{n}.dat", b"%d" % n)
    monkeypatch.setattr(A, "FILES_PER_TASK", 50)
    monkeypatch.setattr(A, "_BATCH_ROWS", 70)
    files = A.watch_files(spark, str(tmp_path), ["*.dat"])
    assert files.rdd.getNumPartitions() == 12
    assert {r.filename: bytes(r.content) for r in files.collect()} == {f"{n}.dat": b"%d" % n for n in range(600)}
    monkeypatch.setattr(A, "TASK_BYTES", 100)  # 1690 bytes in all
    assert A.watch_files(spark, str(tmp_path), ["*.dat"]).rdd.getNumPartitions() == 17


def test_contents_are_handed_on_by_bytes(spark, tmp_path, monkeypatch):
    for n in range(9):
        put(tmp_path, f"{n}.dat", bytes([n]) * 40)
    monkeypatch.setattr(A, "_BATCH_BYTES", 100)
    files = A.watch_files(spark, str(tmp_path), ["*.dat"])
    assert sorted(bytes(r.content) for r in files.collect()) == [bytes([n]) * 40 for n in range(9)]


def test_roots_that_are_no_folder_go_by_sparks_files(spark, tmp_path):
    for day in ("a", "b"):
        (tmp_path / day).mkdir()
        put(tmp_path / day, f"{day}.dat")
    several = A.watch_files(spark, f"{tmp_path}/[ab]", ["*.dat"])
    assert by_spark(several) and sorted(r.filename for r in several.collect()) == ["a.dat", "b.dat"]
    one = A.watch_files(spark, f"{tmp_path}/a/a.dat", ["*.dat"])
    assert by_spark(one) and [r.filename for r in one.collect()] == ["a.dat"]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        A.watch_files(spark, f"{tmp_path}/nothing", ["*.dat"])


def test_a_file_that_goes_before_it_is_opened(spark, tmp_path):
    for name in ("a.dat", "b.dat"):
        put(tmp_path, name)
    files = A.watch_files(spark, str(tmp_path), ["*.dat"])
    put(tmp_path, "c.dat")  # came after the folder was listed
    assert sorted(r.filename for r in files.collect()) == ["a.dat", "b.dat"]
    again = A.watch_files(spark, str(tmp_path), ["*.dat"])
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    try:
        lenient = A.watch_files(spark, str(tmp_path), ["*.dat"])
    finally:
        spark.conf.unset("spark.sql.files.ignoreMissingFiles")
    os.remove(tmp_path / "b.dat")
    with pytest.raises(PythonException, match="FileNotFoundError"):
        again.collect()
    assert sorted(r.filename for r in lenient.collect()) == ["a.dat", "c.dat"]


def test_subfolders_do_not_count(spark, tmp_path):
    for name in ("k=1", "done"):
        (tmp_path / name).mkdir()
        put(tmp_path / name, "below.dat")
    put(tmp_path, "a.dat")
    assert [r.filename for r in A.watch_files(spark, str(tmp_path), ["*.dat"]).collect()] == ["a.dat"]
