"""Files in zip archives, against Python's own reading of them."""

import csv
import io
import random
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.sources import archives


def pack(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(f"{name}.csv", text)


def test_columns_by_position(spark, tmp_path):
    for n in (1, 2):
        pack(tmp_path / f"{n}.zip", a="block,down\n" + "".join(f"{n}{i},{i}\n" for i in range(5)) + '"x, y",7\n')
    got = archives.zipped_csv(spark, str(tmp_path / "*.zip"), "block string, down int", F.col("down") > 2).collect()
    assert sorted((r["block"], r["down"]) for r in got) == sorted([(f"{n}{i}", i) for n in (1, 2) for i in (3, 4)] + [("x, y", 7)] * 2)


def test_records_that_are_not_plain(spark, tmp_path):
    text = '﻿"a",b\r\n"one\nline, ""two""",1\r\n\r\na,b\r\nshort\r\nlong,2,3,4\r\n,\r\n no ,x\r\n'
    pack(tmp_path / "1.zip", a=text, empty="", heads="a,b\n")
    with zipfile.ZipFile(tmp_path / "2.zip", "w") as z:
        z.writestr("folder/", "")
        z.writestr("folder/bad.csv", b"a,b\n\xff,5")
    got = archives.zipped_csv(spark, str(tmp_path / "*.zip"), "a string, b int").collect()
    assert sorted(map(tuple, got), key=str) == sorted([('one\nline, "two"', 1), ("a", None), ("short", None), ("long", 2), (None, None), (" no ", None), ("�", 5)], key=str)


def test_columns_by_name(spark, tmp_path):
    pack(tmp_path / "1.zip", a="a,b\nx,1\n", b="b, a ,c,a\n2,y,3.5,z\n")
    got = archives.zipped_csv(spark, str(tmp_path / "1.zip"), "a string, b int, c double", by_name=["a"]).collect()
    assert sorted(map(tuple, got)) == [("x", 1, None), ("y", 2, 3.5)]
    with pytest.raises(PySparkException, match=r"columns are missing in .*1\.zip!a\.csv: c"):
        archives.zipped_csv(spark, str(tmp_path / "1.zip"), "a string, b int, c double", by_name=["a", "c"]).collect()


def test_members_of_one_name_and_none(spark, tmp_path):
    with pytest.warns(UserWarning, match="Duplicate name"), zipfile.ZipFile(tmp_path / "1.zip", "w") as z:
        z.writestr("a.csv", "a\n1\n")
        z.writestr("a.csv", "a\n2\n")
    pack(tmp_path / "2.zip")
    got = archives.members(spark, str(tmp_path / "*.zip")).select("entry", "member", "bytes").collect()
    assert sorted(map(tuple, got)) == [(0, "a.csv", 4), (1, "a.csv", 4)]
    assert sorted(r["a"] for r in archives.zipped_csv(spark, str(tmp_path / "*.zip"), "a int").collect()) == [1, 2]


def test_one_archive_is_many_tasks_work(spark, tmp_path):
    pack(tmp_path / "1.zip", **{f"m{i}": "a\n1\n" for i in range(40)})
    read = archives.records(archives.members(spark, str(tmp_path / "1.zip")))
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and read.count() == 40


def test_batches_are_bounded_by_characters(spark, tmp_path, monkeypatch):
    long = "long word " * 50_000
    records = [["header"]] + [[f"{i} {long}"] for i in range(30)]
    sizes = [b.num_rows for b in archives._batches("a", "m", iter(records))]
    assert sum(sizes) == 30 and max(sizes) * len(long) < archives.BATCH_CHARS + 2 * len(long)
    buffer = io.StringIO()
    csv.writer(buffer).writerows(records)
    pack(tmp_path / "1.zip", a=buffer.getvalue())
    got = archives.records(archives.members(spark, str(tmp_path / "1.zip"))).select("number", F.get("fields", F.lit(0)).alias("t")).collect()
    assert sorted((r["number"], r["t"]) for r in got) == [(i, f"{i} {long}") for i in range(30)]


@pytest.mark.parametrize("seed", range(3))
def test_what_was_written_is_read(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice('ab,"\n\r é') for _ in range(rng.randrange(1, 12))) + ".", rng.choice([None, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, text string, x double").repartition(3)
    assert archives.write_zipped_csv(df, f"{tmp_path}/out") == 500
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"part-{i:06d}.zip" for i in range(3)]
    assert archives.write_zipped_csv(df, f"{tmp_path}/out") == 500  # again over the same archives
    got = archives.zipped_csv(spark, f"{tmp_path}/out", "id long, text string, x double").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == rows
    assert archives.write_zipped_csv(df.limit(0), f"{tmp_path}/none") == 0
    assert archives.zipped_csv(spark, f"{tmp_path}/none", "id long, text string, x double").count() == 0
