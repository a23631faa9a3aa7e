"""One file per key: names that need escapes, null and empty keys, a second write."""

import pytest

from cuewright.sources import sinks

SCHEMA = "video_id string, lang string, place long, piece string"


def test_files_of_odd_keys_are_read_back(spark, tmp_path):
    path, rows = str(tmp_path / "files"), []
    for video in ("v1", "a/b=c %20:[x]", "größe ünïcode", "", None):
        for lang in ("vi", None):
            rows += [(video, lang, i, None if i == 2 else f"{video}|{lang}|{i}") for i in (3, 1, 2)]
    sinks.write_files(spark.createDataFrame([("old", "vi", 0, "gone")], SCHEMA), path, "place", keys=("video_id", "lang"))
    sinks.write_files(spark.createDataFrame(rows, SCHEMA).repartition(3), path, "place", keys=("video_id", "lang"))
    got = spark.read.text(path, wholetext=True).select("video_id", "lang", "value").collect()
    want = [(v or None, k, f"{v}|{k}|1\n\n{v}|{k}|3\n") for v, k in {r[:2] for r in rows}]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    # Hadoop's local writer leaves a checksum beside each file and starts two processes for the pair.
    assert not [f for f in (tmp_path / "files").rglob(".*") if f.is_file() and "_SUCCESS" not in f.name]
    assert (tmp_path / "files" / "_SUCCESS").exists()


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    from pyspark.sql import functions as F

    path = tmp_path / "files"
    rows = spark.createDataFrame([("v", "vi", i, str(i)) for i in range(3)], SCHEMA)
    broken = rows.withColumn("piece", F.when(F.col("place") == 2, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("piece")))
    with pytest.raises(Exception, match="broken"):
        sinks.write_files(broken, str(path), "place", keys=("video_id", "lang"))
    assert not [f for f in path.rglob("*") if f.is_file()]
