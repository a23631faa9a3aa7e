"""A stored table's new rows are computed once, however often their ids are needed."""

from cuewright.sources import sinks


def test_new_rows_are_computed_once(spark, tmp_path):
    path, seen = str(tmp_path / "rows"), spark.sparkContext.accumulator(0)

    def counted(rows):
        def run(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        schema = "video_id string, n long"
        return spark.createDataFrame(rows, schema).mapInPandas(run, schema)

    sinks.upsert_by_video(counted([("a", 1), ("b", 2), (None, 3)]), path)
    assert seen.value == 3
    sinks.upsert_by_video(counted([("b", 4), ("b", 5), ("c", 6)]), path, replaced=spark.createDataFrame([("a",)], "video_id string"))
    assert seen.value == 6
    got = [tuple(r) for r in spark.read.parquet(path).select("video_id", "n").collect()]
    assert sorted(got, key=str) == sorted([("b", 4), ("b", 5), ("c", 6), (None, 3)], key=str)
