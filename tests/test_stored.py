"""Tables that are written once for a plan and its input files."""

import os

from pyspark.sql import functions as F

from tallyforge.sources import stored as S


def _files(df):
    return set(df.inputFiles())


def test_the_same_plan_over_the_same_files_is_written_once(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(10).write.parquet(at)
    read = lambda: spark.read.parquet(at)
    one = S.stored(read().filter("id > 3"))
    assert _files(S.stored(read().filter("id > 3"))) == _files(one)
    assert _files(S.stored(read().filter("id > 4"))) != _files(one)
    assert _files(S.stored(S.stored(read()).groupBy((F.col("id") % 2).alias("k")).count())) == _files(S.stored(S.stored(read()).groupBy((F.col("id") % 2).alias("k")).count()))
    assert S.stored(read().filter("id > 4")).count() == 5


def test_changed_files_are_read_again(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(10).write.parquet(at)
    assert S.stored(spark.read.parquet(at)).count() == 10
    spark.range(7).write.mode("overwrite").parquet(at)
    assert S.stored(spark.read.parquet(at)).count() == 7


def test_local_rows_and_functions_are_told_apart(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(4).write.parquet(at)
    docs = spark.read.parquet(at)
    pick = lambda k: S.stored(docs.join(spark.createDataFrame([(k,)], "id long"), "id")).collect()[0].id
    assert [pick(1), pick(2), pick(1)] == [1, 2, 1]

    def times(k):
        def task(frames):
            for f in frames:
                yield f * k

        return S.stored(docs.mapInPandas(task, "id long")).agg(F.sum("id")).first()[0]

    assert [times(1), times(2)] == [6, 12]
    a, b = S.stored(spark.range(3).toDF("x")), S.stored(spark.range(3).toDF("x"))
    assert _files(a) != _files(b)


def test_a_table_that_is_gone_is_written_again(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(5).write.parquet(at)
    one = S.stored(spark.read.parquet(at))
    folder = os.path.dirname(next(iter(_files(one)))).removeprefix("file://")
    os.rename(folder, f"{folder}-moved")
    assert S.stored(spark.read.parquet(at)).count() == 5
